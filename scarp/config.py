"""Settings. Fixed values that define the results are stated here once, as plain constants."""

# --- pass catalogue
PASS_UTC_WINDOW = ("234500", "235959")

# --- backscatter quantisation (dB range stored as 0..254, 255 = no data)
DB_MIN, DB_MAX = -30.0, 5.0
DB_STEPS = 254
NODATA = 255

# --- water masks
LEE_WINDOW = 5
LEE_LOOKS = 4.4
OTSU_BINS = 256
OTSU_MIN_PIXELS = 1000
VV_SEARCH, VH_SEARCH = (-30.0, 0.0), (-35.0, -5.0)
VV_PLAUSIBLE, VH_PLAUSIBLE = (-22.0, -11.0), (-28.0, -16.0)
VV_FALLBACK, VH_FALLBACK = -15.0, -21.0
RESCUE_MARGIN_DB = 3.0
SPECK_PX = 50
SCENE_BAD_CLASSES = (0, 1, 3, 8, 9, 10)
BARE_NDVI = 0.15

# --- braid belt, transects and bank positions
PIXEL_M = 10.0
MIN_RIVER_KM2 = 5.0
OPEN_RADIUS_PX = 7
BRIDGE_GAP_PX = 2
LINE_BUFFER_M = 250.0
SPACING_M, TANGENT_M = 200.0, 100.0
RIVERWARD_M, LANDWARD_M = 1500.0, 4000.0
NEAR_FEATURE_M = 1500.0
BELT_RUN = 3
CORE_PX = 15
NEAR_M, SHIELD_M, NODATA_GUARD_M = 300.0, 2000.0, 500.0

# --- as-of features
CURRENT_DAYS, PERMANENT_DAYS, PERMANENT_MIN = 24, 180, 4
# feature -> (days back, tolerance in days)
LAGS = {28: 12, 56: 12, 84: 12, 365: 30}
STAGE_LAGS = {12: 8, 24: 8}
LAST_CHANGE_MAX_DAYS = 30
FEATURE_GROUPS = {
    "recent_retreat": ["ret_28_m", "ret_56_m", "ret_84_m", "raw_last_change_m"],
    "history": ["ret_365_m", "n_obs_365"],
    "channel_geometry": ["dist_main_channel_m", "d_dist_main_28_m", "near_channel_width_m",
                         "char_shield_frac", "nearbank_water_frac", "baseline_curvature", "embayment_m"],
    "water_level": ["stage_km2", "stage_change_12d", "stage_change_24d", "stage_anom_km2", "inundation_m"],
    "season": ["doy_sin", "doy_cos"],
    "neighbours": ["nb_ret_84_m", "nb_ret_365_m"],
    "bank_height": ["bank_height_m"],
}
FEATURES = [f for fs in FEATURE_GROUPS.values() for f in fs]
# reasons split the geometry group further
REASON_OVERRIDES = {
    "dist_main_channel_m": "main_channel", "d_dist_main_28_m": "main_channel",
    "char_shield_frac": "char_shield",
    "near_channel_width_m": "near_bank_channel", "nearbank_water_frac": "near_bank_channel",
    "baseline_curvature": "bank_shape", "embayment_m": "bank_shape",
}

# --- labels
HORIZON_DAYS, TARGET_TOL_DAYS, TARGET_HALF_DAYS = 28, 8, 12
THRESHOLD_FLOOR_M = 20.0
MAJOR_M = 100.0

# --- evaluation
TOP_K = 20
SEASON_MONTHS = (6, 7, 8, 9, 10)
BOOT_N, BOOT_BLOCK = 4000, 3
# inner edges of ten equal bins on [0, 1], as IEEE doubles
RELIABILITY_EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)
REASONS_TOP_RANK = 40
DEFAULT_WARNING_PROB = 0.5

# --- alert texts (fixed values)
BANK_NAMES = {"W": "West bank", "E": "East bank"}
SMS_TEMPLATE = ("নদীভাঙন সতর্কবার্তা: আগামী কয়েক সপ্তাহে {place} এলাকার নদীতীরে ভাঙনের ঝুঁকি বেশি। "
                "মালামাল ও গবাদিপশু নিরাপদ স্থানে সরানোর প্রস্তুতি নিন। ইউনিয়ন পরিষদের নির্দেশনা মেনে চলুন।")
VOICE_TEMPLATE = ("এটি নদীভাঙন সতর্কবার্তা। আগামী কয়েক সপ্তাহে {place} এলাকার নদীতীরে ভাঙনের ঝুঁকি বেশি। "
                  "ঘরের মালামাল ও গবাদিপশু নিরাপদ স্থানে সরানোর প্রস্তুতি নিন এবং ইউনিয়ন পরিষদের নির্দেশনা মেনে চলুন।")
VOICE_CLIP = "/voices/warning_bangla.mp3"
