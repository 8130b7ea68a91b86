import datetime as dt
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from scarp.session import build_session
    s = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def transects(spark):
    rows = [(f"{b}-{200 * i + 100:05d}", b, 200.0 * i + 100, 0.0, -200.0 * i, -1.0 if b == "W" else 1.0, 0.0)
            for b in "WE" for i in range(30)]
    return spark.createDataFrame(rows, "transect_id string, bank string, chainage_m double, x0 double, y0 double, nx double, ny double")


def synthetic(seed: int = 7) -> pd.DataFrame:
    """60 passes x 60 segments; every seventh segment moves fast from June to September."""
    rng = np.random.default_rng(seed)
    dates = [dt.date(2019, 1, 5) + dt.timedelta(days=12 * j) for j in range(60)]
    rows = []
    for b in "WE":
        for i in range(30):
            pos, k = 0.0, i + (0 if b == "W" else 30)
            for j, d in enumerate(dates):
                fast = k % 7 == 0 and 6 <= d.month <= 9
                pos += 25.0 if fast else 0.3
                v = pos + rng.normal(0, 2) + (150 if (k, j) == (3, 30) else 0)
                rows.append((f"{d:%Y%m%d}_S1A", f"{b}-{200 * i + 100:05d}", d, None if rng.random() < 0.03 else round(v, 3),
                             float(rng.integers(50, 900)), float(rng.integers(50, 400)), float(round(rng.random(), 3)),
                             float(round(rng.random(), 3)), 3.0, 100.0 + 30 * np.sin(j / 5)))
    return pd.DataFrame(rows, columns=["pass_id", "transect_id", "date", "bank_pos_m", "dist_main_channel_m",
                                       "near_channel_width_m", "char_shield_frac", "nearbank_water_frac", "bank_height_m",
                                       "belt_water_km2"])


POSITION_SCHEMA = ("pass_id string, transect_id string, date date, bank_pos_m double, dist_main_channel_m double, "
                   "near_channel_width_m double, char_shield_frac double, nearbank_water_frac double, bank_height_m double, "
                   "belt_water_km2 double")


@pytest.fixture(scope="session")
def positions(spark):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in synthetic().itertuples(index=False)]
    return spark.createDataFrame(rows, POSITION_SCHEMA).repartition(4).cache()
