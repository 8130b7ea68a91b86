"""Alert drafts, approvals and message rows. Nothing is sent from here."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarp import config as C
from scarp.functions.columns import sum_if


def draft_alerts(requests: DataFrame, pred: DataFrame) -> DataFrame:
    """requests: (alert_id, forecast_date, segment_ids, place). Unknown ids or no eligible one reject the draft."""
    asked = requests.select("alert_id", "forecast_date", "place", F.explode("segment_ids").alias("transect_id"))
    rows = pred.select("forecast_date", "transect_id", "tier", "p")
    hit = asked.join(rows, ["forecast_date", "transect_id"], "left")
    ok = F.col("tier") == "warning_eligible"
    # a request names at most a handful of segments, so the lists stay short
    g = hit.groupBy("alert_id", "forecast_date", "place").agg(
        F.array_sort(F.collect_list(F.when(F.col("tier").isNull(), F.col("transect_id")))).alias("unknown"),
        F.array_sort(F.collect_list(F.when(ok, F.col("transect_id")))).alias("segment_ids"),
        F.max(F.when(ok, F.col("p"))).alias("probability"))
    status = (F.when(F.size("unknown") > 0, "unknown segments").when(F.size("segment_ids") == 0, "not eligible")
              .otherwise("awaiting_approval"))
    return g.withColumn("status", status).withColumn(
        "probability", F.when(F.col("status") == "awaiting_approval", F.col("probability")))


def valid_official(name: str = "official_name", role: str = "role") -> Column:
    return (F.length(F.trim(name)) >= 3) & (F.length(F.trim(role)) >= 3)


def approve_alerts(drafts: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: (alert_id, ts, decision, official_name, role).

    An approval counts once, while the draft waits; a rejection is final. Refused decisions are only counted.
    Reduced to two time bounds per alert, so any number of decisions combines map-side.
    """
    d = drafts.where("status = 'awaiting_approval'").select("alert_id", "forecast_date", "place", "probability")
    ok = valid_official()
    at = F.struct("ts", "official_name")
    g = decisions.groupBy("alert_id").agg(
        F.min(F.when(ok & (F.col("decision") == "approve"), at)).alias("_first_ok"),
        F.min(F.when(ok & (F.col("decision") == "reject"), F.col("ts"))).alias("_first_no"),
        F.max(F.when(ok & (F.col("decision") == "reject"), at)).alias("_last_no"),
        sum_if(~ok).alias("n_refused"))
    approved = F.col("_first_ok").isNotNull() & (
        F.col("_first_no").isNull() | (F.col("_first_ok.ts") < F.col("_first_no")))
    return d.join(g, "alert_id", "left").select(
        "alert_id", "forecast_date", "place", "probability",
        F.when(F.col("_last_no").isNotNull(), "rejected").when(F.col("_first_ok").isNotNull(), "logged_not_sent")
        .otherwise("awaiting_approval").alias("status"),
        F.when(approved, F.trim(F.col("_first_ok.official_name"))).alias("approved_by"),
        F.trim(F.col("_last_no.official_name")).alias("rejected_by"),
        F.coalesce("n_refused", F.lit(0)).alias("n_refused"))


def mask_phone(phone: Column) -> Column:
    return F.when(F.length(phone) > 6, F.concat(F.substring(phone, 1, 4), F.lit("…"), F.right(phone, F.lit(2)))).otherwise("…")


def opted_in(recipients: DataFrame) -> DataFrame:
    return recipients.where(F.lower("opt_in") == "yes")


def alert_messages(alerts: DataFrame, recipients: DataFrame) -> DataFrame:
    """One SMS and one voice row per approved alert and opted-in recipient of its list (equi-join on ``list_id``)."""
    sms = F.replace(F.lit(C.SMS_TEMPLATE), F.lit("{place}"), F.col("place"))
    voice = F.concat(F.lit(f"[clip {C.VOICE_CLIP}] "),
                     F.replace(F.lit(C.VOICE_TEMPLATE), F.lit("{place}"), F.col("place")))
    kinds = F.array(F.struct(F.lit("sms").alias("kind"), sms.alias("body")),
                    F.struct(F.lit("voice").alias("kind"), voice.alias("body")))
    return (alerts.where("status = 'logged_not_sent'").join(opted_in(recipients), "list_id")
            .select("alert_id", mask_phone(F.col("phone")).alias("to"), F.inline(kinds),
                    F.lit("console").alias("gateway"), F.lit("logged_not_sent").alias("status")))
