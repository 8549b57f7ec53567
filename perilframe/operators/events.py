"""Losses around one event date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_DAYS = 7


def claims_near_events(claims: DataFrame, events: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Claims within +-days of an event date (columns event_id, event_ts); dates that do not parse drop out.

    Each event is listed under every calendar day of its window, so the interval
    match is an equi-join on the day with an exact check behind it.
    """
    reach = F.make_dt_interval(F.lit(days))
    stamped = claims.withColumn("_ts", F.col("loss_date").try_cast("timestamp_ntz"))
    stamped = stamped.where(F.col("_ts").isNotNull()).withColumn("_day", F.to_date("_ts"))
    spans = events.select("event_id", F.col("event_ts").try_cast("timestamp_ntz").alias("_at")).where("_at is not null")
    first, last = F.to_date(F.col("_at") - reach), F.to_date(F.col("_at") + reach)
    spans = spans.withColumn("_day", F.explode(F.sequence(first, last)))
    hit = stamped.join(spans, "_day")
    return hit.where(F.col("_ts").between(F.col("_at") - reach, F.col("_at") + reach)).drop("_day", "_ts", "_at")


def joint_losses(near: DataFrame) -> DataFrame:
    """Per (event, location): total damage ratio, claims, mean severity."""
    return near.groupBy("event_id", "location_id").agg(
        F.sum("damage_ratio").alias("total_loss"),
        F.count("*").alias("claim_count"),
        F.avg("damage_ratio").alias("mean_severity"),
    )
