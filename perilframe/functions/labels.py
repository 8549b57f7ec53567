"""Ordered CASE labels, flags and missing-value handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COASTAL_REACH_KM = 50.0
# Upper longitude bound of each coastal basin, west to east.
BASIN_BOUNDS = [(-85.0, "western_gulf"), (-82.0, "eastern_gulf"), (-80.0, "florida_atlantic")]
# Fixed words that mark a what-if question.
SCENARIO_WORDS = ("what if", "what-if", "stress", "scenario", "increase")


def coastal_basin(distance_km, lon, reach_km: float = COASTAL_REACH_KM) -> Column:
    """Basin of a near-coast location by longitude; everything else is inland."""
    dist, x = F.col(distance_km), F.col(lon)
    near = (dist <= reach_km) & ~F.isnan(dist)
    label = F.when(~F.coalesce(near, F.lit(False)) | x.isNull() | F.isnan(x), "inland")
    for bound, name in BASIN_BOUNDS:
        label = label.when(x < bound, name)
    return label.otherwise("atlantic_north")


def ocean_phase(anomaly) -> Column:
    """Warm at +0.5 and above, cold at -0.5 and below, neutral between."""
    return F.when(F.col(anomaly) >= 0.5, "el_nino").when(F.col(anomaly) <= -0.5, "la_nina").otherwise("neutral")


def is_present(column) -> Column:
    """True when a double is neither NULL nor NaN."""
    return F.col(column).isNotNull() & ~F.isnan(F.col(column))


def null_if_nan(column) -> Column:
    return F.when(~F.isnan(F.col(column)), F.col(column))


def finite_or_zero(column) -> Column:
    """Missing, NaN and infinite values become 0."""
    x = F.col(column).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def name_is(column, name: str) -> Column:
    return F.upper(F.col(column)) == name.upper()


def mentions_any(column, words=SCENARIO_WORDS) -> Column:
    """True when the lower-cased text holds any of the words."""
    text = F.lower(F.col(column))
    flag = F.lit(False)
    for w in words:
        flag = flag | text.contains(w)
    return flag
