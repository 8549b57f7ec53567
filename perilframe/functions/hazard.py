"""Wind field, damage curve and policy terms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the wind field model.
RMW_AT_50_KT_KM = 60.0
RMW_KM_PER_KT = 0.4
RMW_MIN_KM = 15.0
RMW_MAX_KM = 60.0
DECAY_EXPONENT = 0.5
MIN_DISTANCE_KM = 1e-6

# Fixed values of the damage curve: class -> (midpoint kt, steepness).
CONSTRUCTION_CURVES = {
    "frame": (95.0, 0.045),
    "masonry_veneer": (105.0, 0.045),
    "masonry_cbs": (120.0, 0.040),
    "reinforced_concrete": (140.0, 0.035),
}
# Roof -> midpoint shift kt.
ROOF_SHIFTS = {"hip": 8.0, "gable": 0.0, "flat": -5.0}

# Fixed values of the event-loss run.
INFLUENCE_BOX = {"lat_min": 18.0, "lat_max": 36.0, "lon_min": -93.0, "lon_max": -74.0}
WIND_RADIUS_KM = 400.0
MIN_WIND_KT = 50.0
MIN_DAMAGE_RATIO = 0.005


def max_wind_radius_km(wind_kt) -> Column:
    """Stronger storms are tighter: a linear rule clipped to [15, 60] km."""
    raw = RMW_AT_50_KT_KM - RMW_KM_PER_KT * (F.col(wind_kt) - 50.0)
    return F.least(F.greatest(raw, F.lit(RMW_MIN_KM)), F.lit(RMW_MAX_KM))


def wind_at_distance(wind_kt, distance_km, rmw: Column, exponent: float = DECAY_EXPONENT) -> Column:
    """Full wind inside the radius of maximum wind, power-law decay outside."""
    wind, dist = F.col(wind_kt), F.col(distance_km)
    ratio = rmw / F.greatest(dist, F.lit(MIN_DISTANCE_KM))
    fall_off = F.sqrt(ratio) if exponent == 0.5 else F.pow(ratio, F.lit(exponent))
    return F.when(dist <= rmw, wind).otherwise(wind * fall_off)


def _lookup(column: str, table: dict[str, float], what: str) -> Column:
    """Small fixed table as a CASE chain that fails on a value it does not know."""
    chain = None
    for key, value in table.items():
        step = F.col(column) == key
        chain = F.when(step, F.lit(value)) if chain is None else chain.when(step, F.lit(value))
    return chain.otherwise(
        F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(F.col(column), F.lit("NULL")))).cast("double")
    )


def damage_ratio(wind: Column, construction="construction_class", roof="roof_type") -> Column:
    """Logistic damage ratio in [0, 1]; an unknown class or roof raises."""
    midpoint = _lookup(construction, {k: v[0] for k, v in CONSTRUCTION_CURVES.items()}, "construction class")
    steepness = _lookup(construction, {k: v[1] for k, v in CONSTRUCTION_CURVES.items()}, "construction class")
    shift = _lookup(roof, ROOF_SHIFTS, "roof type")
    ratio = 1 / (1 + F.exp(-steepness * (wind - (midpoint + shift))))
    return F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))


def incurred_loss(ratio, tiv) -> Column:
    return F.bround(F.col(ratio) * F.col(tiv), 2)


def paid_loss(incurred, deductible, limit) -> Column:
    """Loss net of the deductible, capped by the limit."""
    net = F.greatest(F.col(incurred) - F.col(deductible), F.lit(0.0))
    return F.bround(F.least(net, F.col(limit)), 2)


def policy_terms(tiv, coverage_ratio, deductible_pct, effective) -> dict[str, Column]:
    """Limit to the nearest thousand, deductible to the nearest hundred, one-year term."""
    limit = F.bround(F.col(tiv) * F.col(coverage_ratio) / 1000.0, 0) * 1000.0
    return {
        "limit_usd": limit,
        "deductible_usd": F.bround(limit * F.col(deductible_pct) / 100.0, 0) * 100.0,
        "expiry_date": F.add_months(F.col(effective), 12),
    }


def layer_loss(loss, attachment: float, limit: float) -> Column:
    """Loss to an excess-of-loss layer."""
    above = F.greatest(F.col(loss) - attachment, F.lit(0.0))
    return F.least(above, F.lit(float(limit)))
