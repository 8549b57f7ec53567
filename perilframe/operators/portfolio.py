"""Frequency and severity baselines, tail metrics, scenarios, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hazard
from .exposure import over_universe
from .ranking import exact_quantiles

VAR_QUANTILE = 0.995
SEVERITY_CV = 0.5

# Fixed scenario table: id, name, frequency, severity and trend multiplier.
SCENARIOS = [
    ("baseline", "Baseline (No Stress)", 1.0, 1.0, 1.0),
    ("p100_1x", "1-in-100 Year Climate Stress", 1.25, 1.35, 1.20),
    ("p200_1x", "1-in-200 Year Extreme Solvency II Stress", 1.50, 1.60, 1.45),
    ("climate_change_1c", "Climate Change +1°C Warming", 1.20, 1.15, 1.20),
    ("climate_change_2c", "Climate Change +2°C Severe Warming", 1.45, 1.30, 1.45),
    ("concentrated_coastal", "Severe Coastal Surge Concentration", 1.10, 1.50, 1.15),
]


def scenario_rows(ids: list[str] | None = None):
    """The scenario table as an array literal; an unknown id raises."""
    known = {s[0] for s in SCENARIOS}
    unknown = sorted(set(ids or []) - known)
    if unknown:
        raise ValueError(f"unknown scenarios {unknown}; available {sorted(known)}")
    rows = [s for s in SCENARIOS if ids is None or s[0] in ids]
    fields = ("scenario_id", "scenario_name", "frequency_multiplier", "severity_multiplier", "trend_multiplier")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, s)]) for s in rows])


def frequency_baseline(locations: DataFrame, claims: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Share of years with a claim per location, clipped to [0.001, 1]."""
    in_range = claims.withColumn("year", F.year("loss_date")).where(F.col("year").between(first_year, last_year))
    per_location = in_range.select("location_id", "year").distinct().groupBy("location_id").agg(F.count("*").alias("_years"))
    all_ = over_universe(locations.select("location_id"), per_location, "location_id", ["_years"])
    rate = F.col("_years") / (last_year - first_year + 1)
    return all_.select("location_id", F.least(F.greatest(rate, F.lit(0.001)), F.lit(1.0)).alias("frequency"))


def severity_baseline(locations: DataFrame, claims: DataFrame) -> DataFrame:
    """Mean damage ratio per location; without a positive one, the portfolio mean."""
    per_location = claims.groupBy("location_id").agg(F.avg("damage_ratio").alias("_mean"))
    portfolio = claims.agg(F.avg("damage_ratio")).scalar()
    joined = locations.select("location_id").join(per_location, "location_id", "left")
    return joined.select("location_id", F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(portfolio).alias("severity"))


def beta_parameters(mean, cv: float = SEVERITY_CV) -> dict:
    """alpha and beta of a Beta distribution with the given mean and variation, clipped to [0.1, 100]."""
    mu = F.least(F.greatest(F.col(mean), F.lit(0.01)), F.lit(0.99))
    spread = mu * (1 - mu)
    var = F.least(F.pow(mu * cv, 2), spread * 0.99)
    size = spread / var - 1

    def clip(x):
        return F.least(F.greatest(x, F.lit(0.1)), F.lit(100.0))

    return {"alpha": clip(mu * size), "beta": clip((1 - mu) * size)}


def trend_multiplier(series: DataFrame, count: str, year: str = "year", recent: int = 5) -> DataFrame:
    """Mean of years >= last - 5 over the mean of all years, clipped to [0.5, 3]; one row."""
    last = series.agg(F.max(year)).scalar()
    means = series.agg(
        F.avg(count).alias("long_term_mean"), F.avg(F.when(F.col(year) >= last - recent, F.col(count))).alias("recent_mean")
    )
    ratio = F.col("recent_mean") / F.nullif(F.col("long_term_mean"), F.lit(0.0))
    clipped = F.least(F.greatest(ratio, F.lit(0.5)), F.lit(3.0))
    return means.withColumn("trend_multiplier", F.when(F.col("long_term_mean") > 0, clipped).otherwise(F.lit(1.0)))


def tail_metrics(annual: DataFrame, total_tiv, quantile: float = VAR_QUANTILE, loss: str = "annual_loss") -> DataFrame:
    """One row of risk metrics from one loss per season.

    ``total_tiv`` is a number or a scalar Column. The quantiles are exact and
    found among the distinct losses.
    """
    q = exact_quantiles(annual, loss, [0.5, quantile])
    marks = q.agg(
        F.struct(
            F.max(F.when(F.col("quantile") == 0.5, F.col("value"))).alias("median"),
            F.max(F.when(F.col("quantile") == quantile, F.col("value"))).alias("var"),
        ).alias("m")
    ).scalar()
    x = F.col(loss)
    var = marks.getField("var")
    facts = annual.agg(
        F.max(var).alias("value_at_risk"),
        F.avg(F.when(x >= var, x)).alias("tail_value_at_risk"),
        F.avg(x).alias("mean_annual_loss"),
        F.max(marks.getField("median")).alias("median_annual_loss"),
        F.stddev_pop(x).alias("std_annual_loss"),
        F.max(x).alias("max_annual_loss"),
        F.min(x).alias("min_annual_loss"),
        F.count("*").alias("num_seasons"),
    )
    tiv = F.lit(total_tiv) if isinstance(total_tiv, (int, float)) else total_tiv
    facts = facts.withColumn("total_tiv", tiv.cast("double"))
    base = F.nullif(F.col("total_tiv"), F.lit(0.0))
    return facts.withColumns(
        {
            "expected_loss_ratio": F.coalesce(F.col("mean_annual_loss") / base, F.lit(0.0)),
            "var_pct_tiv": F.coalesce(F.col("value_at_risk") / base * 100, F.lit(0.0)),
            "tvar_pct_tiv": F.coalesce(F.col("tail_value_at_risk") / base * 100, F.lit(0.0)),
        }
    )


SCALED_METRICS = [
    "value_at_risk", "tail_value_at_risk", "mean_annual_loss", "median_annual_loss", "std_annual_loss",
    "max_annual_loss", "min_annual_loss", "expected_loss_ratio", "var_pct_tiv", "tvar_pct_tiv",
]


def scenario_metrics(metrics: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Every metrics row under every scenario, loss figures scaled by the severity multiplier."""
    wide = metrics.select("*", F.inline(scenario_rows(ids)))
    m = F.col("severity_multiplier")
    return wide.withColumns({c: F.col(c) * m for c in SCALED_METRICS if c in metrics.columns})


def layer_price(annual: DataFrame, attachment: float, limit: float, loss: str = "annual_loss") -> DataFrame:
    """Excess-of-loss layer over annual losses: mean layer loss, hits, rate on line; one row."""
    layered = annual.select(hazard.layer_loss(loss, attachment, limit).alias("layered"))
    return layered.agg(
        F.count("*").alias("seasons"),
        F.count_if(F.col("layered") > 0).alias("seasons_hit"),
        F.avg("layered").alias("mean_layer_loss"),
        (F.avg("layered") / limit).alias("rate_on_line"),
    )
