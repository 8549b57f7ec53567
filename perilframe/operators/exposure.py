"""Location universe joins: gold features, hazard history, training targets, key alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hazard import location_years
from .support import add_default_columns, dealt, require_columns

HISTORY = [
    "historical_claim_count",
    "historical_incurred_loss_usd",
    "historical_max_wind_kt",
    "historical_mean_damage_ratio",
    "distinct_storms_experienced",
]
# Fixed defaults of optional feature columns.
FEATURE_DEFAULTS = {
    "metro_center": "",
    "construction_class": "",
    "roof_type": "",
    "distance_to_coast_km": 0.0,
    "basin_sst_celsius_mean": 28.1,
    "basin_sst_celsius_max": 35.9,
}


def claim_history(claims: DataFrame) -> DataFrame:
    """Count, loss, peak wind, mean damage and number of storms per location.

    Two levels, storm inside location, instead of a distinct count.
    """
    per_storm = claims.groupBy("location_id", "storm_id").agg(
        F.count("*").alias("_n"),
        F.sum("incurred_loss_usd").alias("_loss"),
        F.max("max_wind_experienced_kt").alias("_wind"),
        F.sum("damage_ratio").alias("_ratio"),
        F.count("damage_ratio").alias("_ratios"),
    )
    return per_storm.groupBy("location_id").agg(
        F.sum("_n").alias("historical_claim_count"),
        F.sum("_loss").alias("historical_incurred_loss_usd"),
        F.max("_wind").alias("historical_max_wind_kt"),
        (F.sum("_ratio") / F.expr("nullif(sum(_ratios), 0)")).alias("historical_mean_damage_ratio"),
        F.count("storm_id").alias("distinct_storms_experienced"),
    )


def over_universe(universe: DataFrame, facts: DataFrame, key: str, zero: list[str]) -> DataFrame:
    """Left join onto every key, 0 where there is no fact."""
    return universe.join(facts, key, "left").na.fill(0, zero)


def hazard_history(locations: DataFrame, claims: DataFrame) -> DataFrame:
    """``claim_history`` for all locations, those without claims as zero rows."""
    return over_universe(locations.select("location_id"), claim_history(claims), "location_id", HISTORY)


def assemble_features(locations: DataFrame, climate: DataFrame, hazard: DataFrame, coast: DataFrame) -> DataFrame:
    """Left-join the feature tables on location_id; all joins share one key and one shuffle."""
    return (
        locations.join(climate, "location_id", "left")
        .join(hazard, "location_id", "left")
        .join(coast, "location_id", "left")
    )


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and NULLs per column, in one pass."""
    return df.agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns]
    )


def training_targets(claims: DataFrame, first_year: int, last_year: int, date: str = "loss_date", tasks: int | None = None) -> DataFrame:
    """Loss, largest ratio and count per (location, year) inside the year range."""
    in_range = claims.withColumn("year", F.year(date)).where(F.col("year").between(first_year, last_year))
    in_range = dealt(in_range, tasks, "location_id", "year")
    return in_range.groupBy("location_id", "year").agg(
        F.sum("incurred_loss_usd").alias("incurred_loss_usd"),
        F.max("damage_ratio").alias("max_damage_ratio"),
        F.count("claim_id").alias("claim_count_in_year"),
    )


def training_table(
    features: DataFrame, claims: DataFrame, yearly_sst: DataFrame | None, first_year: int, last_year: int, tasks: int | None = None
) -> DataFrame:
    """Complete (location, year) grid with static features, yearly covariates and claim targets.

    Targets are joined to bare keys, features last, so the wide rows are shuffled
    on location_id only once. Large tables name the ``tasks`` over which claims and grid are dealt to meet.
    """
    require_columns(features, ["location_id", "construction_class", "roof_type", "tiv_usd"], "features")
    require_columns(claims, ["claim_id", "location_id", "loss_date", "incurred_loss_usd", "damage_ratio"], "claims")
    grid = dealt(location_years(features, first_year, last_year), tasks, "location_id", "year")
    targets = training_targets(claims, first_year, last_year, tasks=tasks)
    table = grid.join(targets, ["location_id", "year"], "left").na.fill(
        0, ["incurred_loss_usd", "max_damage_ratio", "claim_count_in_year"]
    )
    table = table.withColumn("had_claim", (F.col("claim_count_in_year") > 0).cast("int"))
    if yearly_sst is not None:
        table = table.join(yearly_sst, "year", "left")
    return add_default_columns(table, FEATURE_DEFAULTS)


def composite_risk(locations: DataFrame, claims: DataFrame) -> DataFrame:
    """0.4 frequency + 0.4 loss + 0.2 severity, each relative to the book's maximum."""
    facts = claims.groupBy("location_id").agg(
        F.count("claim_id").alias("claim_count"),
        F.sum("damage_ratio").alias("total_loss"),
        F.avg("damage_ratio").alias("mean_severity"),
    )
    # A filled-in zero never raises a maximum of non-negative facts above what the
    # facts hold, so the maxima come from the small claim aggregate.
    book = facts.join(locations.select("location_id"), "location_id", "left_semi")
    scaled = over_universe(
        locations.select("location_id"), facts, "location_id", ["claim_count", "total_loss", "mean_severity"]
    )
    weights = {"claim_count": 0.4, "total_loss": 0.4, "mean_severity": 0.2}
    largest = [F.greatest(F.coalesce(F.max(c), F.lit(0)), F.lit(0)).alias(c) for c in weights]
    tops = book.agg(F.struct(*largest).alias("top")).scalar()
    score = F.lit(0.0)
    for column, weight in weights.items():
        score = score + weight * (F.col(column) / (tops.getField(column) + 1e-8))
    return scaled.select("location_id", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("risk_score"))


def alignment_report(locations: DataFrame, claims: DataFrame, events: DataFrame, date: str = "loss_date") -> DataFrame:
    """Key coverage both ways, orphan rows and year overlap as (metric, value) rows.

    Rows are first reduced to counts per key, on both sides map-side combined, so
    one join per table answers coverage and orphans alike.
    """
    universe = locations.select("location_id").distinct().withColumn("_known", F.lit(1))

    def against(table: DataFrame, name: str) -> DataFrame:
        per_key = table.groupBy("location_id").agg(F.count("*").alias("_n"))
        both = universe.join(per_key, "location_id", "full")
        return both.agg(
            F.count_if(F.col("_n").isNotNull()).alias(f"locations_in_{name}"),
            F.count_if(F.col("_known").isNotNull() & F.col("_n").isNull()).alias(f"missing_from_{name}"),
            F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias(f"orphaned_{name}"),
        )

    claim_years = claims.select(F.year(date).alias("year")).distinct()
    event_years = events.select(F.col("year").cast("int").alias("year")).distinct()
    parts = [
        universe.agg(F.count("*").alias("locations_in_exposure")),
        against(claims, "claims"),
        against(events, "event_features"),
        claim_years.agg(F.count("*").alias("years_in_claims")),
        event_years.agg(F.count("*").alias("years_in_event_features")),
        claim_years.intersect(event_years).agg(F.count("*").alias("year_overlap")),
    ]
    rows = None
    for part in parts:
        long = part.unpivot([], part.columns, "metric", "value")
        rows = long if rows is None else rows.unionByName(long)
    return rows.select("metric", F.col("value").cast("long").alias("value"))
