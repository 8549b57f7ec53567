"""Region-year series: complete grids, gap filling, training windows, naive baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hazard import location_years


def region_series(
    locations: DataFrame, claims: DataFrame, first_year: int, last_year: int, region: str = "region_code", climate: DataFrame | None = None
) -> DataFrame:
    """(region_id, year): total claims and the mean of the location means, 0 in quiet years.

    ``climate`` (year, further columns; one row a year) is joined to each region; years it lacks take the last known value of
    the region's earlier years, else the first of its later ones.
    """
    per_location = (
        claims.withColumn("year", F.year("loss_date"))
        .where(F.col("year").between(first_year, last_year))
        .groupBy("location_id", "year")
        .agg(F.count("claim_id").alias("_n"), F.avg("damage_ratio").alias("_mean"))
    )
    regions = locations.select("location_id", F.col(region).cast("string").alias("region_id"))
    per_region = (
        per_location.join(regions, "location_id")
        .groupBy("region_id", "year")
        .agg(F.sum("_n").alias("frequency"), F.avg("_mean").alias("severity"))
    )
    grid = location_years(regions.select("region_id").distinct(), first_year, last_year)
    series = grid.join(per_region, ["region_id", "year"], "left").na.fill(0, ["frequency", "severity"])
    if climate is None:
        return series
    return fill_gaps(series.join(climate, "year", "left"), carry=[c for c in climate.columns if c != "year"], by="region_id")


def fill_gaps(
    series: DataFrame, linear: list[str] = (), carry: list[str] = (), axis: str = "year", by: str | None = None
) -> DataFrame:
    """Fill missing values along an integer axis.

    ``linear`` columns are interpolated between their neighbours and carried
    outward at the ends; ``carry`` columns take the last known value, then the
    first. Groups hold one row per axis step, so the windows are short.
    """
    part = [by] if by else []
    back = Window.partitionBy(*part).orderBy(axis).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*part).orderBy(axis).rowsBetween(Window.currentRow, Window.unboundedFollowing)

    def around(column: str):
        known = F.when(F.col(column).isNotNull(), F.col(axis))
        return (
            F.last(column, ignorenulls=True).over(back),
            F.first(column, ignorenulls=True).over(ahead),
            F.last(known, ignorenulls=True).over(back),
            F.first(known, ignorenulls=True).over(ahead),
        )

    filled = {}
    for column in linear:
        v0, v1, x0, x1 = around(column)
        slope = (v1 - v0) / F.nullif(x1 - x0, F.lit(0))
        inner = v0 + slope * (F.col(axis) - x0)
        filled[column] = F.coalesce(F.col(column), inner, v0, v1)
    for column in carry:
        v0, v1, _, _ = around(column)
        filled[column] = F.coalesce(v0, v1)
    return series.withColumns(filled)


def climate_summary(
    yearly_sst: DataFrame, index: DataFrame, first_year: int, last_year: int, season: str = "SON"
) -> DataFrame:
    """One gap-filled row per year: sea temperature and the index of one season."""
    spark = yearly_sst.sparkSession
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    autumn = index.where(F.col("season") == season).select("year", "oni_anomaly_celsius", "enso_phase")
    joined = years.join(yearly_sst, "year", "left").join(autumn, "year", "left")
    return fill_gaps(
        joined,
        linear=["basin_sst_celsius_mean", "oni_anomaly_celsius"],
        carry=["basin_sst_celsius_max", "enso_phase"],
    )


def training_windows(
    series: DataFrame, target: str, key: str = "region_id", axis: str = "year", history=(5, 10), horizon: int = 5
) -> DataFrame:
    """Per (key, t): up to 10 past values, at least 5, and the next 5 targets, without year gaps.

    Runs of consecutive years are numbered first, so a window never spans a gap.
    """
    per_key = Window.partitionBy(key).orderBy(axis)
    runs = series.withColumn("_run", F.col(axis) - F.row_number().over(per_key))
    run = Window.partitionBy(key, "_run").orderBy(axis)
    past = F.collect_list(target).over(run.rowsBetween(1 - history[1], 0))
    future = F.collect_list(target).over(run.rowsBetween(1, horizon))
    out = runs.select(key, axis, past.alias("history"), future.alias("targets"))
    return out.where((F.size("history") >= history[0]) & (F.size("targets") == horizon))


def fit_baselines(train: DataFrame, target: str, key: str = "region_id", axis: str = "year") -> DataFrame:
    """Per key: mean, last value and least-squares line of the target over the axis."""
    return train.groupBy(key).agg(
        F.avg(target).alias("historical_mean"),
        F.max_by(target, axis).alias("last_value"),
        F.regr_slope(F.col(target), F.col(axis)).alias("slope"),
        F.regr_intercept(F.col(target), F.col(axis)).alias("intercept"),
    )


def predict_baselines(test: DataFrame, fitted: DataFrame, key: str = "region_id", axis: str = "year") -> DataFrame:
    """Mean, persistence and trend forecasts; a key the fit has not seen gets 0."""
    joined = test.join(fitted, key, "left")
    return joined.select(
        *test.columns,
        F.coalesce("historical_mean", F.lit(0.0)).alias("mean_pred"),
        F.coalesce("last_value", F.lit(0.0)).alias("persistence_pred"),
        F.coalesce(F.col("slope") * F.col(axis) + F.col("intercept"), F.lit(0.0)).alias("trend_pred"),
    )


def attention_importance(attention: DataFrame, names: list[str], column: str = "weights") -> DataFrame:
    """Mean weight per array position over all rows, named and sorted; a row with another number of weights is an error."""
    labels = F.array(*[F.lit(n) for n in names])
    other = F.raise_error(F.lit(f"{column} must have {len(names)} weights, one for each name")).cast("array<double>")
    weights = F.when(F.col(column).isNull() | (F.size(column) == len(names)), F.col(column).cast("array<double>")).otherwise(other)
    long = attention.select(F.posexplode(weights).alias("position", "weight"))
    means = long.groupBy("position").agg(F.avg("weight").alias("importance_score"))
    named = means.select(F.element_at(labels, F.col("position") + 1).alias("feature_name"), "importance_score")
    return named.orderBy(F.desc("importance_score"), "feature_name")
