"""Storm exposure of locations: event features, peak wind, event losses, climate aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, hazard, labels
from ..functions.times import utc_seconds
from .ranking import positions
from .spatial import SITE, grid_join, grid_key, radius_join, sites_of, snap_to_grid, to_locations
from .support import require_columns, task_count

WIND_THRESHOLDS_KT = (34, 50, 64, 100)
FEATURE_RADIUS_KM = 500.0


def storms_in_box(tracks: DataFrame, box: dict = hazard.INFLUENCE_BOX) -> DataFrame:
    """Distinct storm ids with at least one observation inside the box."""
    return tracks.where(geo.in_box("lat", "lon", box)).select("storm_id").distinct()


def track_points(tracks: DataFrame, *columns: str) -> DataFrame:
    """Track columns with the position renamed, ready to be the right side of a radius join."""
    return tracks.select(*columns, F.col("lat").alias("track_lat"), F.col("lon").alias("track_lon"))


STORM_BITS = 62


def _storm_bits(tracks: DataFrame) -> DataFrame:
    """(obs_year, storm_id, word, bit): the storms of a year numbered, 62 to a word."""
    storms = tracks.select("obs_year", "storm_id").distinct()
    numbered = positions(storms, "storm_id", by="obs_year")
    return numbered.select(
        "obs_year",
        "storm_id",
        F.expr(f"position div {STORM_BITS}").alias("_word"),
        F.expr(f"shiftleft(1L, cast(position % {STORM_BITS} as int))").alias("_bit"),
    )


def yearly_event_features(
    tracks: DataFrame, locations: DataFrame, first_year: int, last_year: int, radius_km: float = FEATURE_RADIUS_KM
) -> DataFrame:
    """One row per (location, year) with storm proximity features; quiet years give 0 or NULL.

    Observations are folded per (year, position) before they meet the sites: every
    feature is a minimum, maximum or sum, and the distinct storms are the union of
    bit sets. The pairs of a site are produced and aggregated in one task.
    """
    require_columns(tracks, ["storm_id", "obs_year", "lat", "lon", "max_wind_kt", "min_pressure_mb"], "tracks")
    seen = tracks.where(F.col("obs_year").between(first_year, last_year))
    counts = [F.count_if(F.col("max_wind_kt") >= t).alias(f"_above_{t}") for t in WIND_THRESHOLDS_KT]
    obs = (
        seen.join(_storm_bits(seen), ["obs_year", "storm_id"])
        .groupBy(F.col("obs_year").alias("year"), "_word", F.col("lat").alias("track_lat"), F.col("lon").alias("track_lon"))
        .agg(F.bit_or("_bit").alias("_storms"), F.max("max_wind_kt").alias("_wind"), F.min("min_pressure_mb").alias("_mb"), *counts)
    )
    pairs = radius_join(sites_of(locations), obs, radius_km)
    per_word = pairs.groupBy(*SITE, "year", "_word").agg(
        F.bit_or("_storms").alias("_storms"), F.min("distance_km").alias("_km"), F.max("_wind").alias("_wind"),
        F.min("_mb").alias("_mb"), *[F.sum(f"_above_{t}").alias(f"_above_{t}") for t in WIND_THRESHOLDS_KT],
    )
    per_year = per_word.groupBy(*SITE, "year").agg(
        F.sum(F.bit_count("_storms")).alias("storm_count"),
        F.min("_km").alias("min_distance_to_track_km"),
        F.max("_wind").alias("max_wind_nearby_kt"),
        F.min("_mb").alias("min_pressure_nearby_mb"),
        *[F.sum(f"_above_{t}").alias(f"days_above_{t}kt") for t in WIND_THRESHOLDS_KT],
    )
    zero = ["storm_count", "max_wind_nearby_kt"] + [f"days_above_{t}kt" for t in WIND_THRESHOLDS_KT]
    everyone = location_years(locations.select("location_id", *SITE), first_year, last_year)
    return everyone.join(per_year, [*SITE, "year"], "left").drop(*SITE).na.fill(0, zero)


def location_years(keys: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Every key for every year of the inclusive range; a projection, no join."""
    return keys.withColumn("year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))


def peak_winds(
    tracks: DataFrame,
    locations: DataFrame,
    radius_km: float = hazard.WIND_RADIUS_KM,
    floor_kt: float | None = None,
) -> DataFrame:
    """Peak wind and the first time it occurs, per (location, storm) within the radius.

    Repeated observations (storm, position, wind) are folded to the first, and
    winds are taken per site.

    With ``floor_kt`` only peaks at or above it are kept, and each observation is
    joined only as far as it can still deliver that wind: w*sqrt(rmw/d) >= floor
    means d <= rmw*(w/floor)^2.
    """
    stamped = tracks.withColumn("_second", utc_seconds(tracks, "obs_ts"))
    obs = stamped.groupBy(
        "storm_id", "max_wind_kt", F.col("lat").alias("track_lat"), F.col("lon").alias("track_lon")
    ).agg(F.min("_second").alias("_second"), F.min("obs_ts").alias("_ts"))
    obs = obs.withColumn("_rmw", hazard.max_wind_radius_km("max_wind_kt"))
    reach = None
    if floor_kt is not None:
        strength = F.pow(F.col("max_wind_kt") / floor_kt, 2)
        obs = obs.where(F.col("max_wind_kt") >= floor_kt)
        obs = obs.withColumn("_reach", F.col("_rmw") * strength * (1 + 1e-9) + 1e-6)
        reach = "_reach"
    pairs = radius_join(sites_of(locations), obs, radius_km, reach=reach)
    felt = F.floor(hazard.wind_at_distance("max_wind_kt", "distance_km", F.col("_rmw")) * 1e6 + 0.5)
    # One bigint orders by wind (1e-6 kt), then by earliest second, so that every
    # aggregate buffer is a primitive and the pairs go through a hash aggregate.
    order = felt.cast("long") * F.lit(1 << 33) + (F.lit(1 << 32) - F.col("_second"))
    peaks = pairs.withColumn("_order", order).groupBy(*SITE, "storm_id").agg(
        F.max("_order").alias("_peak"), F.max_by("_ts", "_order").alias("loss_date")
    )
    wind = F.shiftright("_peak", 33) / 1e6
    peaks = peaks.select(*SITE, "storm_id", wind.alias("max_wind_experienced_kt"), "loss_date")
    if floor_kt is not None:
        peaks = peaks.where(F.col("max_wind_experienced_kt") >= floor_kt)
    return to_locations(locations, peaks)


def event_losses(
    locations: DataFrame,
    policies: DataFrame,
    tracks: DataFrame,
    min_wind_kt: float = hazard.MIN_WIND_KT,
    min_damage: float = hazard.MIN_DAMAGE_RATIO,
) -> DataFrame:
    """Loss of every policy to every storm of the catalogue.

    Order of work: storms near the book, the radius join as far as each
    observation can still reach the wind floor, the peak per (location, storm),
    then the joins that carry wide rows.
    """
    require_columns(locations, ["location_id", "lat", "lon", "construction_class", "roof_type", "tiv_usd"], "locations")
    require_columns(policies, ["location_id", "policy_id", "deductible_usd", "limit_usd"], "policies")
    near = tracks.join(storms_in_box(tracks), "storm_id", "left_semi")
    peaks = peak_winds(near, locations, floor_kt=min_wind_kt)
    struck = peaks.join(locations.select("location_id", "construction_class", "roof_type", "tiv_usd"), "location_id")
    struck = struck.withColumn("damage_ratio", hazard.damage_ratio(F.col("max_wind_experienced_kt")))
    struck = struck.where(F.col("damage_ratio") >= min_damage)
    insured = struck.join(policies.select("location_id", "policy_id", "deductible_usd", "limit_usd"), "location_id")
    insured = insured.withColumn("incurred_loss_usd", hazard.incurred_loss("damage_ratio", "tiv_usd"))
    return insured.withColumn(
        "paid_loss_usd", hazard.paid_loss("incurred_loss_usd", "deductible_usd", "limit_usd")
    ).select(
        "location_id", "policy_id", "storm_id", "loss_date", F.lit("hurricane_wind").alias("peril_type"),
        "max_wind_experienced_kt", "damage_ratio", "incurred_loss_usd", "paid_loss_usd",
    )


def top_events(losses: DataFrame, n: int = 10) -> DataFrame:
    """The n costliest storms, ties by storm id."""
    totals = losses.groupBy("storm_id").agg(
        F.count("*").alias("claims"),
        F.sum("incurred_loss_usd").alias("incurred_loss_usd"),
        F.sum("paid_loss_usd").alias("paid_loss_usd"),
    )
    return totals.orderBy(F.desc("incurred_loss_usd"), "storm_id").limit(n)


def event_summary(losses: DataFrame, storm=None) -> DataFrame:
    """Totals of one storm, or of the whole book."""
    rows = losses if storm is None else losses.where(F.col("storm_id") == storm)
    return rows.agg(
        F.count("*").alias("claims"),
        F.countDistinct("location_id").alias("locations"),
        F.max("max_wind_experienced_kt").alias("max_wind_kt"),
        F.sum("incurred_loss_usd").alias("incurred_loss_usd"),
        F.sum("paid_loss_usd").alias("paid_loss_usd"),
    )


CLIMATE_AGGREGATES = {
    "mslp_hpa_mean": lambda: F.avg("mslp_hpa"),
    "mslp_hpa_min": lambda: F.min("mslp_hpa"),
    "era5_wind_speed_ms_mean": lambda: F.avg("wind_speed_ms"),
    "era5_wind_speed_ms_max": lambda: F.max("wind_speed_ms"),
}


def climate_per_location(joined: DataFrame, **more) -> DataFrame:
    """Pressure and wind statistics per location over an already joined table, and ``more`` of one's own."""
    return joined.groupBy("location_id").agg(*[f().alias(n) for n, f in CLIMATE_AGGREGATES.items()], *[c.alias(n) for n, c in more.items()])


def climate_from_joined_rows(locations: DataFrame, grid: DataFrame) -> DataFrame:
    """The statistics over the joined rows of ``grid_join``, made once for each cell in which locations stand.

    Locations in one cell have the same joined rows, so a cell is joined as one site: as many joined rows as the grid has, not times the
    locations of a cell. Rows that share a location id are one location: their cells' means are weighted by the values behind them.
    """
    dealt = locations.select("location_id", "lat", "lon").repartition(task_count(grid.sparkSession))  # snapping looks at each grid line
    snapped = snap_to_grid(dealt, grid).withColumn("_cell", grid_key("grid_lat", "grid_lon"))
    sites = snapped.groupBy(F.col("_cell").alias("location_id")).agg(F.min("grid_lat").alias("lat"), F.min("grid_lon").alias("lon"))
    values = {f"_n_{c}": F.count(c) for c in ("mslp_hpa", "wind_speed_ms")}
    cells = climate_per_location(grid_join(sites, grid), **values).withColumnRenamed("location_id", "_cell")

    def mean(name: str, column: str):
        n = F.sum(f"_n_{column}")
        return (F.sum(F.col(name) * F.col(f"_n_{column}")) / F.nullif(n, F.lit(0))).alias(name)

    return snapped.select("location_id", "_cell").join(cells, "_cell").groupBy("location_id").agg(
        mean("mslp_hpa_mean", "mslp_hpa"), F.min("mslp_hpa_min").alias("mslp_hpa_min"),
        mean("era5_wind_speed_ms_mean", "wind_speed_ms"), F.max("era5_wind_speed_ms_max").alias("era5_wind_speed_ms_max"),
    )


def climate_by_cell(locations: DataFrame, grid: DataFrame) -> DataFrame:
    """The same statistics without the (location, timestamp) rows.

    Locations in one cell share its history, so the grid is reduced to one row
    per cell before it meets the locations: the join input shrinks from
    timestamps x cells to cells. Locations in a cell without data drop out.
    """
    cells = grid.groupBy(grid_key("lat", "lon").alias("_cell")).agg(
        *[f().alias(n) for n, f in CLIMATE_AGGREGATES.items()]
    )
    snapped = snap_to_grid(locations.select("location_id", "lat", "lon"), grid)
    snapped = snapped.select("location_id", grid_key("grid_lat", "grid_lon").alias("_cell"))
    return snapped.join(cells, "_cell", "inner").drop("_cell")


def basin_sst(grid: DataFrame, ts: str | None = "obs_ts") -> DataFrame:
    """Mean and maximum of valid sea temperatures, per year if there is a time column."""
    valid = grid.where(labels.is_present("sst_celsius"))
    stats = [
        F.avg("sst_celsius").alias("basin_sst_celsius_mean"),
        F.max("sst_celsius").alias("basin_sst_celsius_max"),
    ]
    if ts and ts in grid.columns:
        return valid.groupBy(F.year(ts).alias("year")).agg(*stats)
    return valid.agg(*stats)


def normalise_grid(raw: DataFrame) -> DataFrame:
    """Kelvin to Celsius, Pa to hPa, wind vector to speed, standard names.

    Rows in which all three measurements are missing are dropped.
    """
    names = {"latitude": "lat", "longitude": "lon"}
    names["valid_time" if "valid_time" in raw.columns else "time"] = "timestamp"
    renamed = raw.withColumnsRenamed({k: v for k, v in names.items() if k in raw.columns})
    out = renamed.select(
        "lat",
        "lon",
        "timestamp",
        (labels.null_if_nan("sst") - 273.15).alias("sst_celsius"),
        (labels.null_if_nan("msl") / 100.0).alias("mslp_hpa"),
        F.sqrt(F.pow(labels.null_if_nan("u10"), 2) + F.pow(labels.null_if_nan("v10"), 2)).alias("wind_speed_ms"),
    )
    return out.na.drop(how="all", subset=["sst_celsius", "mslp_hpa", "wind_speed_ms"])
