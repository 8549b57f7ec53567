"""Radius join, nearest-neighbour pairs, grid snapping, nearest reference point."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.times import utc_seconds
from . import celltree
from .support import require_columns, short_list, task_count

LEAF_ROWS = 512  # left rows of a key
SHARE_ROWS = 16_384  # right rows of a key, on average
COPIES = 16  # of a row, about: leaves of right rows grow beyond LEAF_ROWS and shares beyond SHARE_ROWS before there are more


def radius_join(
    left: DataFrame,
    right: DataFrame,
    radius_km: float,
    left_pos=("lat", "lon"),
    right_pos=("track_lat", "track_lon"),
    reach: str | None = None,
    most: int = LEAF_ROWS,
    share: int = SHARE_ROWS,
    totals: str | None = None,
) -> DataFrame:
    """All (left, right) pairs within ``radius_km``, plus ``distance_km``.

    An equi-join on the leaves of a cell tree over the left positions (see ``celltree``), with an exact check behind it. A left
    row is in one leaf; a right row goes to the leaves that its circle touches, so it is copied about once for ``most`` left
    rows in its reach. A position with more left rows than that is dealt over parts, and a leaf with more than
    ``share`` right rows over shares, into which its left rows are repeated: no key holds much more than ``most`` x ``share``
    pairs, and the number of keys grows with the data. Parts and shares follow from a hash of the whole row. No job runs
    here, nothing is broadcast on purpose, and both sides spill where they must.

    Where reaches are wide, copies would grow with the data. So the copies of one right row in 64 are counted, and leaves are made larger
    in proportion until a right row has about ``COPIES``; a leaf has as many shares at most. The pairs stay the same, and keys then hold more.

    ``reach`` names a right column with that row's own, smaller radius in km. Rows without a position meet nothing.
    Pairs are as many as the data holds; callers aggregate them, which Spark begins in the tasks that make them. With ``totals``, "left" or
    "right", that is done where the pairs are found: (the columns of that side, pairs, total_km, nearest_km) come out, several rows for
    a row of it, and the same row, or equal ones, have to be added up. The keys are those of the pairs, but rows of a key meet in tiles.
    """
    if totals and (reach or totals not in ("left", "right")):
        raise ValueError("totals are those of the left or the right rows, and at one radius")
    vec = ("_vx", "_vy", "_vz")
    lv = dict(zip((f"_l{c}" for c in vec), geo.unit_vector(*left_pos)))
    rv = dict(zip((f"_r{c}" for c in vec), geo.unit_vector(*right_pos)))
    own_km = F.least(F.col(reach), F.lit(float(radius_km))) if reach else F.lit(float(radius_km))
    start = celltree.start_level(radius_km)
    known = lambda df, pos: df.where(F.col(pos[0]).isNotNull() & F.col(pos[1]).isNotNull())

    placed = known(left, left_pos).withColumns({**celltree.fine_cell(*left_pos, start), "_lhash": F.xxhash64(*left.columns)})
    counts = celltree.fine_counts(placed)
    circles = known(right, right_pos).withColumns({**celltree.box_of(*right_pos, own_km), "_rhash": F.xxhash64(*right.columns)})
    some = circles.where(F.pmod("_rhash", F.lit(64)) == 0).select("_lat", "_lon", "_rho", "_half")
    sent = celltree.cover(some, celltree.leaves(counts, most), start).agg(F.sum("_parts")).scalar()
    copies = F.coalesce(sent / F.nullif(some.agg(F.count("*")).scalar(), F.lit(0)), F.lit(1.0))
    most = F.ceil(most * F.greatest(copies / COPIES, F.lit(1.0)))
    tree = celltree.leaves(counts, most)
    tasks = 3 * task_count(left.sparkSession)  # keys are of unequal work: let tasks be many
    covered = celltree.cover(circles.repartition(tasks, "_rhash"), tree, start).drop("_lat", "_lon", "_rho", "_half")
    crowds = celltree.cover(celltree.crowds(circles, start), tree, start)  # a little too many, and far fewer rows
    shares = crowds.groupBy("_leaf").agg(F.least(F.ceil(F.sum("n") / share), F.lit(COPIES)).cast("int").alias("_shares"))

    a = placed.join(celltree.leaf_of_cells(counts, tree), ["_y", "_x"]).drop("_y", "_x").join(shares, "_leaf")
    a = a.withColumns({"_part": F.pmod("_lhash", F.col("_parts")).cast("int"), "_share": F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))})
    b = covered.join(shares, "_leaf")
    b = b.withColumns({"_share": F.pmod("_rhash", F.col("_shares")).cast("int"), "_part": F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))})
    key = ["_leaf", "_part", "_share"]
    a = a.drop("_parts", "_shares", "_lhash").withColumns(lv).repartition(tasks, *key)  # a fixed number: adaptive execution leaves it as it is
    b = b.drop("_parts", "_shares", "_rhash").withColumns(rv)
    if totals:
        return _pair_totals(a, b.repartition(tasks, *key), key, radius_km, left if totals == "left" else right, totals == "left")
    if reach:
        b = b.withColumn("_limit", geo.chord_sq_limit(F.least(F.col(reach), F.lit(float(radius_km)))))
    gap = geo.chord_sq([f"_l{c}" for c in vec], [f"_r{c}" for c in vec])
    limit = F.col("_limit") if reach else geo.chord_sq_limit(F.lit(float(radius_km)))
    # merge, with the few left rows of a key as the buffered side; a broadcast would leave all pairs to the other side's tasks
    pairs = b.join(a.hint("merge"), key).withColumn("_gap", gap).where(F.col("_gap") <= limit)
    pairs = pairs.withColumn("distance_km", geo.chord_sq_to_km(F.col("_gap"), radius_km))
    return pairs.select(*left.columns, *right.columns, "distance_km")


TILE_ROWS = 512, 4096  # left and right rows that meet as one row of the join: two to the 21st pairs
BLOCK = 128, 256  # pairs measured at a time, so that their matrices stay in a core's cache


def _pair_totals(a: DataFrame, b: DataFrame, key: list[str], radius_km: float, wanted: DataFrame, of_left: bool) -> DataFrame:
    """Pairs of the rows of a key, their kilometres and the least of them, per row of the ``wanted`` side and tile of the other."""

    def tiles(df: DataFrame, vec: list[str], rows: int, name: str, own: list[str]) -> DataFrame:
        """Up to ``rows`` rows of a key as one; the key's tasks stay as they are."""
        number = F.row_number().over(Window.partitionBy(*key).orderBy(*vec)) - 1  # neighbours in space side by side
        cut = df.withColumn("_tile", F.floor(number / rows))
        return cut.groupBy(*key, "_tile").agg(F.collect_list(F.struct(*own, *vec)).alias(name)).drop("_tile")

    lv, rv = (["_" + side + c for c in ("_vx", "_vy", "_vz")] for side in "lr")
    left = tiles(a, lv, TILE_ROWS[0], "_a", wanted.columns if of_left else [])
    right = tiles(b, rv, TILE_ROWS[1], "_b", [] if of_left else wanted.columns)
    mine, other, mv, ov = ("_a", "_b", lv, rv) if of_left else ("_b", "_a", rv, lv)

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                x, y = (batch.column(c)[n].values for c in (mine, other))
                sums = geo.distance_totals(*(np.stack([t.field(c).to_numpy(zero_copy_only=False) for c in v], axis=1) for t, v in ((x, mv), (y, ov))), radius_km, BLOCK)
                seen = np.flatnonzero(sums[:, 0])
                if len(seen):
                    found = x.take(pa.array(seen))
                    columns = [*(found.field(c) for c in wanted_names), pa.array(sums[seen, 0].astype(np.int64)), *(pa.array(sums[seen, c]) for c in (1, 2))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*wanted_names, "pairs", "total_km", "nearest_km"])

    wanted_names = wanted.columns
    fields = ", ".join(f"`{c}` {t}" for c, t in wanted.dtypes)
    met = right.join(left.hint("merge"), key).select("_a", "_b")
    return met.mapInArrow(run, f"{fields}, pairs long, total_km double, nearest_km double")


SITE = ("lat", "lon")
SEARCH_ROWS = 64  # sites of a leaf in which a search radius is looked for


def sites_of(locations: DataFrame) -> DataFrame:
    """Distinct positions: any number of locations at one position is one site."""
    return locations.select(*SITE).where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct()


def to_locations(locations: DataFrame, per_site: DataFrame) -> DataFrame:
    """Hand the result of each site to all locations that stand on it."""
    return locations.select("location_id", *SITE).join(per_site, list(SITE)).drop(*SITE)


def nearest_axis_value(value, axis):
    """Closest element of an array; ties go to the lower value, outside goes to the edge."""
    best = F.array_min(F.transform(axis, lambda a: F.struct(F.abs(a - value).alias("d"), a.alias("v"))))
    return best.getField("v")


def snap_to_grid(locations: DataFrame, grid: DataFrame, max_axis_values: int = 20_000) -> DataFrame:
    """Add ``grid_lat`` and ``grid_lon``: per axis, the nearest value that occurs in the grid.

    The axes are grid lines (hundreds of values), read with one pruned scan and
    handed to the rows as scalar subqueries. An input that is no grid, with more
    lines than ``max_axis_values``, is refused instead of collected.
    """
    require_columns(locations, ["lat", "lon"], "locations")

    def axis(column: str):
        return short_list(grid, column, max_axis_values, "a grid axis")

    lined = locations.withColumns({"_lats": axis("lat"), "_lons": axis("lon")})
    snapped = {
        "grid_lat": nearest_axis_value(F.col("lat"), F.col("_lats")),
        "grid_lon": nearest_axis_value(F.col("lon"), F.col("_lons")),
    }
    return lined.withColumns(snapped).drop("_lats", "_lons")


def to_millimetres(km):
    """Distances are ranked at 1 mm, so that float noise does not decide between equals."""
    return F.floor(km * 1e6 + 0.5) / 1e6


def grid_key(lat, lon):
    """Integer cell key (1e-4 degree), so that joins do not compare floats."""
    return F.round(F.col(lat) * 10000).cast("long") * F.lit(10_000_000) + F.round(F.col(lon) * 10000).cast("long")


GRID_PAIRS = 1 << 23  # joined rows of a cell, beyond which its grid rows are dealt over shares


def grid_join(locations: DataFrame, grid: DataFrame, pairs: int = GRID_PAIRS) -> DataFrame:
    """One row per (location, grid timestamp); locations whose cell holds no data drop out.

    The result is far larger than both tables, so they are dealt by cell over tasks of their own and joined cell by cell:
    a task writes the locations of one cell again and again, which a column store keeps in a fraction of the space that
    the same rows take in the order of the grid. Grid rows of a cell with more than ``pairs`` joined rows are dealt over
    shares, its locations copied to each, ``COPIES`` at most.
    """
    tasks = task_count(grid.sparkSession)  # a fixed number: adaptive execution leaves it as it is
    snapped = snap_to_grid(locations.repartition(tasks), grid).withColumn("_cell", grid_key("grid_lat", "grid_lon"))
    cells = grid.withColumns({"_cell": grid_key("lat", "lon"), "_hash": F.xxhash64(*grid.columns)}).drop("lat", "lon")
    crowds = snapped.groupBy("_cell").agg(F.count("*").alias("_n")).join(cells.groupBy("_cell").agg(F.count("*").alias("_m")), "_cell")
    shares = F.least(F.ceil(F.col("_n") * F.col("_m") / pairs), F.lit(COPIES)).cast("int")
    crowded = F.broadcast(crowds.select("_cell", shares.alias("_shares")).where("_shares > 1"))  # one in thousands of rows
    left, right = (df.join(crowded, "_cell", "left").withColumn("_shares", F.coalesce("_shares", F.lit(1))) for df in (cells, snapped))
    left = left.withColumn("_share", F.pmod("_hash", F.col("_shares")).cast("int")).drop("_shares", "_hash")
    right = right.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    key = ["_cell", "_share"]
    return left.repartition(tasks, *key).join(right.hint("merge"), key).drop(*key)  # the locations of a cell are the buffered side


def snap_coverage(locations: DataFrame, grid: DataFrame) -> DataFrame:
    """One row: locations, those with grid data, and the unmatched share in percent."""
    snapped = snap_to_grid(locations, grid).withColumn("_cell", grid_key("grid_lat", "grid_lon"))
    present = grid.select(grid_key("lat", "lon").alias("_cell")).distinct().withColumn("hit", F.lit(1))
    joined = snapped.join(present, "_cell", "left")
    out = joined.agg(F.count("*").alias("locations"), F.count("hit").alias("matched"))
    share = F.round((F.col("locations") - F.col("matched")) * 100 / F.expr("nullif(locations, 0)"), 4)
    return out.withColumn("unmatched_pct", share)


# Simplified Gulf and Florida shoreline, west-to-east along each part.
SHORELINE = [
    (30.0, -88.0), (30.3, -87.5), (30.4, -87.0), (30.2, -86.5), (29.9, -85.5), (29.8, -84.5),
    (29.6, -83.5), (29.2, -82.5), (28.5, -82.0), (27.8, -82.0), (26.5, -82.0), (25.5, -81.0),
    (25.2, -80.5), (25.0, -80.0), (24.5, -81.5), (25.0, -97.0), (26.0, -97.0), (27.0, -97.5),
    (28.0, -96.5), (29.0, -95.0), (29.8, -94.0), (30.0, -93.5), (29.5, -92.0), (29.0, -90.0),
]


def distance_to_coast(locations: DataFrame) -> DataFrame:
    """Add ``distance_to_coast_km``; a projection, no join and no shuffle."""
    return locations.withColumn(
        "distance_to_coast_km", geo.nearest_point_km(F.col("lat"), F.col("lon"), SHORELINE)
    )


PACKED_KM = 1000.0  # as many millimetres, and a second, fit in one bigint


def storm_distances(tracks: DataFrame, locations: DataFrame, radius_km: float = 500.0) -> DataFrame:
    """Closest approach of each storm to each location in reach, with wind and pressure there.

    Observations of a storm at one position are folded to the earliest first, and
    distances are taken per site. The radius may be any; beyond ``PACKED_KM`` the order takes two numbers instead of one.
    """
    stamped = tracks.withColumn("_second", utc_seconds(tracks, "obs_ts"))
    obs = stamped.groupBy("storm_id", F.col("lat").alias("track_lat"), F.col("lon").alias("track_lon")).agg(
        F.min("_second").alias("_first"),
        F.min_by("max_wind_kt", "_second").alias("_wind"),
        F.min_by("min_pressure_mb", "_second").alias("_mb"),
    )
    pairs = radius_join(sites_of(locations), obs, radius_km)
    millimetres = F.floor(F.col("distance_km") * 1e6 + 0.5).cast("long")
    if radius_km <= PACKED_KM:  # one bigint orders by millimetre, then by second: primitive aggregate buffers only
        order = millimetres * F.lit(1 << 33) + F.col("_first") + F.lit(1 << 32)
        nearest = F.shiftright(F.min("_order"), 33)
    else:
        order = F.struct(millimetres.alias("mm"), F.col("_first").alias("second"))
        nearest = F.min("_order").getField("mm")
    closest = (
        pairs.withColumn("_order", order)
        .groupBy(*SITE, "storm_id")
        .agg(
            (nearest / 1e6).alias("min_distance_km"),
            F.min_by("_wind", "_order").alias("wind_at_closest_kt"),
            F.min_by("_mb", "_order").alias("pressure_at_closest_mb"),
        )
    )
    return to_locations(locations, closest)


def k_nearest(points: DataFrame, k: int = 5, radius_km: float = 100.0, id_col: str = "location_id") -> DataFrame:
    """Edges (src, dst, distance_km) to the up to ``k`` nearest other points in the radius.

    Exact, ordered by (distance, id). Points at one position are first folded to a site that carries its k+1 smallest ids, so any
    number of copies costs one row. Each site then bounds its own search: the leaf of the cell tree that holds it has few sites, and
    the (k+1)-th nearest of those (itself included) is no nearer than its true one; a site with fewer beside it in its leaf
    searches the whole radius. One radius join with these reaches finds the neighbours; no job runs here.
    """
    by_site = Window.partitionBy("lat", "lon").orderBy(id_col)
    sites = (
        points.select(id_col, "lat", "lon")
        .where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .withColumn("_n", F.row_number().over(by_site))
        .where(F.col("_n") <= k + 1)
        .groupBy("lat", "lon")
        .agg(F.array_sort(F.collect_list(id_col)).alias("ids"))
    )
    bounded = _search_radii(sites, k, radius_km)
    targets = bounded.select(F.col("lat").alias("track_lat"), F.col("lon").alias("track_lon"), "_reach")
    pairs = radius_join(sites, targets, radius_km, reach="_reach").withColumn("distance_km", to_millimetres(F.col("distance_km")))
    nearest = Window.partitionBy("track_lat", "track_lon").orderBy("distance_km", F.col("ids")[0])
    kept = pairs.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= k + 1)
    flat = kept.select(F.col("track_lat").alias("lat"), F.col("track_lon").alias("lon"), "distance_km", F.explode("ids").alias("dst"))
    near = flat.groupBy(*SITE).agg(F.slice(F.array_sort(F.collect_list(F.struct("distance_km", "dst"))), 1, k + 1).alias("near"))
    base = points.select(F.col(id_col).alias("src"), "lat", "lon")
    others = F.slice(F.filter("near", lambda x: x["dst"] != F.col("src")), 1, k)
    return base.join(near, list(SITE)).select("src", F.inline(others)).select("src", "dst", "distance_km")


def _search_radii(sites: DataFrame, k: int, radius_km: float) -> DataFrame:
    """(lat, lon, _reach): a radius in km that holds the k+1 nearest sites, or ``radius_km`` where the leaf has too few to tell."""
    most = max(SEARCH_ROWS, 4 * (k + 1))
    start = celltree.start_level(radius_km)
    placed = sites.select(*SITE).withColumns(celltree.fine_cell(*SITE, start))
    counts = celltree.fine_counts(placed)
    leaf = celltree.leaf_of_cells(counts, celltree.leaves(counts, most))
    vec = ("_vx", "_vy", "_vz")
    own = placed.join(leaf, ["_y", "_x"]).select(*SITE, "_leaf", F.pmod(F.xxhash64(*SITE), F.col("_parts")).alias("_part"), *(v.alias(c) for c, v in zip(vec, geo.unit_vector(*SITE))))
    # at most a few hundred sites share a part of a leaf
    groups = own.groupBy("_leaf", "_part").agg(F.collect_list(F.struct(*vec)).alias("_others"))
    gaps = F.array_sort(F.transform("_others", lambda o: geo.chord_sq([F.col(c) for c in vec], [o[c] for c in vec])))
    met = own.join(groups, ["_leaf", "_part"]).withColumn("_gap", F.get(gaps, F.lit(k)))
    km = geo.chord_sq_to_km(F.col("_gap")) * (1 + 1e-9) + 2e-6  # distances are ranked in whole millimetres
    return met.select(*SITE, F.least(F.coalesce(km, F.lit(float(radius_km))), F.lit(float(radius_km))).alias("_reach"))
