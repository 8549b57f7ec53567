"""Global order without a global sort in one task.

Everything here works on distinct values with their weights, cut into value
ranges of similar size. Range totals are prefix-summed (a few rows), then each
range is finished on its own. A value that occurs in a third of all rows is one
row after the map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def range_edges(df: DataFrame, value: str, ranges: int = RANGES) -> list:
    """At most ``ranges - 1`` ascending cut points; a fixed-size result.

    Numbers and times take them from one approximate-quantile aggregate, other
    types from a small row sample in hash order. The cuts only balance the work;
    results do not depend on them.
    """
    kind = dict(df.dtypes)[value]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp") or kind.startswith("decimal"):
        marks = [i / ranges for i in range(1, ranges)]
        found = df.agg(F.percentile_approx(value, marks, 10 * ranges)).first()[0] or []
    else:
        sample = df.where(F.col(value).isNotNull()).orderBy(F.xxhash64(*df.columns)).select(value).limit(32 * ranges)
        seen = sorted(r[0] for r in sample.collect())
        found = [seen[len(seen) * i // ranges] for i in range(1, ranges)] if seen else []
    return sorted(set(found))


def range_of(value, edges: list):
    """Number of edges below the value: 0 .. len(edges)."""
    if not edges:
        return F.lit(0)
    cuts = F.array(*[F.lit(e) for e in edges])
    return F.size(F.filter(cuts, lambda e: e < value))


def running_totals(values: DataFrame, value: str, sums: list[str], edges: list | None = None) -> DataFrame:
    """Add ``before_<s>``: the total of each sum column over all smaller values.

    ``values`` must have one row per value.
    """
    edges = range_edges(values, value) if edges is None else edges
    cut = values.withColumn("_range", range_of(F.col(value), edges))
    per_range = cut.groupBy("_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    # At most RANGES rows: the only window without a partition key.
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = per_range.select(
        "_range", *[F.coalesce(F.sum(f"_t_{s}").over(ahead), F.lit(0)).alias(f"_s_{s}") for s in sums]
    )
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(F.broadcast(start), "_range")
    return out.withColumns(
        {f"before_{s}": F.col(f"_s_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}
    ).drop("_range", *[f"_s_{s}" for s in sums])


def value_counts(df: DataFrame, value: str, extra: dict | None = None) -> DataFrame:
    """One row per non-missing value: ``n`` and any further sums."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(value).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in (extra or {}).items()])


def positions(df: DataFrame, key: str, by: str | None = None, edges: list | None = None) -> DataFrame:
    """Add ``position``: 0-based rank by a unique ``key``, inside each ``by`` group if given.

    A large group is numbered by many tasks, since each key range is numbered on
    its own and shifted by the count of the ranges before it.
    """
    groups = [by] if by else []
    edges = range_edges(df, key) if edges is None else edges
    cut = df.withColumn("_range", range_of(F.col(key), edges))
    counts = cut.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(*groups, "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*groups, "_range").orderBy(key)
    numbered = cut.withColumn("_row", F.row_number().over(inside))
    out = numbered.join(start, [*groups, "_range"])
    return out.withColumn("position", (F.col("_start") + F.col("_row") - 1).cast("long")).drop(
        "_start", "_row", "_range"
    )


def sequential_ids(df: DataFrame, major: str, minor: str, pattern: str = "CLM%08d", name: str = "claim_id") -> DataFrame:
    """Formatted running number over the order (major, minor); the pair must be unique.

    Three sums make the number: rows of smaller majors, rows of smaller ranges of
    the same major, rows before it in its own range.
    """
    within = positions(df, minor, by=major)
    per_major = df.groupBy(major).agg(F.count("*").alias("n"))
    offset = running_totals(per_major, major, ["n"]).select(major, F.col("before_n").alias("_offset"))
    out = within.join(offset, major)
    number = F.col("_offset") + F.col("position") + 1
    return out.withColumn(name, F.format_string(pattern, number)).drop("_offset", "position")


def exact_quantiles(df: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """(quantile, value) with linear interpolation between neighbouring ranks; exact at any size."""
    return column_quantiles(df, [value], quantiles).select("quantile", "value")


def column_quantiles(df: DataFrame, columns: list[str], quantiles: list[float]) -> DataFrame:
    """(feature, quantile, value) for several numeric columns over one set of distinct values.

    Only the distinct values around each rank are looked at; no column passes
    through one task. Each column has its own ranges.
    """
    doubles = {c: F.col(c).cast("double") for c in columns}
    marks = [i / RANGES for i in range(1, RANGES)]
    found = df.agg(*[F.percentile_approx(x, marks, 10 * RANGES).alias(c) for c, x in doubles.items()]).first()
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), x.alias("_v")) for c, x in doubles.items()])
    counts = df.select(F.inline(cells)).where(F.col("_v").isNotNull()).groupBy("feature", "_v").agg(F.count("*").alias("n"))
    place = F.lit(0)
    for c in columns:
        place = F.when(F.col("feature") == c, range_of(F.col("_v"), sorted(set(found[c] or [])))).otherwise(place)
    cut = counts.withColumn("_range", place)
    # One row per column and range.
    per_range = cut.groupBy("feature", "_range").agg(F.sum("n").alias("_n"))
    whole = Window.partitionBy("feature")
    ahead = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = per_range.select(
        "feature", "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("_size")
    )
    inside = Window.partitionBy("feature", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.join(F.broadcast(start), ["feature", "_range"])
    placed = placed.withColumn("_first", F.col("_start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile")
    rows = placed.select("feature", "_v", "n", "_first", "_size", wanted).withColumn("_at", F.col("quantile") * (F.col("_size") - 1))
    last = F.col("_first") + F.col("n") - 1
    near = rows.where((F.floor("_at") <= last) & (F.ceil("_at") >= F.col("_first")))
    ends = near.groupBy("feature", "quantile", "_at").agg(
        F.min(F.when(F.floor("_at") <= last, F.col("_v"))).alias("_lo"),
        F.max(F.when(F.ceil("_at") >= F.col("_first"), F.col("_v"))).alias("_hi"),
    )
    share = F.col("_at") - F.floor("_at")
    return ends.select("feature", "quantile", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias("value"))


def dedupe_keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by the order columns.

    An aggregate, not a window: copies of a hot key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(latest).select(*keys, "_row.*").select(*df.columns)
