"""Writers: idempotent upserts by partition, table overwrite, report export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import dedupe_keep_last
from ..operators.support import cut_lineage

STAMP = "_ingested_at"


def merge_loads(
    existing: DataFrame | None, new: DataFrame, keys: list[str] | None = None, order: list[str] | None = None
) -> DataFrame:
    """Union of stored and new rows with the last row per key kept.

    Without keys, whole-row duplicates are dropped. A later load wins over an
    earlier one; inside a load the greatest by ``order`` wins, then by content,
    since rows of a distributed table have no position of their own.
    """
    stamped = new.withColumns({STAMP: F.current_timestamp(), "_load": F.lit(1)})
    both = stamped if existing is None else existing.withColumn("_load", F.lit(0)).unionByName(stamped, allowMissingColumns=True)
    keys = keys or [c for c in new.columns]
    rest = [c for c in both.columns if c not in keys and c not in (STAMP, "_load")]
    return dedupe_keep_last(both, keys, ["_load", STAMP, *(order or []), *rest]).drop("_load")


def upsert_partitions(df: DataFrame, path: str, keys: list[str], partition: str, order: list[str] | None = None, limit: int = 10_000) -> None:
    """Upsert that reads and rewrites only the partitions a load touches; empty input is refused.

    ``partition`` must be one of the keys, so that a row never changes its
    partition. The cost follows the load, not the table. The merged partitions are
    first stored aside, then replace the old ones; running the same load again
    after a failure completes it. A load of more than ``limit`` partitions is refused: split it.
    """
    if partition not in keys:
        raise ValueError("the partition column must be one of the keys")
    spark = df.sparkSession
    touched = [r[0] for r in df.select(partition).distinct().limit(limit + 1).collect()]
    if not touched:
        raise ValueError(f"refusing to write an empty table to {path}")
    if len(touched) > limit:
        raise ValueError(f"a load touches more than {limit} partitions")
    stored = _stored(spark, path)
    if stored is not None:
        kind = dict(df.dtypes)[partition]
        stored = stored.withColumn(partition, F.col(partition).cast(kind)).where(F.col(partition).isin(touched))
    merged = cut_lineage(merge_loads(stored, df, keys, order))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


BUCKET = "_bucket"


def upsert(df: DataFrame, path: str, keys: list[str] | None = None, order: list[str] | None = None, buckets: int = 64) -> None:
    """Upsert of a table without a natural partition: rows are dealt into ``buckets`` by a hash of their keys (or of the whole row).

    Take the same number of buckets for each load of a table.
    """
    keys = keys or list(df.columns)
    dealt = df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    upsert_partitions(dealt, path, [*keys, BUCKET], BUCKET, order, max(buckets, 1))


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None before the first load."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a derived parquet table, optionally partitioned (for year-range pruning).

    With partitions, rows are rebalanced by partition value: adaptive execution gives a small value one file and splits a
    large one over several tasks, by bytes.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """Export a result table as JSON lines or CSV with a header."""
    writer = df.write.mode("overwrite")
    if kind == "json":
        writer.json(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown report kind {kind}")
