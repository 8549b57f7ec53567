"""Guards, defaults and lineage cuts shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require_columns(df: DataFrame, needed, table: str = "input") -> DataFrame:
    """Raise with the full list of missing columns; runs no job."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{table} is missing required columns: {missing}")
    return df


def add_default_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add each absent column as a constant, leave present ones alone."""
    absent = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def short_list(df: DataFrame, column: str, limit: int, what: str):
    """Sorted distinct values of a column as a scalar array; more than ``limit`` of them is an error.

    At most ``limit + 1`` values reach the task that builds the array.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1)
    found = values.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(column)).alias("v"))
    kind = dict(found.dtypes)["v"]
    refuse = F.raise_error(F.lit(f"{column} has more than {limit} values: not {what}")).cast(kind)
    return found.select(F.when(F.col("n") <= limit, F.col("v")).otherwise(refuse)).scalar()


def shared_folder(spark: SparkSession) -> str:
    """A fresh sub-folder of the cluster's checkpoint folder.

    Only a session that names none (a unit test) gets a machine-local one.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/perilframe-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared folder and read it back.

    Survives the loss of executors, and makes later steps start from stored rows.
    """
    path = shared_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """Tasks for work whose input is small but whose join output is not.

    One more than the shuffle setting: with equal numbers Spark drops such a
    repartition behind an aggregate on the same columns as redundant, and then
    merges the small shuffle that is left into a single task.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism) + 1


def tasks_for(df: DataFrame, rows: int = 250_000) -> int | None:
    """Tasks so that one has about ``rows`` rows of a stored table; None where that is no more than one a core.

    Spark's shuffles have a fixed number of partitions, whose sorts and hash tables grow with the data.
    """
    wanted = -(-df.count() // rows)  # from the files' footers
    return wanted if wanted > df.sparkSession.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by the keys over so many tasks; as it is where none are named."""
    return df.repartition(tasks, *keys) if tasks else df
