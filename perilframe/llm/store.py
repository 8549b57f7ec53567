"""Stored intermediate tables and stable document keys."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a session without one (a test) gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="perilframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_scopes: list[list[str]] = []  # of ``condensed`` calls that are under way, the paths stored in each


def stored(df: DataFrame, compression: str = "snappy", release: bool = False) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back: later steps, and retried tasks, start from it.

    With ``release`` the shuffle files behind it are given up at once: nothing reads them any more, but Spark removes them only
    when the driver happens to collect its garbage, which in a long job can be after the disks are full.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{checkpoint_root(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    if _scopes:
        _scopes[-1].append(path)
    if release:
        del df  # it holds on to its shuffles; so would a variable of the caller
        for _ in range(2):
            gc.collect()
            time.sleep(1)  # a thread of its own tells the JVM of objects that are gone
            spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def condensed(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of ``build()``; the tables that were stored on the way to it are removed."""
    _scopes.append([])
    try:
        out = [build()]
    finally:
        paths = _scopes.pop()
    try:
        return stored(out.pop(), release=True)
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            place.getFileSystem(conf).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def held_out(modulus: int, column: str = "doc_id"):
    """True where crc32 of the id as text is divisible by ``modulus``; a null id is trained on."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == 0, F.lit(False))


def with_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(documents with columns ``key`` and ``text``, one row a key; the input with its ``llm_key``; whether ids are keys).

    Where ids are unique and not null, the key is the id. Otherwise keys number the distinct (doc_id, text) rows in the
    order of doc_id, nulls first, then of a hash of the text: rows that share an id are different documents, equal rows
    are one document whose result each of them gets.
    """
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    twice = docs.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull())
    if twice.isEmpty():
        return docs.select(F.col("doc_id").alias("key"), "text"), docs.withColumn("llm_key", F.col("doc_id")), True
    rows = docs.withColumn("llm_h", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()))
    ids = rows.select("doc_id", "llm_h").distinct()
    ordered = stored(ids.repartitionByRange(F.col("doc_id").asc_nulls_first(), "llm_h").withColumn("part", F.spark_partition_id()))
    before = ordered.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "llm_h"))
    numbered = stored(ordered.withColumn("n", rank).join(before, "part").select("doc_id", "llm_h", (F.col("before") + F.col("n")).alias("llm_key")))
    r, n = rows.alias("r"), numbered.alias("n")
    full = r.join(n, F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("r.llm_h") == F.col("n.llm_h"))).select(*(F.col(f"r.{c}") for c in docs.columns), "llm_key")
    return full.select(F.col("llm_key").alias("key"), "text").dropDuplicates(["key"]), full, False


def give_back(out: DataFrame, full: DataFrame, plain: bool) -> DataFrame:
    """Replace ``key`` by ``doc_id``, once for each input row."""
    if plain:
        return out.withColumnRenamed("key", "doc_id")
    return full.select(F.col("llm_key").alias("key"), "doc_id").join(out, "key").drop("key")
