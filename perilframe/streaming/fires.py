"""Streaming ingest of the active-fire feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import as_instant
from ..sources.readers import FIRE_COLUMNS, normalise_fires
from ..sources.writers import upsert_partitions

KEYS = ["lat", "lon", "timestamp"]


def fire_stream(spark: SparkSession, folder: str, late: str = "5 days", files_per_batch: int | None = None) -> DataFrame:
    """New CSV files as a stream of normalised fires, first row per key within the watermark."""
    reader = spark.readStream.option("header", True).schema(FIRE_COLUMNS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    fires = normalise_fires(reader.csv(folder))
    fires = fires.withColumn("timestamp", as_instant(fires, "timestamp"))
    return fires.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(KEYS)


def ingest_fires(
    spark: SparkSession, folder: str, target: str, checkpoint: str, late: str = "5 days", files_per_batch: int | None = None
) -> StreamingQuery:
    """Append all files not yet seen to the parquet table at ``target`` and stop.

    The checkpoint holds the file list and the key state, so a second run adds
    nothing, and a restarted one does not repeat a committed batch.
    """
    stream = fire_stream(spark, folder, late, files_per_batch)
    return (
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def upsert_fires(spark: SparkSession, folder: str, root: str, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """The same feed with the last row per key kept, in a table partitioned by ``day``.

    The time is part of the key, so a micro-batch reads and rewrites only the days it brings rows for. A batch that is repeated after
    a failure finds its own rows and changes nothing.
    """
    reader = spark.readStream.option("header", True).schema(FIRE_COLUMNS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def load(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert_partitions(batch.withColumn("day", F.to_date("timestamp")), root, [*KEYS, "day"], "day")

    return (
        normalise_fires(reader.csv(folder)).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
