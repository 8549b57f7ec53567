"""Readers of the raw feeds: track text, index text, fire CSV, series JSON, documents, parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import ocean_phase
from ..operators.ranking import dedupe_keep_last
from ..operators.support import require_columns

# Fixed format: a storm header line starts with this id.
HEADER_ID = r"^[A-Z]{2}\d{6}$"
# Fixed sentinel of an unknown wind or pressure.
UNKNOWN = -999

FIRE_COLUMNS = T.StructType(
    [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("acq_date", T.DateType()),
        T.StructField("acq_time", T.StringType()),
        T.StructField("satellite", T.StringType()),
        T.StructField("instrument", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("frp", T.DoubleType()),
    ]
)
SERIES_SCHEMA = "series_id string, series_name string, observations array<struct<date:string, value:string>>"
DOCUMENT_SUFFIXES = ("md", "txt", "json")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; ``columns`` become the read schema and are checked first."""
    df = spark.read.parquet(path)
    return require_columns(df, columns, path).select(*columns) if columns else df


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One table from many files, columns matched by name, absent ones NULL; nothing is dropped."""
    if not paths:
        raise ValueError("no input files")
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Best-track text files to one row per observation.

    Files are read in splits, as any text. A data line takes the last header line before it: within its split by a window,
    and where the split has none before it, from the splits ahead of it in its file, of which only the last header of each is
    looked at. Data before the first header of a file is an error. Repeated (storm, time) rows keep the last.
    """
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_line"), F.col("value").alias("_text"),
    )
    return track_rows(text)


def parse_tracks(files: DataFrame) -> DataFrame:
    """The same from (file, text) rows."""
    return track_rows(files.select("file", F.lit(0).alias("_split"), F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("_line", "_text")))


def track_rows(text: DataFrame) -> DataFrame:
    """Observations from lines (file, _split, _line, _text); lines are numbered in order within a split, splits within a file."""
    lines = text.where(F.trim("_text") != "").withColumn("_f", F.transform(F.split("_text", ","), lambda x: F.trim(x)))
    is_header = (F.size("_f") > 1) & F.col("_f")[0].rlike(HEADER_ID)
    lines = lines.withColumn("_own", F.when(is_header, F.struct(F.col("_f")[0].alias("id"), F.col("_f")[1].alias("name"))))
    last = lines.groupBy("file", "_split").agg(F.max(F.when(is_header, F.struct("_line", "_own"))).alias("_last"))
    ahead = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file", "_split", F.last("_last", ignorenulls=True).over(ahead)["_own"].alias("_carried"))
    so_far = Window.partitionBy("file", "_split").orderBy("_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("_head", F.last("_own", ignorenulls=True).over(so_far)).where(F.col("_own").isNull())
    lines = lines.join(carried, ["file", "_split"]).withColumn("_head", F.coalesce("_head", "_carried"))
    orphan = F.raise_error(F.concat(F.lit("track data before any header: "), F.col("_text"))).cast("string")
    lines = lines.withColumns({"storm_id": F.when(F.col("_head").isNotNull(), F.col("_head.id")).otherwise(orphan), "name": F.col("_head.name")})
    f = F.col("_f")

    def degrees(i: int):
        size = F.regexp_extract(f[i], r"^[0-9.]+", 0).cast("double")
        return F.when(F.right(f[i], F.lit(1)).isin("S", "W"), -size).otherwise(size)

    def known(i: int):
        value = f[i].cast("int")
        return F.when(value != UNKNOWN, value)

    at = F.to_timestamp_ntz(F.concat(f[0], f[1]), F.lit("yyyyMMddHHmm"))
    rows = lines.select(
        "storm_id", "name", at.alias("obs_ts"), f[3].alias("status"), degrees(4).alias("lat"), degrees(5).alias("lon"),
        known(6).alias("max_wind_kt"), known(7).alias("min_pressure_mb"), "file", "_split", "_line",
    )
    last = dedupe_keep_last(rows, ["storm_id", "obs_ts"], ["file", "_split", "_line"])
    return last.drop("file", "_split", "_line")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width ocean index: season 1-6, year 7-10, total 11-17, anomaly 18-23, one header line per file."""
    lines = spark.read.text(path)
    cut = lines.select(
        F.trim(F.substring("value", 1, 6)).alias("season"),
        F.trim(F.substring("value", 7, 4)).try_cast("int").alias("year"),
        F.trim(F.substring("value", 18, 6)).try_cast("double").alias("oni_anomaly_celsius"),
    )
    # The header has no number in the anomaly columns, so it goes with the empty rows.
    valid = cut.where(F.col("oni_anomaly_celsius").isNotNull() & ~F.isnan("oni_anomaly_celsius"))
    return valid.select("year", "season", "oni_anomaly_celsius", ocean_phase("oni_anomaly_celsius").alias("enso_phase"))


def read_fires(spark: SparkSession, path: str) -> DataFrame:
    return normalise_fires(spark.read.option("header", True).schema(FIRE_COLUMNS).csv(path))


def normalise_fires(raw: DataFrame) -> DataFrame:
    """Fire rows with a UTC time from date and HHMM (907 is 09:07); optional columns are kept when present."""
    hhmm = F.lpad(F.col("acq_time").cast("string"), 4, "0")
    minutes = F.substring(hhmm, 1, 2).cast("int") * 60 + F.substring(hhmm, 3, 2).cast("int")
    at = F.col("acq_date").cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    keep = [c for c in ("confidence", "frp", "satellite", "instrument") if c in raw.columns]
    return raw.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), at.alias("timestamp"), *keep)


def read_series(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Series payloads, one JSON document per line (or per file): observations unrolled, "." is missing."""
    docs = spark.read.schema(SERIES_SCHEMA).option("multiLine", multi_line).json(path)
    rows = docs.select("series_id", "series_name", F.explode("observations").alias("o"))
    return rows.select(
        "series_id", "series_name", F.col("o.date").cast("date").alias("date"),
        F.col("o.value").try_cast("double").alias("value"),
    )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(source, title, text) of every .md, .txt and .json file below a folder.

    ``source`` is the path below the folder, ``title`` the file name without suffix.
    """
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(DOCUMENT_SUFFIXES) + "}")
        .text(folder, wholetext=True)
    )
    path = F.url_decode(F.col("_metadata.file_path"))
    below = F.element_at(F.split(path, F.lit("/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/")), -1)
    name = F.element_at(F.split(path, "/"), -1)
    return files.select(
        below.alias("source"), F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), F.col("value").alias("text")
    )
