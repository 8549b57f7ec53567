"""Sources, sinks and the stream.

Feed files are written from the test tables into the session's shared folder and
read back through the library's readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.support import shared_folder
from ..sources import readers, writers
from ..streaming import fires
from .common import longs, rounded, tidy
from .registry import query


def utc_seconds(column):
    return F.unix_seconds(F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))


@query("a1_table_scan", "SELECT o_orderkey, o_totalprice FROM orders")
def a1(t):
    return readers.read_table(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey", "o_totalprice"])


def write_track_text(t) -> str:
    """Best-track text with one header per storm and day, so that no file needs a whole storm."""
    obs = t.tracks.withColumns(
        {"id": F.format_string("AL%02d2024", F.col("storm_id")), "day": F.date_format("obs_ts", "yyyyMMdd")}
    )

    def side(column, positive, negative):
        return F.concat(F.format_string("%.1f", F.abs(column)), F.when(F.col(column) < 0, negative).otherwise(positive))

    data = obs.select(
        "id", "day", F.col("obs_id").alias("line"),
        F.concat_ws(
            ", ", "day", F.date_format("obs_ts", "HHmm"), F.lit(" "), F.lit("HU"), side("lat", "N", "S"), side("lon", "E", "W"),
            F.col("max_wind_kt").cast("int"), F.when(F.col("obs_id") % 9 == 0, F.lit(-999)).otherwise(F.col("min_pressure_mb").cast("int")), F.lit(""),
        ).alias("value"),
    )
    heads = obs.select("id", "day").distinct().select(
        "id", "day", F.lit(-1).cast("long").alias("line"),
        F.concat("id", F.lit(",            STORM"), F.substring("id", 3, 2), F.lit(",      1,")).alias("value"),
    )
    path = shared_folder(t.spark)
    lines = heads.unionByName(data).repartition("id", "day").sortWithinPartitions("id", "day", "line")
    lines.select("value").write.text(path)
    return path


@query(
    "a2_track_text",
    """WITH m AS (SELECT storm_id, date_trunc('minute', obs_ts) AS tm, arg_max(row(obs_id, lat, lon, max_wind_kt, min_pressure_mb), obs_id) AS r FROM tracks GROUP BY 1, 2)
       SELECT printf('AL%02d2024', storm_id) AS storm_id, printf('STORM%02d', storm_id) AS name, epoch_us(tm)//1000000 AS at_s, 'HU' AS status, round(r[2], 1) AS lat, round(r[3], 1) AS lon,
              cast(r[4] AS bigint) AS max_wind_kt, case when r[1] % 9 <> 0 then cast(r[5] AS bigint) end AS min_pressure_mb FROM m""",
)
def a2(t):
    out = readers.read_tracks(t.spark, write_track_text(t))
    return tidy(out.withColumn("at_s", utc_seconds("obs_ts")).drop("obs_ts"), 1)


SEASONS = ["DJF", "JFM", "FMA", "MAM", "AMJ", "MJJ", "JJA", "JAS", "ASO", "SON", "OND", "NDJ"]
_SEASON_SQL = "case o_orderkey % 12 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(SEASONS)) + " end"


@query(
    "a3_index_text",
    f"""WITH s AS (SELECT {_SEASON_SQL} AS season, 1960 + o_orderkey % 47 AS year, floor(avg(o_totalprice)/1e3 - 15e1)/1e1 AS a FROM orders GROUP BY 1, 2)
        SELECT year, season, a AS oni_anomaly_celsius, case when a >= 5e-1 then 'el_nino' when a <= -5e-1 then 'la_nina' else 'neutral' end AS enso_phase FROM s WHERE year % 10 <> 7""",
)
def a3(t):
    names = F.array(*[F.lit(s) for s in SEASONS])
    key = F.col("o_orderkey")
    s = t.raw("orders").groupBy(
        F.element_at(names, (key % 12).cast("int") + 1).alias("season"), (1960 + key % 47).alias("year")
    ).agg((F.floor(F.avg("o_totalprice") / 1e3 - 150) / 10.0).alias("a"))
    shown = F.when(F.col("year") % 10 != 7, F.format_string("%6.1f", F.col("a"))).otherwise(F.lit("      "))
    lines = s.select(F.concat(F.format_string("%-6s%4d%7.2f", "season", "year", F.lit(26.5)), shown).alias("value"))
    head = t.raw("region").where("r_regionkey = 0").select(F.lit(" SEAS  YR  TOTAL   ANOM").alias("value"))
    path = shared_folder(t.spark)
    head.unionByName(lines).write.text(path)
    return longs(readers.read_index(t.spark, path))


def fire_rows(t):
    """Fires in the feed's own columns; HHMM is written without leading zeros."""
    return t.tracks.select(
        F.round("lat", 1).alias("latitude"), F.round("lon", 1).alias("longitude"), F.date_format("obs_ts", "yyyy-MM-dd").alias("acq_date"),
        (F.hour("obs_ts") * 100 + F.minute("obs_ts")).alias("acq_time"), F.lit("N20").alias("satellite"), F.lit("VIIRS").alias("instrument"),
        F.when(F.col("obs_id") % 5 == 0, "low").otherwise("nominal").alias("confidence"), (F.col("obs_id") % 1000 / 10).alias("frp"),
    )


_FIRE_SQL = """fires AS (SELECT round(lat, 1) AS lat, round(lon, 1) AS lon, epoch_us(date_trunc('minute', obs_ts))//1000000 AS at_s,
    case when obs_id % 5 = 0 then 'low' else 'nominal' end AS confidence, (obs_id % 1000)/10 AS frp FROM tracks)"""


@query("a4_fire_csv", f"WITH {_FIRE_SQL} SELECT lat, lon, at_s, confidence, frp, 'N20' AS satellite, 'VIIRS' AS instrument FROM fires")
def a4(t):
    path = shared_folder(t.spark)
    fire_rows(t).write.option("header", True).csv(path)
    out = readers.read_fires(t.spark, path)
    return out.withColumn("at_s", utc_seconds("timestamp")).drop("timestamp")


@query(
    "a5_series_json",
    """SELECT event_type AS series_id, upper(event_type) AS series_name, strftime(ts, '%Y-%m-%d') AS date, case when event_id % 6 <> 0 then value end AS value FROM events""",
)
def a5(t):
    value = F.when(F.col("event_id") % 6 == 0, ".").otherwise(F.col("value").cast("string"))
    payload = (
        t.raw("events")
        .groupBy(F.col("event_type").alias("series_id"), F.upper("event_type").alias("series_name"), F.expr("event_id div 50").alias("page"))
        .agg(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), value.alias("value"))).alias("observations"))
    )
    path = shared_folder(t.spark)
    payload.drop("page").write.json(path)
    return readers.read_series(t.spark, path).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "a7_many_files",
    """SELECT year(l_shipdate) AS year, count(*) AS rows, round(sum(l_extendedprice), 2) AS total,
       count(case when year(l_shipdate) >= 1999 then l_tax end) AS with_tax FROM lineitem GROUP BY 1""",
)
def a7(t):
    lines = t.raw("lineitem").withColumn("year", F.year("l_shipdate").cast("long"))
    root = shared_folder(t.spark)
    kept = lines.select("year", "l_extendedprice", "l_tax")
    kept.where("year < 1999").drop("l_tax").write.parquet(f"{root}/old")
    kept.where("year >= 1999").write.parquet(f"{root}/new")
    table = readers.read_many(t.spark, [f"{root}/old", f"{root}/new"])
    out = table.groupBy("year").agg(F.count("*").alias("rows"), F.sum("l_extendedprice").alias("total"), F.count("l_tax").alias("with_tax"))
    return rounded(out, 2)


@query(
    "a8_yearly_sums",
    """SELECT year(obs_ts) AS year, count(*) AS observations, round(sum(sst_celsius), 3) AS sst_sum, max(sst_celsius) AS sst_max FROM grid
       WHERE sst_celsius IS NOT NULL AND NOT isnan(sst_celsius) GROUP BY 1""",
)
def a8(t):
    valid = t.grid.select("obs_ts", "sst_celsius").where("sst_celsius is not null and not isnan(sst_celsius)")
    per = valid.groupBy(F.year("obs_ts").alias("year")).agg(
        F.count("*").alias("observations"), F.sum("sst_celsius").alias("sst_sum"), F.max("sst_celsius").alias("sst_max")
    )
    return tidy(per, 3)


@query(
    "a9_document_folder",
    "SELECT source, cast(sum(length(text) + 1) AS bigint) AS chars, true AS titled FROM documents GROUP BY source",
)
def a9(t):
    path = shared_folder(t.spark)
    docs = t.raw("documents").select("text", F.col("source").alias("folder"))
    docs.write.partitionBy("folder").text(path)
    found = readers.read_documents(t.spark, path)
    folder = F.regexp_extract("source", r"folder=([^/]+)/", 1)
    return found.groupBy(folder.alias("source")).agg(
        F.sum(F.length("text")).alias("chars"), F.bool_and(F.length("title") > 0).alias("titled")
    )


@query(
    "b1_bronze_upsert",
    """WITH q AS (SELECT o_orderkey AS id, o_orderstatus AS status, 0 AS ld FROM orders WHERE year(o_orderdate) <= 1999
                 UNION ALL SELECT o_orderkey, 'X', 1 FROM orders WHERE year(o_orderdate) >= 1998)
       SELECT id, arg_max(status, ld) AS status FROM q GROUP BY id""",
)
def b1_files(t):
    o = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("y"))
    root = shared_folder(t.spark)
    writers.upsert(o.where("y <= 1999").drop("y"), root, ["id"])
    writers.upsert(o.where("y >= 1998").drop("y").withColumn("status", F.lit("X")), root, ["id"])
    return writers.read_upserted(t.spark, root).select("id", "status")


@query(
    "b1_partition_upsert",
    """WITH q AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, o_orderstatus AS status, 0 AS ld FROM orders
                 UNION ALL SELECT o_orderkey, year(o_orderdate), 'X', 1 FROM orders WHERE year(o_orderdate) >= 1999 AND o_totalprice > 1e5)
       SELECT id, y, arg_max(status, ld) AS status FROM q GROUP BY id, y""",
)
def b1_partitions(t):
    o = t.raw("orders").select(
        F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("status"), "o_totalprice"
    )
    path = shared_folder(t.spark)
    writers.upsert_partitions(o.drop("o_totalprice"), path, ["id", "y"], "y")
    late = o.where((F.col("y") >= 1999) & (F.col("o_totalprice") > 1e5)).drop("o_totalprice")
    writers.upsert_partitions(late.withColumn("status", F.lit("X")), path, ["id", "y"], "y")
    return longs(t.spark.read.parquet(path).select("id", "y", "status"))


@query("b2_partitioned_table", "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1998")
def b2(t):
    o = t.raw("orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    path = shared_folder(t.spark)
    writers.write_table(o, path, ["year"])
    return t.spark.read.parquet(path).where("year between 1997 and 1998").select("o_orderkey", "o_totalprice")


_EXPORT_SQL = "SELECT region_code, count(*) AS locations, round(sum(tiv_usd), 2) AS tiv_usd FROM locations GROUP BY region_code"


def export(t):
    return t.locations.groupBy("region_code").agg(F.count("*").alias("locations"), F.round(F.sum("tiv_usd"), 2).alias("tiv_usd"))


@query("b3_json_report", _EXPORT_SQL)
def b3_json(t):
    path = shared_folder(t.spark)
    writers.write_report(export(t), path, "json")
    return t.spark.read.schema("region_code int, locations long, tiv_usd double").json(path)


@query("b3_csv_report", _EXPORT_SQL)
def b3_csv(t):
    path = shared_folder(t.spark)
    writers.write_report(export(t), path, "csv")
    return t.spark.read.option("header", True).schema("region_code int, locations long, tiv_usd double").csv(path)


def _drop_files(t) -> str:
    """Two deliveries of the feed, the second repeating all of the first."""
    folder = shared_folder(t.spark)
    rows = fire_rows(t)
    rows.write.option("header", True).csv(folder)
    rows.write.mode("append").option("header", True).csv(folder)
    return folder


@query("m1_fire_stream", f"WITH {_FIRE_SQL} SELECT DISTINCT lat, lon, at_s FROM fires")
def m1(t):
    folder, target, state = _drop_files(t), shared_folder(t.spark), shared_folder(t.spark)
    for _ in range(2):  # the second run must add nothing
        fires.ingest_fires(t.spark, folder, target, state).awaitTermination()
    return t.spark.read.parquet(target).select("lat", "lon", F.unix_seconds("timestamp").alias("at_s"))


@query(
    "m1_fire_upserts",
    f"WITH {_FIRE_SQL} SELECT lat, lon, at_s, arg_max(confidence, row(confidence, frp)) AS confidence, arg_max(frp, row(confidence, frp)) AS frp FROM fires GROUP BY 1, 2, 3",
)
def m1_upserts(t):
    folder, root, state = _drop_files(t), shared_folder(t.spark), shared_folder(t.spark)
    fires.upsert_fires(t.spark, folder, root, state).awaitTermination()
    table = t.spark.read.parquet(root)
    return table.select("lat", "lon", utc_seconds("timestamp").alias("at_s"), "confidence", "frp")


