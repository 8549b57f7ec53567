"""Readers, writers and the stream on hand-made files."""

import json

import pytest
from pyspark.sql import functions as F

from perilframe.sources import readers, writers
from perilframe.streaming import fires

TRACKS = """EP071987,             KESTREL,      4,
19870704, 1800,  , TD, 15.2N, 104.6W,  25, 1009,   45,
19870705, 0000,  , TS, 15.9N, 106.1W,  50,  996,   70,
19870705, 0300, W, HU, 16.4N, 107.3W,  80,  974,  110,
19870705, 0300, W, HU, 16.4N, 107.3W,  80,  -999,  110,

SH031987,              WILLOW,      1,
19871220, 0600,  , TS, 11.7S,  62.4E,  35, 1003,   55,
"""


def utc(spark, column):
    return F.unix_seconds(F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))


def test_tracks(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TRACKS)
    (tmp_path / "b.txt").write_text(TRACKS.replace("\n", "\r\n").replace("1987", "2004"))
    got = {(r.storm_id, str(r.obs_ts)): r for r in readers.read_tracks(spark, str(tmp_path)).collect()}
    assert len(got) == 8
    r = got["EP071987", "1987-07-05 03:00:00"]
    assert (r.name, r.status, r.max_wind_kt, r.min_pressure_mb, r.lat, r.lon) == ("KESTREL", "HU", 80, None, 16.4, -107.3)
    s = got["SH031987", "1987-12-20 06:00:00"]
    assert (s.lat, s.lon) == (-11.7, 62.4)


def test_tracks_orphan_and_empty(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("19870704, 1800,  , TD, 15.2N, 104.6W,  25, 1009,\n" + TRACKS)
    with pytest.raises(Exception, match="before any header"):
        readers.read_tracks(spark, str(tmp_path)).collect()
    empty = spark.createDataFrame([("f", "")], "file string, text string")
    assert readers.parse_tracks(empty).count() == 0


def test_index(spark, tmp_path):
    data = [" DJF  1950  24.72 -1.53", " SON  1997  28.00  2.30", " JFM  1951  25.00      ", " NDJ  2001  26.00  0.10"]
    (tmp_path / "oni.txt").write_text("\n".join([" SEAS  YR  TOTAL   ANOM", *data]) + "\n")
    got = sorted(tuple(r) for r in readers.read_index(spark, str(tmp_path)).collect())
    assert got == [(1950, "DJF", -1.53, "la_nina"), (1997, "SON", 2.3, "el_nino"), (2001, "NDJ", 0.1, "neutral")]


def test_fire_times(spark, tmp_path):
    (tmp_path / "f.csv").write_text("latitude,longitude,acq_date,acq_time,satellite,instrument,confidence,frp\n25.1,-80.2,2024-01-05,907,N20,VIIRS,nominal,3.5\n25.2,-80.3,2024-01-05,1345,N20,VIIRS,low,1.0\n")
    df = readers.read_fires(spark, str(tmp_path))
    assert [str(r.timestamp) for r in df.orderBy("timestamp").collect()] == ["2024-01-05 09:07:00", "2024-01-05 13:45:00"]
    small = readers.normalise_fires(df.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.lit("2024-01-01").alias("acq_date"), F.lit(5).alias("acq_time")))
    assert small.columns == ["lat", "lon", "timestamp"] and str(small.first().timestamp) == "2024-01-01 00:05:00"


def test_series(spark, tmp_path):
    doc = {"series_id": "CPI", "series_name": "cpi", "observations": [{"date": "2020-01-01", "value": "1.5"}, {"date": "2020-02-01", "value": "."}, {"date": "2020-03-01", "value": "2"}]}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    got = readers.read_series(spark, str(tmp_path), multi_line=True).collect()
    assert len(got) == 3 and sum(r.value is None for r in got) == 1


def test_documents(spark, tmp_path):
    root = tmp_path / "docs dir"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("one")
    (root / "sub" / "b c.txt").write_text("two\nlines")
    (root / "skip.pdf").write_text("no")
    got = {r.source: (r.title, r.text) for r in readers.read_documents(spark, str(root)).collect()}
    assert got == {"a.md": ("a", "one"), "sub/b c.txt": ("b c", "two\nlines")}


def test_upsert_is_idempotent(spark, rows, tmp_path):
    root = str(tmp_path / "bronze")
    first = rows([("A", 1, 30), ("A", 2, 40)], "storm_id string, ts int, wind int")
    for _ in range(2):
        writers.upsert(first, root, ["storm_id", "ts"])
    assert writers.read_upserted(spark, root).count() == 2
    writers.upsert(rows([("B", 1, 50), ("A", 2, 99)], "storm_id string, ts int, wind int"), root, ["storm_id", "ts"])
    got = {(r.storm_id, r.ts): r.wind for r in writers.read_upserted(spark, root).collect()}
    assert got == {("A", 1): 30, ("A", 2): 99, ("B", 1): 50}
    with pytest.raises(ValueError, match="empty"):
        writers.upsert(first.limit(0), root)
    whole = str(tmp_path / "whole")
    writers.upsert(first.union(first), whole)
    assert writers.read_upserted(spark, whole).count() == 2 and "_ingested_at" in writers.read_upserted(spark, whole).columns


@pytest.mark.parametrize("size", ["64", "150", "1000000"])
def test_tracks_read_in_splits(spark, tmp_path, size):
    """Splits begin inside storms, some hold no header: the rows are those of whole files."""
    storms = [f"AL{i:02d}2001, NAME{i},  40,\n" + "".join(f"200109{1 + k // 24:02d}, {k % 24:02d}00,  , HU, {10 + i}.0N, {50 + k}.0W, {30 + k}, {900 + i},\n" for k in range(40)) for i in range(1, 8)]
    (tmp_path / "a.txt").write_text("".join(storms))
    (tmp_path / "b.txt").write_text(storms[2].replace("2001", "2002"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = readers.read_tracks(spark, str(tmp_path))
        assert size == "1000000" or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = sorted((r.storm_id, str(r.obs_ts), r.name, r.lat, r.max_wind_kt) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    want = [(f"AL{i:02d}{y}", f"{y}-09-{1 + k // 24:02d} {k % 24:02d}:00:00", f"NAME{i}", 10.0 + i, 30 + k) for y, ids in ((2001, range(1, 8)), (2002, [3])) for i in ids for k in range(40)]
    assert got == sorted(want)


def test_partitioned_table_splits_a_large_value(spark, tmp_path):
    df = spark.range(40000).select("id", F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("part"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    files = lambda name: {p: len(list((tmp_path / name / f"part={p}").glob("*.parquet"))) for p in ("small", "large")}
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        writers.write_table(df, str(tmp_path / "whole"), ["part"])
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
        writers.write_table(df, str(tmp_path / "split"), ["part"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert files("whole") == {"small": 1, "large": 1} and files("split")["large"] > 3
    assert spark.read.parquet(str(tmp_path / "split")).count() == 40000


def test_many_files_keep_duplicates(spark, rows, tmp_path):
    rows([(1, "a")], "x int, y string").write.parquet(str(tmp_path / "1"))
    rows([(1,)], "x int").write.parquet(str(tmp_path / "2"))
    assert readers.read_many(spark, [str(tmp_path / "1"), str(tmp_path / "2")]).count() == 2
    with pytest.raises(ValueError):
        readers.read_many(spark, [])


def fire_file(path, minutes, frp):
    lines = ["latitude,longitude,acq_date,acq_time,satellite,instrument,confidence,frp"]
    lines += [f"25.0,-80.0,2024-01-05,{m // 60 * 100 + m % 60},N20,VIIRS,low,{frp}" for m in minutes]
    path.write_text("\n".join(lines) + "\n")


def test_stream_adds_nothing_twice(spark, tmp_path):
    feed, out, state = tmp_path / "feed", str(tmp_path / "out"), str(tmp_path / "state")
    feed.mkdir()
    fire_file(feed / "1.csv", [*range(100), *range(50)], 1.0)
    fires.ingest_fires(spark, str(feed), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 100
    fires.ingest_fires(spark, str(feed), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 100
    fire_file(feed / "2.csv", range(80, 130), 2.0)
    fires.ingest_fires(spark, str(feed), out, state).awaitTermination()
    table = spark.read.parquet(out)
    assert table.count() == 130 and table.where("frp = 1").count() == 100  # first seen wins
    assert table.agg(F.min(F.unix_seconds("timestamp"))).first()[0] == 1704412800  # midnight UTC


def test_stream_upsert_keeps_last(spark, tmp_path):
    feed, root, state = tmp_path / "feed", str(tmp_path / "root"), str(tmp_path / "state")
    feed.mkdir()
    fire_file(feed / "1.csv", range(10), 1.0)
    fires.upsert_fires(spark, str(feed), root, state).awaitTermination()
    fire_file(feed / "2.csv", range(5, 15), 2.0)
    fires.upsert_fires(spark, str(feed), root, state).awaitTermination()
    table = spark.read.parquet(root)
    assert table.count() == 15 and table.where("frp = 2").count() == 10


def test_partition_upsert_touches_only_its_partitions(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    schema = "day string, id int, v string"
    writers.upsert_partitions(rows([("d1", 1, "a"), ("d2", 1, "a"), ("d2", 2, "a")], schema), path, ["day", "id"], "day")
    before = {p.name for p in (tmp_path / "t" / "day=d1").iterdir()}
    for _ in range(2):
        writers.upsert_partitions(rows([("d2", 2, "b"), ("d3", 9, "b")], schema), path, ["day", "id"], "day")
    got = {(r.day, r.id): r.v for r in spark.read.parquet(path).collect()}
    assert got == {("d1", 1): "a", ("d2", 1): "a", ("d2", 2): "b", ("d3", 9): "b"}
    assert {p.name for p in (tmp_path / "t" / "day=d1").iterdir()} == before
    with pytest.raises(ValueError, match="one of the keys"):
        writers.upsert_partitions(rows([("d1", 1, "a")], schema), path, ["id"], "day")
