"""Benchmark decontamination by winnowing, in DataFrame functions only.

A benchmark item taints a document where they share SPAN consecutive words (an item with fewer words, but not none:
all of them). Of the GRAM-word hashes of a text the least of each SPAN - GRAM + 1 neighbours is a fingerprint, so
every shared stretch of SPAN words has a shared fingerprint. Documents that share one with the benchmark are
extended: their windows of SPAN words are compared, as words, with those of the items. Items below SPAN words have no
such guarantee; their windows are looked up directly, one pass for each of their lengths (nine at most).

The benchmark's fingerprints and windows are counted; up to BROADCAST_ROWS of them are broadcast, beyond that both
sides are shuffled and adaptive execution splits the keys that many documents share.

Null texts have no words; documents without words are clean; an item whose id is null marks words but is not
counted; repeated items count once. Documents that share an id are judged apart, equal rows alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import give_back, stored, with_keys

SPAN = 10
GRAM = 5
BROADCAST_ROWS = 1_000_000  # about 100 bytes a row
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a column that a lambda names is else computed for each element."""
    return F.transform(F.array(value), use)[0]


def starts(n: Column, k) -> Column:
    """1, 2, ... to the last start of a window of k among n words."""
    return F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))


def fingerprints(ws: Column) -> Column:
    """The least hash of each SPAN - GRAM + 1 neighbouring windows of GRAM words, each value once."""
    width = SPAN - GRAM + 1
    low = lambda g: F.array_distinct(F.transform(starts(F.size(g), width), lambda i: F.array_min(F.slice(g, i, width))))
    return let(ws, lambda w: let(F.transform(starts(F.size(w), GRAM), lambda i: F.xxhash64(F.slice(w, i, GRAM))), low))


def grams_of(df: DataFrame, ws: Column, k: int, *keep: str) -> DataFrame:
    """A row (keep, start, k, gram) for each window of k words."""
    at = let(ws, lambda w: F.transform(starts(F.size(w), k), lambda i: F.array_join(F.slice(w, i, k), " ")))
    return df.select(*keep, F.posexplode(at).alias("start", "gram")).select(*keep, (F.col("start") + 1).alias("start"), F.lit(k).alias("k"), "gram")


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, start, k, item_id): the k words of document ``key`` from ``start`` on are a window of the item."""
    items = stored(benchmark.select("item_id", words("text").alias("ws")).where(F.size("ws") > 0))
    long, short = items.where(F.size("ws") >= SPAN), items.where(F.size("ws") < SPAN)
    ws, item = words("text"), F.col("ws")
    prints = small(stored(long.select(F.explode(fingerprints(item)).alias("print")).distinct()))
    marked = docs.select("key", F.explode(fingerprints(ws)).alias("print")).join(prints, "print").select("key").distinct()
    suspects = docs.join(stored(marked), "key")
    found = [grams_of(suspects, ws, SPAN, "key").join(small(stored(grams_of(long, item, SPAN, "item_id").select("item_id", "gram").distinct())), "gram")]
    for (k,) in short.select(F.size("ws")).distinct().collect():  # 1 to SPAN - 1
        whole = grams_of(short.where(F.size("ws") == k), item, k, "item_id").select("item_id", "gram").distinct()
        found.append(grams_of(docs, ws, k, "key").join(small(stored(whole)), "gram"))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.select("key", "start", "k", "item_id")


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit (words inside shared windows), n_items, items_sha256, contaminated and item_ids."""
    keyed, *back = with_keys(docs)
    hits = spans(keyed, benchmark)
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "k")), lambda x: F.sequence(x["start"], x["start"] + x["k"] - 1)))))
    per = hits.groupBy("key").agg(covered.cast("long").alias("n_hit"), F.collect_set("item_id").alias("items"))  # bounded by the text and the items
    out = keyed.select("key", F.size(words("text")).cast("long").alias("n_words")).join(per, "key", "left")
    ids = F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<long>")), lambda x: x.cast("string")))
    out = out.withColumn("item_ids", ids).withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    out = out.select("key", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "item_ids")
    return give_back(out, *back)


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
items AS (SELECT item_id, ws, least(len(ws), {SPAN}) AS k FROM b WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM items)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
hit AS (SELECT doc_id, i, k, item_id FROM dw JOIN iw USING (k, gram)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
