"""Filter interaction audit: what each of five text filters removes, in every order of the five.

Filters (null texts are empty; words are runs without white space, case-sensitive): A, under 200 words; B, fewer than
half of the words distinct; C, more than 2 of 100 code points are ``[A-Z]``; D, any of ``[#$%&*|]``; E, the whole text is
that of a document with a smaller doc_id.

E is an existential self-join: a left-semi join on the text's hash, the exact text and a smaller doc_id. Its ids are united
with those that fail the other filters, and folded to one bit combination a document. The report is computed from the
counts of combinations alone, at most 32 a part.

Scale. Only ids and hashes are grouped first; texts move once, by doc_id, and on from there only those whose hash two ids
share. On the right side of the semi join stands one row a distinct text, its least id; the left side of a large group of
copies is dealt over slots by the id's hash, and the right row is repeated into each slot of its group.

Odd input. Repeated rows are documents of their own and count each. A null doc_id is no smaller than any and none is
smaller than it, so it neither fails E nor makes others fail. Ties in doc_id fail E only against smaller ids. A null source
is the empty string. Labels that disagree on a document count as 1 where any is 1. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

# Fixed values
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
SYMBOLS = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"

BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
SLOT_ROWS = 4096  # copies of one text that meet in one slot
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, h (hash of the text) and mask (failures of A to D), a row for each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    rows = rows.withColumns({"n": F.size("words"), "distinct": F.size(F.array_distinct("words")), "capitals": F.regexp_count("text", F.lit("[A-Z]"))})
    fails = {
        "A": F.col("n") < LEAST_WORDS,
        "B": 100 * F.col("distinct").cast("long") < LEAST_DISTINCT_PERCENT * F.col("n").cast("long"),
        "C": 100 * F.col("capitals").cast("long") > MOST_CAPITALS_PERCENT * F.length("text").cast("long"),
        "D": F.col("text").rlike(SYMBOLS),
    }
    mask = sum((F.when(c, BIT[f]).otherwise(0) for f, c in fails.items()), F.lit(0))
    return rows.select("doc_id", "part", F.xxhash64("text").alias("h"), mask.cast("int").alias("mask"))


def repeated(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, h of the documents whose exact text a smaller doc_id has; ``rows`` are those of ``measured``."""
    ids = stored(rows.where("doc_id is not null").select("doc_id", "h").distinct())
    groups = stored(ids.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    slots = F.greatest(F.ceil(F.col("n") / SLOT_ROWS), F.lit(1)).cast("int")
    wanted = ids.join(groups, "h").select("doc_id", "h", slots.alias("slots"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    held = stored(texts.join(wanted, ["doc_id", "h"]))
    left = held.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.col("slots")).cast("int")).alias("a")
    least = held.groupBy("h", "text").agg(F.min("doc_id").alias("doc_id"), F.max("slots").alias("slots"))
    right = least.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).alias("b")
    same = (F.col("a.h") == F.col("b.h")) & (F.col("a.slot") == F.col("b.slot")) & (F.col("a.text") == F.col("b.text"))
    return left.join(right, same & (F.col("b.doc_id") < F.col("a.doc_id")), "left_semi").select("doc_id", "h")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask: the combination of filters that each document fails, a row for each document."""
    rows = stored(measured(docs))
    own = rows.where("mask > 0").select("doc_id", "h", "mask")
    copies = repeated(docs, rows).select("doc_id", "h", F.lit(BIT["E"]).alias("mask"))
    united = own.unionByName(copies).groupBy("doc_id", "h").agg(F.bit_or("mask").alias("mask"))
    r, u = rows.select("doc_id", "h", "part").alias("r"), united.alias("u")
    met = r.join(u, F.col("r.doc_id").eqNullSafe(F.col("u.doc_id")) & (F.col("r.h") == F.col("u.h")), "left")
    return met.select("r.doc_id", "part", F.coalesce("mask", F.lit(0)).alias("mask"))


def combinations_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each bit combination, and those of them with label 1."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    judged = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    met = failures(docs).join(judged, "doc_id", "left")
    return met.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def structs(rows: list[tuple], *names: str):
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the measures: for each part all 120 orders, five steps each."""
    combos = stored(combinations_of(docs, labels))
    others = lambda f: [b for b in FILTERS if b != f]
    places = [(sum(BIT[b] for b in before), BIT[f]) for f in FILTERS for k in range(5) for before in combinations(others(f), k)]
    cells = combos.withColumn("place", F.explode(structs(places, "before", "bit"))).select("*", "place.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    sums = {
        "kept": F.when(~fails & ~gone, F.col("n")),
        "removed": F.when(fails & ~gone, F.col("n")),
        "redundant": F.when(fails & gone, F.col("n")),
        "unique_fails": F.when(F.col("mask") == F.col("bit"), F.col("n")),
        "good_lost": F.when(fails & ~gone, F.col("good")),
        "toxic_lost": F.when(fails & ~gone, F.col("toxic")),
        # of the 120 orders, an equal share begins with each of the filters that a document fails
        "shapley": F.when(fails, F.expr("n * (120 div bit_count(mask))")),
    }
    cells = cells.groupBy("part", "before", "bit").agg(*(F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(c) for c, v in sums.items()))
    steps = [("".join(o), k + 1, sum(BIT[f] for f in o[:k]), BIT[o[k]]) for o in permutations(FILTERS) for k in range(5)]
    grid = combos.select("part").distinct().withColumn("at", F.explode(structs(steps, "filter_order", "step", "before", "bit"))).select("part", "at.*")
    return grid.join(cells, ["part", "before", "bit"]).select("part", "filter_order", "step", *MEASURES)


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
j AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN len(ws) < {LEAST_WORDS} WHEN 'B' THEN 100 * len(list_distinct(ws)) < {LEAST_DISTINCT_PERCENT} * len(ws)
  WHEN 'C' THEN 100 * len(regexp_extract_all(t, '[A-Z]')) > {MOST_CAPITALS_PERCENT} * length(t) WHEN 'D' THEN regexp_matches(t, '{SYMBOLS}') ELSE coalesce(doc_id > least_id, false) END) AS fails,
  coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM (SELECT *, min(doc_id) OVER (PARTITION BY t) AS least_id FROM d) LEFT JOIN j USING (doc_id)),
n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM l a, l b, l c, l d, l e WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, o, step,
  sum(CASE WHEN NOT list_has_any(fails, o[1:step]) THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN list_contains(fails, o[step]) AND NOT list_has_any(fails, o[1:step - 1]) THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN list_contains(fails, o[step]) AND list_has_any(fails, o[1:step - 1]) THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN fails = [o[step]] THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN list_contains(fails, o[step]) AND NOT list_has_any(fails, o[1:step - 1]) THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN list_contains(fails, o[step]) AND NOT list_has_any(fails, o[1:step - 1]) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM n, s GROUP BY part, o, step)
SELECT part, array_to_string(o, '') AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley FROM r
"""
