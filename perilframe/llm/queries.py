"""The registered queries of this package: each applies one operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import audit, decontam, jaccard, langid, lm, merkle, mixing, periods, quality, substring, suffix, toxicity, warc
from .store import read

QUALITY_SHARES = {"0": 0.05, "1": 0.95}  # target shares of tokens by labels.quality
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_decontamination(spark, folder):
    return decontam.judge(read(spark, folder, "documents"), read(spark, folder, "benchmark")).drop("item_ids")


ORACLES["op1_decontamination"] = decontam.ORACLE


@query
def op2_language_id(spark, folder):
    return langid.languages(read(spark, folder, "documents")).drop("spans")


@query
def op3_lm_scores(spark, folder):
    return lm.scores(read(spark, folder, "documents"))


@query
def op4_warc(spark, folder):
    return warc.round_trip(read(spark, folder, "pages"))


ORACLES["op4_warc"] = warc.ORACLE


@query
def op5_jaccard_join(spark, folder):
    return jaccard.near_copies(read(spark, folder, "documents"))


ORACLES["op5_jaccard_join"] = jaccard.ORACLE


@query
def op6_quality_rules(spark, folder):
    return quality.judge(read(spark, folder, "documents")).drop("host")


@query
def op7_mixing(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    out = mixing.mixed(docs, read(spark, folder, "labels"), "quality", QUALITY_SHARES, keep=["doc_id"])
    names = {f"p_quality_{d}": F.get("llm_posterior", F.lit(i)) for i, d in enumerate(sorted(QUALITY_SHARES))}
    return out.select("doc_id", F.col("llm_n_tokens").alias("n_tokens"), *(c.alias(n) for n, c in names.items()), F.col("llm_rate").alias("rate"))


@query
def op8_substring_dedup(spark, folder):
    return substring.remove_repeats(read(spark, folder, "documents"))


ORACLES["op8_substring_dedup"] = substring.ORACLE


@query
def op9_suffix_dedup(spark, folder):
    return suffix.remove_repeats(read(spark, folder, "documents"))


@query
def op10_toxicity(spark, folder):
    out = toxicity.toxic_documents(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return out.withColumn("n_passages", F.size("passages")).drop("passages")


@query
def op11_merkle_fingerprints(spark, folder):
    return merkle.edited_neighbours(read(spark, folder, "documents"))


@query
def op12_periodic_runs(spark, folder):
    return periods.looped_runs(read(spark, folder, "documents"))


ORACLES["op12_periodic_runs"] = periods.ORACLE


@query
def op13_filter_audit(spark, folder):
    return audit.interactions(read(spark, folder, "documents"), read(spark, folder, "labels"))


ORACLES["op13_filter_audit"] = audit.ORACLE
