"""A corpus through five stages; each gets what its predecessor kept.

The stages drop documents with toxic passages, all near copies but the one with the smallest id of each group, words of
passages that an earlier document has (and documents with no word left), documents that share words with the benchmark,
and documents to which mixing gives rate 0; the last adds the rate at which a document is to be drawn.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from perilframe.llm import decontam, jaccard, mixing, substring, toxicity
from perilframe.llm.queries import QUALITY_SHARES
from perilframe.llm.store import condensed, read, stored, with_keys


def toxicity_stage(spark, docs, folder):
    model = toxicity.fit(docs, read(spark, folder, "labels"))
    return toxicity.score(docs, model).where("llm_score < 0.5").select(docs.columns)


def near_copy_stage(spark, docs, folder):
    keyed, full, plain = with_keys(docs)
    gone = condensed(spark, lambda: jaccard.components(keyed)[1].where("key <> component").select(F.col("key").alias("llm_key")))
    kept = full.join(gone, "llm_key", "left_anti")
    return (kept if plain else kept.dropDuplicates(["llm_key"])).select(docs.columns)


def substring_stage(spark, docs, folder):
    keyed, full, _ = with_keys(docs)
    cut = substring.dedup(keyed, with_text=True).where("n_removed > 0")
    joined = full.join(cut.select(F.col("key").alias("llm_key"), F.col("kept").alias("llm_kept")), "llm_key", "left").where("llm_kept is null or llm_kept <> ''")
    out = joined.withColumn("text", F.coalesce("llm_kept", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("llm_kept").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def decontamination_stage(spark, docs, folder):
    keyed, full, _ = with_keys(docs)
    tainted = decontam.spans(keyed, read(spark, folder, "benchmark")).select(F.col("key").alias("llm_key")).distinct()
    return full.join(tainted, "llm_key", "left_anti").select(docs.columns)


def mixing_stage(spark, docs, folder):
    out = mixing.mixed(docs, read(spark, folder, "labels"), "quality", QUALITY_SHARES).where("llm_rate > 0")
    return out.select(*(c for c in docs.columns if c != "rate"), F.col("llm_rate").alias("rate"))  # an older rate is replaced


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]
ORACLE_SQL = None


def run(spark, folder):
    docs = read(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
