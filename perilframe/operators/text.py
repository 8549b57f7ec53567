"""Chunking, retrieval, context lines, number extraction and grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import dealt
from .vectors import nearest_vectors

# Fixed values of the document index.
CHUNK_SIZE = 800
CHUNK_OVERLAP = 120
TOP_K = 6
MIN_SCORE = 0.25
# Characters that count as white space at the ends of a chunk.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0            "
    "    　"
)
# Fixed pattern of a number in text, with optional currency and percent marks.
NUMBER_PATTERN = (
    r"(?iU)(?<![\w.])(?:USD\s*)?(?:\$)?(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+\.\d+|\d+)(?:\s*%|\s*percent)?(?![\w.])"
)
UNSUPPORTED_ALLOWED = 2


def strip(column):
    return F.btrim(column, F.lit(BLANKS))


def chunk_list(text, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """Array of trimmed, non-blank, overlapping chunks of a text Column.

    One regular expression cuts the text into consecutive steps, and a chunk is a
    step plus the head of what follows: linear in the length of the text, where
    a substring per chunk would walk the text from its start each time.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than the chunk size")
    steps = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0))
    wanted = F.when(F.length(text) <= size, F.lit(1)).otherwise(
        1 + F.ceil((F.length(text) - size) / step).cast("int")
    )
    per_chunk = -(-size // step)

    def build(piece, i):
        tail = [F.coalesce(F.get(steps, i + d), F.lit("")) for d in range(1, per_chunk)]
        return strip(F.substring(F.concat(piece, *tail), 1, size))

    return F.filter(F.transform(F.slice(steps, 1, wanted), build), lambda c: F.length(c) > 0)


def chunk_documents(
    docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "text"
) -> DataFrame:
    """One row per chunk: the other columns, ``chunk_index`` and ``chunk``."""
    others = [c for c in docs.columns if c != text]
    cut = docs.withColumn("_chunks", chunk_list(F.col(text), size, overlap))
    return cut.select(*others, F.posexplode("_chunks").alias("chunk_index", "chunk"))


def chunk_ids(chunks: DataFrame, source: str = "source") -> DataFrame:
    """Add ``chunk_id``: sha1 over source, index and chunk."""
    return chunks.withColumn(
        "chunk_id", F.sha1(F.concat_ws("::", F.col(source), F.col("chunk_index").cast("string"), F.col("chunk")))
    )


# --- retrieval ---------------------------------------------------------------


def vector_top_k(queries: DataFrame, chunks: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest chunks by cosine, ties by chunk id.

    ``queries`` is (query_id, vec), ``chunks`` (chunk_id, vec). Exact; parts of the chunk table that cannot hold one of
    the k best of a query are not visited for it (see ``vectors``).
    """
    return nearest_vectors(queries, chunks, k)


def accept_or_refuse(top: DataFrame, floor: float = MIN_SCORE) -> DataFrame:
    """Per query: best score, hits, and whether retrieval is confident enough to answer."""
    return top.groupBy("query_id").agg(F.max("score").alias("best_score"), F.count("*").alias("hits")).withColumn(
        "answered", F.col("best_score") >= floor
    )


def format_context(hits: DataFrame) -> DataFrame:
    """One text per query from (query_id, rank, source, title, score, chunk), at most top-k rows each."""
    block = F.format_string(
        "[%d] (source: %s | title: %s | score: %.3f)\n%s", F.col("rank"), F.col("source"), F.col("title"), F.col("score"), F.col("chunk")
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("line"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("context"))


# --- numbers -----------------------------------------------------------------


def extract_numbers(text):
    """Array of the numbers written in a text, as written."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0)), strip)


def normalise_number(raw):
    """Drop USD, $, thousands commas, % and a zero fraction."""
    bare = strip(F.regexp_replace(F.upper(raw), r"USD|\$|,|%", ""))
    return F.when(bare.rlike(r"^\d+\.0+$"), F.substring_index(bare, ".", 1)).otherwise(bare)


def document_numbers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, norm, times): distinct normalised numbers per document."""
    raw = docs.select(key, F.explode(extract_numbers(F.col(text))).alias("_raw"))
    return raw.groupBy(key, normalise_number(F.col("_raw")).alias("norm")).agg(F.count("*").alias("times"))


def is_structural(value):
    """Small whole numbers and calendar years need no support."""
    small = (value == F.floor(value)) & value.between(0, 30)
    return F.coalesce(small | value.between(1900, 2100), F.lit(False))


def _bucket(value, width: float):
    fine = F.floor(value / width)
    return F.when(F.abs(value) < 1e12, fine).when(F.abs(value) < 9e18, F.floor(value)).cast("long")


def ground_numbers(
    numbers: DataFrame, allowed: DataFrame, key: str = "doc_id", extras: int = UNSUPPORTED_ALLOWED, tasks: int | None = None
) -> DataFrame:
    """Per document: numbers, unsupported ones and the verdict.

    ``numbers`` is (key, norm, times), ``allowed`` (key, norm). A number is
    supported if it equals an allowed one as text, or as a value directly, as 100
    times it, or as a hundredth of it. The tolerances become equi-join keys: each
    allowed value is listed in its bucket and the two beside it, so a document's
    numbers are not compared with all of its allowed values. Large inputs name the ``tasks`` over which their joins are dealt.
    """
    asked = dealt(numbers, tasks, key, "norm").withColumn("_v", F.col("norm").try_cast("double"))
    open_ = asked.where(~is_structural(F.col("_v")))

    def slot(tag: int, bucket):
        return F.struct(F.lit(tag).alias("_tag"), bucket.cast("long").alias("_bucket"))

    v = F.col("_v")
    # Three kinds of slots: the text itself, values to 1e-6, values to 1e-4.
    asked_slots = F.array(slot(0, F.xxhash64("norm")), slot(1, _bucket(v, 1e-6)), slot(2, _bucket(v, 1e-4)))
    probes = open_.select(key, "norm", "_v", F.inline(asked_slots))
    known = allowed.select(key, F.col("norm").alias("_an"), F.col("norm").try_cast("double").alias("_a")).distinct()

    a = F.col("_a")
    listed = [slot(0, F.xxhash64("_an"))]
    for tag, target, width in ((1, a, 1e-6), (1, a / 100, 1e-6), (2, a * 100, 1e-4)):
        listed += [slot(tag, _bucket(target, width) + step) for step in (-1, 0, 1)]
    targets = known.select(key, "_an", "_a", F.inline(F.array_distinct(F.array(*listed))))
    close = (F.abs(v - a) < 1e-6) | (F.abs(v - a * 100) < 1e-4) | (F.abs(v * 100 - a) < 1e-4)
    match = (F.col("norm") == F.col("_an")) | F.coalesce(close, F.lit(False))
    slots = (key, "_tag", "_bucket")
    met = dealt(probes, tasks, *slots).join(dealt(targets, tasks, *slots), list(slots)).where(match)
    backed = dealt(met.select(key, "norm"), tasks, key, "norm").distinct().withColumn("_backed", F.lit(True))
    lacks = ~is_structural(v) & F.col("_backed").isNull() & F.col(key).isNotNull() & F.col("norm").isNotNull()
    out = asked.join(backed, [key, "norm"], "left").groupBy(key).agg(
        F.sum("times").alias("numbers"),
        F.coalesce(F.sum(F.when(lacks, F.col("times"))), F.lit(0)).alias("unsupported"),
    )
    return out.withColumn("passed", F.col("unsupported") <= extras)


# Strings and numbers of a JSON text; a string before a colon is a name, not a value.
JSON_TOKENS = r'"(?:[^"\\]|\\.)*"(?:\s*:)?|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?'


def payload_numbers(payloads: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """(key, norm): distinct normalised numbers among the values of JSON payloads, and in the texts among these.

    Numbers and texts count at any depth: a valid payload is read as the sequence of its tokens, in one pass over the row, and names are
    left out. A payload that is no JSON counts as one text; a null one has no numbers.
    """
    valid = F.try_parse_json(payload).isNotNull()
    rows = payloads.select(F.col(key), F.col(payload).alias("_payload"), valid.alias("_valid")).where(F.col("_payload").isNotNull())
    rows = rows.withColumn("_values", F.filter(F.regexp_extract_all("_payload", F.lit(JSON_TOKENS), F.lit(0)), lambda v: ~v.endswith(":")))
    quoted = F.array_join(F.filter("_values", lambda v: v.startswith('"')), ",")
    texts = F.when(F.col("_valid"), F.from_json(F.concat(F.lit("["), quoted, F.lit("]")), "array<string>")).otherwise(F.array("_payload"))
    plain = F.filter("_values", lambda v: F.col("_valid") & ~v.startswith('"'))
    # as a program prints them: 2.50 is 2.5
    plain = F.transform(plain, lambda v: F.when(v.rlike(r"[.eE]"), v.cast("double").cast("string")).otherwise(v))
    raw = F.concat(plain, F.flatten(F.transform(texts, extract_numbers)))
    return rows.select(key, F.explode(raw).alias("_raw")).select(key, normalise_number(F.col("_raw")).alias("norm")).distinct()


def ground_payloads(docs: DataFrame, payloads: DataFrame, key: str = "doc_id", extras: int = UNSUPPORTED_ALLOWED) -> DataFrame:
    """Check the numbers of texts against those of JSON payloads (key, payload), of which a document may have many."""
    return ground_documents(docs, payload_numbers(payloads, key), key, extras)


def ground_documents(
    docs: DataFrame, allowed: DataFrame, key: str = "doc_id", extras: int = UNSUPPORTED_ALLOWED
) -> DataFrame:
    """Extract and check in one go; a document without numbers passes."""
    checked = ground_numbers(document_numbers(docs, key), allowed, key, extras)
    out = docs.select(key).distinct().join(checked, key, "left").na.fill(0, ["numbers", "unsupported"])
    return out.withColumn("passed", F.coalesce("passed", F.lit(True)))
