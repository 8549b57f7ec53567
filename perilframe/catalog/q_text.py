"""Chunks, context, numbers and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text
from ..operators.ranking import dedupe_keep_last
from ..operators.support import dealt, tasks_for
from .common import tidy
from .q_joins import TOP_K_SQL, top_hits
from .registry import query

_STEP = text.CHUNK_SIZE - text.CHUNK_OVERLAP
_BLANKS = "' ' || " + " || ".join(f"chr({ord(c)})" for c in text.BLANKS if c != " ")
CHUNK_SQL = f"""b AS (SELECT {_BLANKS} AS ws), raw_chunks AS (SELECT doc_id, source, i, trim(substring(text, i*{_STEP}+1, {text.CHUNK_SIZE}), ws) AS chunk
    FROM b, (SELECT doc_id, source, text, unnest(range(case when length(text) <= {text.CHUNK_SIZE} then 1
             else 1 + cast(ceil((length(text)-{text.CHUNK_SIZE})/{_STEP}.0) AS bigint) end)) AS i FROM documents) d),
    chunks AS (SELECT doc_id, source, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index FROM raw_chunks WHERE length(chunk) > 0)"""


def chunks(t):
    return text.chunk_documents(t.raw("documents").select("doc_id", "source", "text"))


@query("i1_text_chunks", f"WITH {CHUNK_SQL} SELECT doc_id, chunk_index, length(chunk) AS chars, md5(chunk) AS digest FROM chunks")
def i1(t):
    return tidy(chunks(t).select("doc_id", "chunk_index", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest")))


@query(
    "i2_chunk_ids",
    f"""WITH {CHUNK_SQL}, k AS (SELECT sha1(source || '::' || chunk_index || '::' || chunk) AS chunk_id, doc_id, chunk_index FROM chunks)
        SELECT chunk_id, max(doc_id) AS doc_id, arg_max(chunk_index, row(doc_id, chunk_index)) AS chunk_index FROM k GROUP BY chunk_id""",
)
def i2(t):
    keyed = text.chunk_ids(chunks(t)).select("chunk_id", "doc_id", "chunk_index")
    return tidy(dedupe_keep_last(keyed, ["chunk_id"], ["doc_id", "chunk_index"]))


@query(
    "i3_context_lines",
    f"""WITH {TOP_K_SQL}, h AS (SELECT query_id, rank, '[' || rank || '] (source: label ' || label || ' | title: vector ' || chunk_id || ' | score: ' || printf('%.3f', score)
          || ')' || chr(10) || 'chunk ' || chunk_id AS line FROM top JOIN embeddings ON vec_id = chunk_id)
        SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id""",
)
def i3(t):
    e = t.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    hits = top_hits(t).join(e, "chunk_id").select(
        "query_id", "rank", F.concat(F.lit("label "), F.col("label")).alias("source"), F.concat(F.lit("vector "), F.col("chunk_id")).alias("title"),
        "score", F.concat(F.lit("chunk "), F.col("chunk_id")).alias("chunk"),
    )
    return text.format_context(hits)


@query("i4_document_numbers")
def i4(t):
    return text.document_numbers(t.raw("documents"))


NUMBERS_SQL = """nums AS (SELECT l_orderkey AS doc_id, cast(cast(l_quantity*case l_linenumber when 1 then 100 when 2 then 1 else 3 end AS bigint) AS varchar) AS norm, count(*) AS times
        FROM lineitem GROUP BY 1, 2),
    allow AS (SELECT DISTINCT l_orderkey AS doc_id, cast(cast(l_quantity AS bigint) AS varchar) AS norm FROM lineitem WHERE l_tax < 5e-2)"""


@query(
    "i5_grounded_numbers",
    f"""WITH {NUMBERS_SQL}, open_ AS (SELECT doc_id, norm, times, cast(norm AS double) AS v FROM nums),
        f AS (SELECT doc_id, norm, times, NOT ((v = floor(v) AND v BETWEEN 0 AND 30) OR v BETWEEN 1900 AND 2100) AND NOT EXISTS (
              SELECT 1 FROM allow a WHERE a.doc_id = open_.doc_id AND (a.norm = open_.norm OR abs(v - cast(a.norm AS double)) < 1e-6
              OR abs(v - cast(a.norm AS double)*100) < 1e-4 OR abs(v*100 - cast(a.norm AS double)) < 1e-4)) AS lacks FROM open_)
        SELECT doc_id, cast(sum(times) AS bigint) AS numbers, cast(sum(case when lacks then times else 0 end) AS bigint) AS unsupported,
               sum(case when lacks then times else 0 end) <= 2 AS passed FROM f GROUP BY doc_id""",
)
def i5(t):
    raw = t.raw("lineitem")
    tasks = tasks_for(raw)
    lines = dealt(raw.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), tasks, "l_orderkey")
    factor = F.when(F.col("l_linenumber") == 1, 100).when(F.col("l_linenumber") == 2, 1).otherwise(3)
    norm = (F.col("l_quantity") * factor).cast("long").cast("string")
    nums = lines.groupBy(F.col("l_orderkey").alias("doc_id"), norm.alias("norm")).agg(F.count("*").alias("times"))
    allow = lines.where("l_tax < 0.05D").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").cast("long").cast("string").alias("norm"))
    return text.ground_numbers(nums, allow, tasks=tasks)


@query("i5_grounded_documents")
def i5_documents(t):
    docs = t.raw("documents")
    # A document may quote the numbers of the labels table: its own id and its quality.
    marks = t.raw("labels").select("doc_id", F.explode(F.array(F.col("doc_id").cast("string"), F.col("quality").cast("string"))).alias("norm"))
    return text.ground_documents(docs, marks)


PAYLOAD_NUMBERS_SQL = """p AS (SELECT l_orderkey AS doc_id, to_json({'in_2024': list({'quantity': l_quantity::bigint, 'note': 'ship ' || l_linenumber || ' of "' || l_suppkey || '" now',
          'deep': {'prices': [l_extendedprice, l_tax]}}), 'open': true}) AS payload FROM lineitem GROUP BY 1),
    v AS (SELECT doc_id, type, json_extract_string(atom, '$') AS atom FROM p, json_tree(payload) WHERE atom IS NOT NULL),
    pn AS (SELECT doc_id, case type when 'DOUBLE' then regexp_replace(cast(cast(atom AS double) AS varchar), '[.]0+$', '') else atom end AS norm FROM v WHERE type IN ('DOUBLE', 'UBIGINT', 'BIGINT')
           UNION SELECT doc_id, unnest(regexp_extract_all(atom, '[0-9]+')) FROM v WHERE type = 'VARCHAR')"""


def payloads(t):
    note = F.concat(F.lit("ship "), F.col("l_linenumber"), F.lit(' of "'), F.col("l_suppkey"), F.lit('" now'))
    line = F.struct(F.col("l_quantity").cast("long").alias("quantity"), note.alias("note"), F.struct(F.array("l_extendedprice", "l_tax").alias("prices")).alias("deep"))
    lines = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax")
    # an order's lines, its payload and the numbers in it stay in one task
    per = dealt(lines, tasks_for(lines), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(line).alias("in_2024"))  # the lines of one order
    return per.select("doc_id", F.to_json(F.struct("in_2024", F.lit(True).alias("open"))).alias("payload"))


@query("i5_payload_numbers", f"WITH {PAYLOAD_NUMBERS_SQL} SELECT doc_id, norm FROM pn")
def i5_payloads(t):
    return text.payload_numbers(payloads(t))
