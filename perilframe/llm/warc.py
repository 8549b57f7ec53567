"""WARC archives: pages to records and back.

A page becomes a response record with an HTTP block in chunked transfer framing, or, if its payload of DEDUP_BYTES or
more equals that of a page with a smaller id, a revisit record that names the response record of the smallest such id.
That record's name is made of its page id and payload digest, so both sides know it. Blocks beyond SEGMENT
bytes are cut into a first record and continuation records. Spark's text writer puts the records, which end in two
line breaks, into gzip archives of ARCHIVE_RECORDS records at most, so an archive never exceeds their product.

Reading groups continuation records by the identifier of their origin, orders them by segment number, checks that
none is missing and that the lengths add up to the total, and takes the framing off. A revisit is joined to the record
that it names; its length and digest are those of that record's payload, and it is complete only where such a record
is there, is complete itself and has the digest and length that the revisit states.

A null html is an empty payload. A null page id is greater than any other: its page may revisit, and none revisits
it. Rows that share the smallest id of a payload are all responses, and the one with the smallest url (nulls first) is
revisited.
"""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import checkpoint_root, stored

DEDUP_BYTES = 100
SEGMENT = 16 << 10
CHUNK = 4 << 10
ARCHIVE_RECORDS = 8192
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
FLUSH_BYTES = 4 << 20
PARSED = "page_id long, record_id string, record_type string, target_uri string, refers string, digest string, length long, origin string, segment int, total long, block binary"


def chunked(payload: bytes) -> bytes:
    parts = [payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, None if the framing is broken."""
    at, parts = 0, []
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if not size:
            return b"".join(parts)
        parts.append(body[at : at + size])
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        at += size + 2
    return None


def record(fields: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def response_name(page_id: int, digest: str) -> str:
    """Identifier of the record that others with this payload revisit."""
    return f"urn:page:{page_id}:sha256:{digest}"


def page_records(page_id, url, payload: bytes, digest: str, first, name: str):
    """The records of a page; ``first`` is the page that it revisits, if any."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    own = {"WARC-Type": "response", "WARC-Record-ID": f"<{name}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha256:{digest}"}
    own |= {"Page-ID": page_id, "Page-Payload-Length": len(payload)}
    if first is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record(own | {"WARC-Type": "revisit", "WARC-Profile": profile, "WARC-Refers-To": f"<{response_name(first, digest)}>"}, b"")
        return
    block = HTTP + chunked(payload)
    if len(block) <= SEGMENT:
        yield record(own | {"Content-Type": "application/http;msgtype=response"}, block)
        return
    cuts = range(0, len(block), SEGMENT)
    yield record(own | {"Content-Type": "application/http;msgtype=response", "WARC-Segment-Number": 1}, block[:SEGMENT])
    for n, i in enumerate(cuts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<{name}:{n}>", "WARC-Date": own["WARC-Date"], "WARC-Target-URI": uri, "WARC-Segment-Number": n, "WARC-Segment-Origin-ID": own["WARC-Record-ID"]}
        yield record(more | ({"WARC-Segment-Total-Length": len(block)} if i == cuts[-1] else {}), block[i : i + SEGMENT])


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``page_id, url, html`` as archives below ``path``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    large = F.octet_length("html") >= DEDUP_BYTES
    alike = rows.where(large).groupBy("digest", "page_id", "url").agg(F.count("*").alias("times"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "times"))).alias("r")
    firsts = alike.groupBy("digest").agg(least, F.sum("times").alias("n")).where("n > 1 and r is not null")
    known = stored(firsts.select("digest", F.col("r.page_id").alias("first"), F.col("r.url").alias("first_url"), F.col("r.times").alias("times")))
    joined = rows.join(known, "digest", "left")
    named = F.col("first").isNotNull() & F.col("page_id").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("first_url"))
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    joined = joined.select("page_id", "url", "html", "digest", F.when(later, F.col("first")).alias("first"), named.alias("named"), F.when(named, F.col("times")).otherwise(1).alias("times"))
    if not known.where("times > 1").isEmpty():  # equal rows are written from one, which alone has the name
        joined = joined.where("times = 1").unionByName(joined.where("times > 1").dropDuplicates(["digest"]))

    def write(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            held, size = [], 0
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "first", "named", "times")), strict=True):
                page_id, url, body, digest, first, named, times = (x.as_py() for x in row)
                for copy in range(times):
                    n += 1
                    name = response_name(page_id, digest.hex()) if named and not copy else f"urn:page:{page_id}:{part}.{n}"
                    for r in page_records(page_id, url, body.encode(), digest.hex(), first, name):
                        held.append(r)
                        size += len(r)
                    if size > FLUSH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    records = joined.mapInArrow(write, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", ARCHIVE_RECORDS).option("compression", "gzip").text(path)


def parsed(content: bytes):
    """Records of an archive, gzip or plain, as dicts; the archive is unpacked piece by piece."""
    source = unpacked(content)
    held, over = bytearray(), False

    def want(n: int) -> bool:
        nonlocal over
        while len(held) < n and not over:
            piece = next(source, None)
            over = piece is None
            held.extend(piece or b"")
        return len(held) >= n

    while True:
        while (end := held.find(END)) < 0 and want(len(held) + 1):
            pass
        if end < 0:
            if held.strip():
                raise ValueError("archive ends inside a header")
            return
        version, *lines = held[:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a record: {version[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        if not want(end + 4 + size):
            raise ValueError("archive ends inside a block")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        want(end + 8 + size)
        if held[end + 4 + size : end + 8 + size] not in (END, b""):
            raise ValueError("no line breaks after a block")
        del held[: end + 8 + size]


def unpacked(content: bytes):
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        unzip = zlib.decompressobj(31)
        while content and not unzip.eof:
            yield unzip.decompress(content, 1 << 20)
            content = unzip.unconsumed_tail or unzip.unused_data if not unzip.eof else unzip.unused_data


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below ``path``."""

    def read(batches):
        kinds = [("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]
        schema = pa.schema(kinds)
        number = lambda x: int(x) if x not in (None, "None") else None
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for f, block in parsed(content.as_py()):
                    held.append((number(f.get("page-id")), f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha256:") or None, number(f.get("page-payload-length")), f.get("warc-segment-origin-id"), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), block))
                    size += len(block)
                    if size > FLUSH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held, strict=True), kinds, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held, strict=True), kinds, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, PARSED)


def reassembled(records: DataFrame) -> DataFrame:
    """Records with whole blocks; ``complete`` is false where a segment is missing or the total differs."""
    whole = records.where("segment is null").withColumn("complete", F.lit(True))
    parts = records.where("segment is not null").withColumn("of", F.coalesce("origin", "record_id"))
    kept = [c for c in records.columns if c not in ("origin", "segment", "total", "block", "record_id")]
    heads = [F.first(F.when(F.col("segment") == 1, F.col(c)), ignorenulls=True).alias(c) for c in kept]
    grouped = parts.groupBy("of").agg(*heads, F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("segments"))
    letters = F.transform("segments", lambda s: F.decode(s["block"], "ISO-8859-1"))  # a letter for each byte: joined once, in linear time
    joined = grouped.withColumn("block", F.encode(F.array_join(letters, ""), "ISO-8859-1")).withColumn("record_id", F.col("of"))
    numbered = F.transform("segments", lambda s: s["segment"]) == F.sequence(F.lit(1), F.size("segments"))
    joined = joined.withColumn("complete", F.coalesce(numbered & (F.octet_length("block") == F.col("total")), F.lit(False)))
    columns = [*kept, "record_id", "block", "complete"]
    return whole.select(columns).unionByName(joined.select(columns))


def decoded(records: DataFrame) -> DataFrame:
    """Whole records with their payload, its payload_bytes and payload_digest, and whether all of it is there (``complete``)."""
    rows = reassembled(records)

    def decode(batches):
        for batch in batches:
            out = []
            for block in batch.column("block"):
                head, _, body = block.as_py().partition(END)
                out.append(unchunked(body) if b"chunked" in head.lower() else body)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], names=[*kept, "payload"])

    kept = [c for c in rows.columns if c != "block"]
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "block") + ", payload binary"
    digest = F.sha2("payload", 256)
    out = rows.mapInArrow(decode, schema).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": digest})
    return out.withColumn("complete", F.coalesce(F.col("complete") & (F.col("payload_digest") == F.col("digest")), F.lit(False)))


def resolved(rows: DataFrame) -> DataFrame:
    """``decoded`` rows, without ``payload`` or with it, in which revisits have what the records that they name hold.

    The records that are named are found first, once each, so what the revisits of a hot record meet is one small row.
    """
    again = rows.where("record_type = 'revisit'")
    names = again.select(F.col("refers").alias("record_id")).distinct()
    found = rows.where("record_type = 'response'").join(names, "record_id", "left_semi")
    found = found.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"), F.col("complete").alias("c"))
    right = F.coalesce(F.col("c") & (F.col("d") == F.col("digest")) & (F.col("b") == F.col("length")), F.lit(False))
    content = [F.lit(None).cast("binary").alias("payload")] if "payload" in rows.columns else []
    revisits = again.join(found, "refers", "left").select("page_id", "record_type", "target_uri", "refers_to", *content, F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), right.alias("complete"))
    others = rows.where("record_type <> 'revisit' or record_type is null").withColumn("refers_to", F.lit(None).cast("long"))
    return others.select(revisits.columns).unionByName(revisits)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, target_uri, refers_to, payload (null for revisits), payload_bytes, payload_digest and complete."""
    return resolved(decoded(read_records(spark, path)))


def checked(rows: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to; a record that is not complete is an error."""
    broken = F.raise_error(F.concat(F.lit("broken record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("without an id"))))
    kind = F.when(F.col("complete"), F.col("record_type")).otherwise(broken.cast("string"))
    return rows.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a fresh folder of archives and read them back; a page that comes back broken is an error.

    Lengths and digests are stored first, so that revisits are resolved without a second look into the archives.
    """
    spark = pages.sparkSession
    path = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return checked(resolved(stored(decoded(read_records(spark, path)).drop("payload"))))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE n >= {DEDUP_BYTES} GROUP BY html)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""
