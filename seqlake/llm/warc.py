"""WARC archives of pages, and the reassembly of records that were written in segments.

Writing. A page becomes an HTTP response whose body is framed in chunks. Where several pages have
equal payloads, the one with the largest id is the response and the others are revisits that
refer to it, without a payload. A block longer than ``segment_bytes`` is cut: its first segment
keeps the record's type, the rest are continuation records that name its origin, their number
and, in the last one, the total length. Records are rows of a text file whose line end closes a
record, so Spark writes the archives (gzip) itself. No chunk of a body holds the line that opens
a record, so that line opens records only.

Reading. Files are split at that line, so neither a file nor its list of records is held whole; in
a gzip file, records whose block holds the line are put together by their Content-Length (in a
plain file too, unless such a block crosses Spark's file splits: that record is not whole).
1. continuation records are grouped by the id of their origin, with the first segment;
2. segments are ordered by number; the numbers must be gapless and the total length must hold;
3. the HTTP head is cut off and chunked framing is decoded; the payload must match its digest;
4. a revisit's payload is that of the response it refers to, a join on record ids with salts for
   responses that many refer to. Only ids, sizes and digests take part.

Defined results: a null payload is empty; empty payloads are equal payloads; a null page id comes
last among equal payloads; repeated rows are records of their own, one of which is the response;
a record that misses a segment, differs from its length or digest, or refers to nothing is kept
with whole = false and what is known of it; payloads of any length are kept whole; an empty table
gives no records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.scratch import Scratch
from seqlake.llm.skew import for_each_salt, hot_keys, with_salt
from seqlake.scratch import new_path

OPENING = b"WARC/1.1\r\n"
SEGMENT_BYTES = 8192
CHUNK_BYTES = 2048
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORDS = "record_id string, type string, page_id long, uri string, refers_to_id string, digest string, origin string, number int, total long, block binary, whole boolean"
PAYLOADS = "record_id string, type string, page_id long, uri string, refers_to_id string, digest string, payload binary, whole boolean"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16])}>"


def chunked(payload: bytes, size: int) -> bytes:
    """payload in chunks; one ends inside each line that would open a record."""
    cuts = set(range(0, len(payload), size)) | {len(payload)}
    at = payload.find(OPENING)
    while at >= 0:
        cuts.add(at + 4)
        at = payload.find(OPENING, at + 1)
    order = sorted(cuts)
    parts = [b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(order, order[1:])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken or incomplete."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        if size < 0 or body[line + 2 + size:line + 4 + size] != b"\r\n":
            return None
        out.append(body[line + 2:line + 2 + size])
        at = line + 4 + size


def http_payload(block: bytes) -> bytes | None:
    """The body of an HTTP message, its chunked framing decoded."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    framing = [v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:]) if k.strip().lower() == b"transfer-encoding"]
    return unchunked(body) if framing and framing[-1].endswith(b"chunked") else body


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without its last line end, which the file's rows add."""
    told = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    return OPENING + told.encode() + b"\r\n" + block + b"\r\n"


def header_text(value: str | None) -> str | None:
    """A header's value on one line."""
    return None if value is None else " ".join(value.split())


def _records(segment_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                payload = row["payload"] or b""
                common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", header_text(row["uri"])), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("X-Page-Id", row["page_id"])]
                main = record_id("response", row["key"])
                if not row["kept"]:
                    own = record_id("revisit", row["key"], row["row"])
                    told = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Refers-To", main), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common]
                    out = [record([*told, ("Content-Type", "application/http;msgtype=response")], HTTP_HEAD)]
                else:
                    block = HTTP_HEAD + chunked(payload, chunk_bytes)
                    cuts = [block[a:a + segment_bytes] for a in range(0, len(block), segment_bytes)]
                    told = [("WARC-Type", "response"), ("WARC-Record-ID", main), *common, ("Content-Type", "application/http;msgtype=response")]
                    out = [record(told + [("WARC-Segment-Number", 1)] * (len(cuts) > 1), cuts[0])]
                    for n, part in enumerate(cuts[1:], 2):
                        last = len(block) if n == len(cuts) else None
                        out.append(record([
                            ("WARC-Type", "continuation"), ("WARC-Record-ID", record_id("continuation", row["key"], n)), ("WARC-Date", "1970-01-01T00:00:00Z"),
                            ("WARC-Segment-Origin-ID", main), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", last),
                        ], part))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def with_kept(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (row, page_id, uri, payload, key) plus kept: of equal payloads (key), the one with the largest page_id."""
    best = F.max(F.struct(F.col("page_id"), F.col("row"))).alias("best")
    groups = scratch.save(rows.groupBy("key").agg(F.count("*").alias("n"), best).where("n > 1").select("key", "n", F.col("best.row").alias("first")), "groups")
    hot = scratch.save(hot_keys(groups.select("key", "n"), rows.count()), "hot")
    salted = with_salt(rows, hot, F.col("row")).join(for_each_salt(groups.drop("n"), hot), ["key", "salt"], "left")
    return salted.withColumn("kept", F.col("first").isNull() | (F.col("row") == F.col("first")))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Archives of all pages at path, a gzip file per task. Rows are written first, so that each has a number."""
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), F.col(payload_col).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.sha2(F.coalesce("payload", F.lit(b"")), 256)).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.save(rows, "rows")
    records = with_kept(rows, scratch).select("row", "page_id", "uri", "payload", "key", "kept").mapInArrow(_records(segment_bytes, chunk_bytes), "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)
    scratch.drop(rows)


def parsed(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """(headers, place of the block, its length) of what follows an opening line; None if that is no head of a record."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = [line.partition(":") for line in piece[:end].decode("utf-8", "replace").split("\r\n")]
    headers = {k.strip().lower(): v.strip() for k, colon, v in head if colon}
    length = headers.get("content-length", "")
    return (headers, end + 4, int(length)) if length.isdigit() and "warc-type" in headers else None


def _whole_number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def _row(headers: dict[str, str], block: bytes, whole: bool) -> dict:
    digest = headers.get("warc-payload-digest", "")
    return {
        "record_id": headers.get("warc-record-id"), "type": headers["warc-type"].lower(), "page_id": _whole_number(headers.get("x-page-id")), "uri": headers.get("warc-target-uri"),
        "refers_to_id": headers.get("warc-refers-to"), "digest": digest.partition(":")[2] or None, "origin": headers.get("warc-segment-origin-id"),
        "number": _whole_number(headers.get("warc-segment-number")), "total": _whole_number(headers.get("warc-segment-total-length")), "block": block, "whole": whole,
    }


def records_of(pieces: Iterator[tuple[object, bytes]]) -> Iterator[dict]:
    """Records of the pieces (file, bytes) between opening lines, in the order of the files.

    A piece shorter than its block goes on with the next piece of the same file: the line that cut it
    stood in the block.
    """
    held = None  # (file, bytes, headers, place, length)

    def done() -> Iterator[dict]:
        if held:
            _, data, headers, at, length = held
            yield _row(headers, data[at:at + length], len(data) >= at + length)

    for file, piece in pieces:
        if held and held[0] == file and len(held[1]) < held[3] + held[4]:
            held = (file, held[1] + OPENING + piece, *held[2:])
            continue
        yield from done()
        head = parsed(piece)
        held = (file, piece, *head) if head else None
    yield from done()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pieces():
        for batch in batches:
            yield from zip(batch.column("file").to_pylist(), batch.column("value").to_pylist())

    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("refers_to_id", pa.string()), ("digest", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("whole", pa.bool_())])
    rows, size = [], 0
    for row in records_of(pieces()):
        rows.append(row)
        size += len(row["block"])
        if size > 1 << 20 or len(rows) >= 2000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives at path as they stand there, continuations too."""
    lines = spark.read.option("lineSep", OPENING.decode()).text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return rows.mapInArrow(_parse, RECORDS)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PAYLOADS from records with their segments in order: (..., block, whole, segments)."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            block, whole = r.pop("block"), r.pop("whole")
            segments = r.pop("segments") or []
            if segments or r["number"] is not None:
                numbers = [r["number"], *[s["number"] for s in segments]]
                total = segments[-1]["total"] if segments else None
                block = b"".join([block, *[s["block"] for s in segments]])
                whole = whole and numbers == list(range(1, len(numbers) + 1)) and total == len(block) and all(s["whole"] for s in segments)
            payload = http_payload(block) if r["type"] == "response" else None
            if r["type"] == "response":
                told, r["digest"] = r["digest"], None if payload is None else base32_sha1(payload)
                whole = whole and payload is not None and told in (None, r["digest"])
            rows.append({k: r[k] for k in ("record_id", "type", "page_id", "uri", "refers_to_id", "digest")} | {"payload": payload, "whole": whole})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([(k, pa.string()) for k in ("record_id", "type")] + [("page_id", pa.int64())] + [(k, pa.string()) for k in ("uri", "refers_to_id", "digest")] + [("payload", pa.binary()), ("whole", pa.bool_())]))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives with their segments put together and their payloads decoded; revisits have no payload.

    Only records in segments are shuffled, by the id of their origin.
    """
    records = Scratch(spark, "records").save(read_records(spark, path), "records")
    main = records.where("type <> 'continuation'")
    segments = records.where("type = 'continuation' AND origin IS NOT NULL")
    own = F.sort_array(F.collect_list(F.struct("number", "total", "block", "whole"))).alias("segments")
    grouped = segments.groupBy(F.col("origin").alias("record_id")).agg(own)
    none = F.lit(None).cast("array<struct<number:int,total:bigint,block:binary,whole:boolean>>")
    cut = main.where("number IS NOT NULL").join(grouped, "record_id", "left")
    every = main.where("number IS NULL").withColumn("segments", none).unionByName(cut)
    return every.select("record_id", "type", "page_id", "uri", "refers_to_id", "digest", "number", "block", "whole", "segments").mapInArrow(_assembled, PAYLOADS)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, uri, payload_bytes, payload_digest, record_type, refers_to, whole) of every response and revisit."""
    scratch = Scratch(spark, "pages")
    told = read_payloads(spark, path).where("type IN ('response', 'revisit')")
    told = scratch.save(told.select("record_id", "type", "page_id", "uri", "refers_to_id", "digest", F.octet_length("payload").cast("long").alias("bytes"), "whole"), "told")
    responses = told.where("type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("_bytes"), F.col("digest").alias("_digest"), F.col("whole").alias("_whole"))
    revisits = told.where("type = 'revisit'")
    hot = scratch.save(hot_keys(revisits.groupBy("refers_to_id").agg(F.count("*").alias("n")), told.count()), "hot")
    found = with_salt(revisits, hot, F.col("record_id")).join(for_each_salt(responses, hot), ["refers_to_id", "salt"], "left")
    whole = F.coalesce(F.col("whole") & F.col("_whole") & (F.col("digest") == F.col("_digest")), F.lit(False))
    found = found.select("page_id", "uri", F.col("_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", whole.alias("whole"))
    kept = told.where("type = 'response'").select("page_id", "uri", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "whole")
    return kept.unionByName(found)


def op12_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_pages(spark, path).drop("uri")


OP12_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, html, strlen(html) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    ((instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 AS INT) + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 AS INT) + 2, 1)) - 1)
    // CAST(power(2, 3 - (5 * i) % 4) AS INT) % 32 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, true AS whole
FROM b
"""
