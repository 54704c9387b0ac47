"""WARC archives: records written in segments, and their reassembly.

Writing: of pages with equal payloads of SMALLEST bytes or more, the one with the smallest
page_id is a response and the others are revisits of it.  A response is an HTTP message in
chunked transfer framing; beyond SEGMENT bytes the block goes on in continuation
records that name the first record as their origin.  Archives are written by Spark's
text writer, gzip-compressed, and so by its commit protocol: a lost executor leaves no half file.

Reading: records are cut by their Content-Length, whatever the payload contains.
Continuation records are grouped by origin identifier, ordered by segment number,
checked against the total length, and the chunked framing is decoded.  Only
segmented records carry payload through the shuffle.  A revisit is complete if the response that it names
is there, is complete and has its digest and size.  Archives are read as bytes, whatever their encoding.

Defined cases: a null html is an empty payload; payloads under SMALLEST bytes are all
responses; rows that repeat the smallest page_id and payload are each a response;
a null page_id comes after all others and is read back as null; missing or superfluous segments, a wrong
total length or a wrong digest give complete = false; other columns of the pages are ignored; no pages give no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, table

SMALLEST, SEGMENT, CHUNK = 100, 16 << 10, 4 << 10
MARK = "WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def _cut(data: bytes, at: int) -> int:
    """The last place up to at that is not within a character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return min(at, len(data))


def chunked(payload: bytes) -> bytes:
    out, at = [], 0
    while at < len(payload):
        to = _cut(payload, at + CHUNK)
        out.append(b"%x\r\n%b\r\n" % (to - at, payload[at:to]))
        at = to
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return f"{MARK}{head}\r\n" + block.decode()


def _uri(url: str | None) -> str | None:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else None


def _id(uid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{uid}')}>"


def records(page_id, uid: int, url, payload: bytes, digest: str, first_page, first_url, revisit: bool) -> list[str]:
    """The WARC records of one page; uid tells it from all others, first_page and first_url are what it revisits."""
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", page_id)]
    if revisit:
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", _id(uid)), *common, ("WARC-Refers-To-Target-URI", _uri(first_url)), ("WARC-Refers-To-Date", "2024-01-01T00:00:00Z"), ("X-Refers-To-Page", first_page), ("X-Payload-Length", len(payload)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], b"")]
    block, parts, at = HTTP + chunked(payload), [], 0
    while at < len(block):
        to = _cut(block, at + SEGMENT)
        parts.append(block[at:to])
        at = to
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", _id(uid)), *common, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", _id(uid)[:-1] + f":{k}>"), ("WARC-Segment-Origin-ID", _id(uid)), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part))
    return out


def write(pages: DataFrame, path: str, scratch: Scratch) -> None:
    """Archives of pages (page_id, url, html) in the folder path."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("payload"), F.sha2(html, 256).alias("digest"))
    large = rows.where(F.octet_length("payload") >= SMALLEST)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    first = large.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("k")).where("k > 1")
    first = scratch.save(first.select(F.col("digest").alias("of"), F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url")))
    revisit = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    named = rows.join(first, F.col("digest") == F.col("of"), "left").select("page_id", "url", "payload", "digest", "first_page", "first_url", revisit.alias("revisit"))

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "first_page", "first_url", "revisit")]
            out, size = [], 0
            for row in zip(*cols, strict=True):
                page, *rest = (x.as_py() for x in row)
                own = records(page, uid, *rest)
                uid += 1
                out += own
                size += sum(map(len, own))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out)], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out)], ["value"])

    named.mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


RECORD = "origin string, segment int, total long, type string, page_id long, digest string, refers_to long, payload_bytes long, block binary"


def _parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode(errors="replace").split("\r\n") if ": " in line)
    return fields | {"block": rest[: int(fields["Content-Length"])], "short": len(rest) < int(fields["Content-Length"])}


def _cols(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def payload_of(block: bytes) -> tuple[str, int, bool]:
    """(digest, bytes, whether the framing is right) of the payload of an HTTP message."""
    try:
        payload, whole = dechunked(block.partition(b"\r\n\r\n")[2]), True
    except ValueError:
        payload, whole = b"", False
    return hashlib.sha256(payload).hexdigest(), len(payload), whole


def _row(f: dict) -> tuple:
    number = lambda k: int(f[k]) if k in f else None
    digest = f.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None
    size, block, segment = number("X-Payload-Length"), f["block"], number("WARC-Segment-Number")
    if f["WARC-Type"] == "response" and segment is None:
        # Whole already: what is asked of it is found here, and its block stays here.
        found, size, whole = payload_of(block)
        segment, block, digest = 0 if whole and found == digest else -1, None, found
    return (f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), segment, number("WARC-Segment-Total-Length"), f["WARC-Type"], number("X-Page-Id"), digest, number("X-Refers-To-Page"), size, block)


def _records(batches):
    """The text between record marks, in file order -> records; what a payload has of marks is put together again."""
    held, at = b"", None
    mark = MARK.encode()

    def rows():
        nonlocal held, at
        for batch in batches:
            for value, name in zip(batch.column("value"), batch.column("file"), strict=True):
                text, file = value.as_py(), name.as_py()
                if file != at:
                    if held:
                        yield _row(_parse(held))
                    at, held = file, text
                    continue
                if held:
                    got = _parse(held) if b"\r\n\r\n" in held else {"short": True}
                    if got["short"]:
                        held += mark + text
                        continue
                    yield _row(got)
                held = text
        if held:
            yield _row(_parse(held))

    out, size = [], 0
    for r in rows():
        out.append(r)
        size += len(r[-1] or b"")
        if size > 4 << 20 or len(out) > 10_000:
            yield _cols(out)
            out, size = [], 0
    if out:
        yield _cols(out)


def _join(batches):
    """Groups of segments -> pages."""
    for batch in batches:
        out = []
        for head, segments in zip(batch.column("head"), batch.column("segments"), strict=True):
            h, own = head.as_py(), segments.as_py()
            if h is None:
                out.append((None, None, None, None, None, False))
                continue
            if h["type"] == "revisit":
                out.append((h["page_id"], h["payload_bytes"], h["digest"], "revisit", h["refers_to"], True))
                continue
            if own[0]["block"] is None:
                out.append((h["page_id"], h["payload_bytes"], h["digest"], h["type"], None, len(own) == 1 and own[0]["segment"] == 0))
                continue
            block = b"".join(s["block"] or b"" for s in own)
            digest, size, whole = payload_of(block)
            whole = whole and [s["segment"] for s in own] == list(range(1, len(own) + 1)) and own[-1]["total"] == len(block)
            out.append((h["page_id"], size, digest, h["type"], None, whole and digest == h["digest"]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def read(spark, path: str, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, complete) of all pages in the archives of a folder."""
    scratch = scratch or Scratch(spark)
    text = spark.read.option("lineSep", MARK).text(path).select(F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file"))
    parts = text.mapInArrow(_records, RECORD)
    head = F.first(F.when(F.col("type") != "continuation", F.struct("type", "page_id", "digest", "refers_to", "payload_bytes")), ignorenulls=True)
    grouped = parts.groupBy("origin").agg(head.alias("head"), F.array_sort(F.collect_list(F.struct("segment", "total", "block"))).alias("segments"))
    pages = scratch.save(grouped.select("head", "segments").mapInArrow(_join, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, complete boolean"))
    # What is known of pages is small; revisits find their response by digest.
    named = pages.where("record_type = 'response' and complete").select(F.col("payload_digest").alias("d"), F.col("page_id").alias("p"), F.col("payload_bytes").alias("n")).distinct()
    revisits = pages.where("record_type = 'revisit'")
    found = revisits.join(named, (F.col("payload_digest") == F.col("d")) & F.col("refers_to").eqNullSafe(F.col("p")) & (F.col("payload_bytes") == F.col("n")), "left")
    return pages.where("record_type is null or record_type <> 'revisit'").unionByName(found.withColumn("complete", F.col("complete") & F.col("d").isNotNull()).drop("d", "p", "n"))


def op9(spark, sf_dir):
    scratch = Scratch(spark)
    where = scratch.path()
    write(table(spark, sf_dir, "pages"), where, scratch)
    return read(spark, where, scratch)


ORACLE = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest as d, min(page_id) as first_id from p where payload_bytes >= {SMALLEST} group by 1)
select page_id, payload_bytes, payload_digest, case when first_id is not null and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when first_id is not null and page_id <> first_id then first_id end as refers_to, true as complete
from p left join f on payload_digest = d and payload_bytes >= {SMALLEST}
"""
