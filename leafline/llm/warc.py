"""WARC archives: written with segments and chunked transfer framing, and read back.

Writing.  A page becomes one WARC/1.1 record whose block is an HTTP message in chunked
transfer framing.  Blocks longer than ``segment_bytes`` are cut: the first record has
``WARC-Segment-Number: 1``, the others are ``continuation`` records that name the
first in ``WARC-Segment-Origin-ID``, and the last has ``WARC-Segment-Total-Length``.
Records are written in no order, so segments of a page can lie in any file.  Of the
records with equal payloads of at least ``revisit_bytes`` bytes, those with the
largest id are responses, all others ``revisit`` records without a payload.

Reading.  Files are parsed record by record by their lengths.  Segments are grouped
by the origin's id, ordered by number, joined, and held against the total length and
against the numbers 1 to n; then the chunked framing is decoded.  A revisit's payload
is that of the record it refers to.

Defined results: a null payload is empty; a null id is an empty field and read back as
null, and such a row is a revisit if any copy has an id, else a response; rows
that are equal in id and payload are records of their own, with equal results, and
all that share the largest id are responses; a record whose segments are missing,
doubled or of the wrong length, or whose framing is broken, is returned with
``complete`` false and no digest; a very long payload is cut into segments and never
lies in one record; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm import scratch

END = b"\r\n\r\n"
DATE = b"2024-01-01T00:00:00Z"
PART = "record string, type string, url string, page_id long, origin string, number int, total long, digest string, refers long, block binary, complete boolean, payload_bytes long, payload_digest string"
PART_ARROW = pa.schema([("record", pa.string()), ("type", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("refers", pa.int64()), ("block", pa.binary()), ("complete", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
FIELDS = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def chunk_frame(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = body[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n, at = int(size, 16), line + 2
        if n == 0:
            trailer = body[at:]
            return b"".join(out) if trailer == b"\r\n" or trailer.endswith(END) else None
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def _record(kind: bytes, record: str, fields: list[tuple[bytes, str]], block: bytes) -> bytes:
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <%s>" % record.encode(), b"WARC-Date: " + DATE]
    head += [b"%s: %s" % (k, v.encode()) for k, v in fields]
    return b"\r\n".join([*head, b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]) + END + block + END


def records(page_id: int | None, copy: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The record of one page, or its first record and continuations."""
    page = "" if page_id is None else str(page_id)
    name = f"urn:page:{page}:{copy & 0xFFFFFFFFFFFFFFFF:016x}"
    fields = [(b"WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "")), (b"WARC-Payload-Digest", f"sha1:{digest}"), (b"WARC-Page-ID", page)]
    if refers_to is not None:
        more = [(b"WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), (b"WARC-Refers-To-Page-ID", str(refers_to))]
        yield _record(b"revisit", name, fields + more, HEAD)
        return
    block = HEAD + chunk_frame(payload, chunk_bytes)
    cuts = range(0, len(block), segment_bytes)
    if len(cuts) == 1:
        yield _record(b"response", name, fields, block)
        return
    for k, at in enumerate(cuts):
        own = [(b"WARC-Segment-Number", str(k + 1))]
        if k:
            own.append((b"WARC-Segment-Origin-ID", f"<{name}>"))
        if k == len(cuts) - 1:
            own.append((b"WARC-Segment-Total-Length", str(len(block))))
        yield _record(b"continuation" if k else b"response", f"{name}:{k + 1}" if k else name, (own if k else fields + own), block[at : at + segment_bytes])


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 1000, segment_bytes: int = 16 << 10, chunk_bytes: int = 4 << 10, file_records: int = 2048) -> None:
    """Writes the archives under ``path``.  A file holds at most ``file_records`` records of
    at most ``segment_bytes`` bytes, so a reader can hold any file in memory."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # who revisits whom is found among ids and digests; payloads then meet it by their own ids, so
    # the payloads that are all alike do not meet in one task
    ids = rows.where(F.octet_length("payload") >= revisit_bytes).select("page_id", "digest")
    copies = ids.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    revisits = ids.join(copies, "digest").where(~F.col("last").eqNullSafe(F.col("page_id"))).select(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest"), F.col("last").alias("refers_to")).distinct()
    told = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left").select("page_id", "url", "payload", "digest", "refers_to", F.monotonically_increasing_id().alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, where, payload, digest, refers, copy = row
                for record in records(page, copy, where, payload, digest, refers, segment_bytes, chunk_bytes):
                    out.append(record[: -len(END)])
                    size += len(record)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # a record is bytes, some of them half characters; the text writer writes them as they are
    lines = told.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("maxRecordsPerFile", file_records).option("compression", "gzip").text(path)


def parse(content: bytes) -> Iterator[tuple[dict[bytes, str], bytes]]:
    """Header fields and block of each record of a file."""
    at = 0
    while at < len(content):
        if not content.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = content.index(END, at)
        first = content.index(b"\r\n", at) + 2
        fields = {k.lower(): v.decode() for k, v in FIELDS.findall(content, first, head + 2)}
        n = int(fields[b"content-length"])
        block = content[head + 4 : head + 4 + n]
        if len(block) != n or content[head + 4 + n : head + 8 + n] != END:
            raise ValueError(f"record at byte {at} is cut off")
        yield fields, block
        at = head + 8 + n


def _payload(block: bytes) -> bytes | None:
    head = block.find(END)
    if head < 0:
        return None
    chunked = re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", block[:head])
    return unchunk(block[head + 4 :]) if chunked else block[head + 4 :]


def decoded(kind: str, stated: str | None, block: bytes) -> tuple[bool, int | None, str | None]:
    """Whether a whole record is good, and its payload's length and digest; a revisit only has a digest."""
    if kind == "revisit":
        return True, None, (stated or "")[5:] or None
    payload = _payload(block)
    if payload is None:
        return False, None, None
    digest = hashlib.sha1(payload).hexdigest()
    good = stated in (None, f"sha1:{digest}")
    return good, len(payload) if good else None, digest if good else None


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each file: whole ones decoded, segments with their blocks."""
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for fields, block in parse(unzipped(content.as_py())):
                bare = lambda k, f=fields: f[k].strip("<>") if k in f else None
                number = lambda k, f=fields: int(f[k]) if f.get(k) else None
                kind, segment, digest = fields[b"warc-type"], number(b"warc-segment-number"), fields.get(b"warc-payload-digest")
                made = decoded(kind, digest, block) if segment is None else (None, None, None)
                rows.append((bare(b"warc-record-id"), kind, fields.get(b"warc-target-uri"), number(b"warc-page-id"), bare(b"warc-segment-origin-id"), segment, number(b"warc-segment-total-length"), digest, number(b"warc-refers-to-page-id"), None if segment is None else block, *made))
            for k in range(0, max(1, len(rows)), 512):
                columns = list(zip(*rows[k : k + 512], strict=True)) or [[]] * len(PART_ARROW)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PART_ARROW, strict=True)], schema=PART_ARROW)


def unzipped(content: bytes) -> bytes:
    """A file's bytes; gzip files may have any number of members."""
    out = []
    while content[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        out += [one.decompress(content), one.flush()]
        content = one.unused_data
    return b"".join([*out, content])


WHOLE = pa.schema([("type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers", pa.int64()), ("segments", pa.int32()), ("complete", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
WHOLE_DDL = "type string, page_id long, url string, refers long, segments int, complete boolean, payload_bytes long, payload_digest string"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the segments of each record and decodes its payload."""
    for batch in batches:
        rows = []
        for parts in batch.column(0).to_pylist():
            first = next((p for p in parts if p["type"] != "continuation"), parts[0])
            block = b"".join(p["block"] for p in parts)
            joined = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block)
            made = decoded(first["type"], first["digest"], block) if joined else (False, None, None)
            rows.append((first["type"], first["page_id"], first["url"], first["refers"], len(parts), *made))
        columns = list(zip(*rows, strict=True)) or [[]] * len(WHOLE)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, WHOLE, strict=True)], schema=WHOLE)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, segments joined: ``page_id``, ``url``, ``record_type``, ``refers_to``, ``segments``,
    ``complete``, ``payload_bytes`` and ``payload_digest`` (lower-case hex SHA-1)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    # what follows needs the records more than once, but the files only once
    parts = scratch.stored(files.mapInArrow(_parts, PART), "warc-records")
    columns = ["number", "type", "page_id", "url", "total", "digest", "refers", "block"]
    single = parts.where("number IS NULL").select("type", "page_id", "url", "refers", F.lit(1).alias("segments"), "complete", "payload_bytes", "payload_digest")
    cut = parts.where("number IS NOT NULL").groupBy(F.coalesce("origin", "record").alias("origin")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("parts"))
    whole = single.unionByName(cut.select("parts").mapInArrow(_whole, WHOLE_DDL))
    # a revisit has the digest; its length is that of the payload it refers to
    held = whole.where("type = 'response' AND complete").groupBy(F.col("page_id").alias("refers"), "payload_digest").agg(F.max("payload_bytes").alias("held_bytes"))
    rows = whole.where("type = 'revisit'").join(held, ["refers", "payload_digest"], "left")
    rows = rows.select(*whole.columns[:-3], (F.col("complete") & F.col("held_bytes").isNotNull()).alias("complete"), F.col("held_bytes").alias("payload_bytes"), "payload_digest")
    every = whole.where("type <> 'revisit'").unionByName(rows)
    return every.select("page_id", "url", F.col("type").alias("record_type"), F.col("refers").alias("refers_to"), "segments", "complete", "payload_bytes", "payload_digest")
