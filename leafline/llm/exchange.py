"""Counting 64-bit keys across a corpus in packed blocks.

Documents are dealt to *chunks* of a few megabytes by a hash of the row.  A chunk
sends each of its distinct keys once, sorted and delta coded, in one binary row
per key range (*bucket*); so a key that fills a third of the corpus reaches its
bucket once a chunk and not once a document.  A bucket answers every row with one
bit a key - does the key occur anywhere else? - and the chunk reads the answers
beside its own documents.  Nothing is collected.

Chunks and buckets both follow the input, so their product would grow with its square.
Where a message would hold fewer than ``LEAST_KEYS`` keys, it goes in two hops: a chunk
sends to few *coarse* ranges, the messages of a group of chunks to one coarse range are
merged, and the merged keys go on to the buckets; answers come back the same way.  So
the number of messages stays in proportion to the keys (see ``Layout.messages``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
MESSAGE = "chunk long, tag int, bucket int, body binary"
MESSAGE_ARROW = pa.schema([("chunk", pa.int64()), ("tag", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])
#: Keys that a message should hold on average, and keys that a bucket or a merged group holds.
LEAST_KEYS = 256
BUCKET_KEYS = 2_000_000


@dataclass(frozen=True)
class Layout:
    """Sizes that follow the input: chunks of documents, buckets of keys, bits of a filter key,
    and for two hops the coarse ranges and the chunks that are merged (else both are 0)."""

    chunks: int
    buckets: int
    bits: int
    coarse: int = 0
    group: int = 0

    @staticmethod
    def of(df: DataFrame, text: str, chunk_bytes: int = 4 << 20, bytes_per_key: int = 6, more_bits: int = 13) -> "Layout":
        """From the total bytes of ``text``: one pass that reads only that column."""
        total = df.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return Layout.sized(total, parts, chunk_bytes, bytes_per_key, more_bits)

    @staticmethod
    def sized(total: int, parts: int, chunk_bytes: int = 4 << 20, bytes_per_key: int = 6, more_bits: int = 13, bucket_keys: int = BUCKET_KEYS, least_keys: int = LEAST_KEYS) -> "Layout":
        """For ``total`` bytes of text and at least ``parts`` chunks and buckets."""
        keys = max(1, total // bytes_per_key)
        chunks, buckets = max(parts, math.ceil(total / chunk_bytes)), max(parts, math.ceil(keys / bucket_keys))
        bits = min(64, max(24, math.ceil(math.log2(keys)) + more_bits))
        each = keys / chunks
        if each / buckets >= least_keys or chunks * buckets <= 1 << 20:
            return Layout(chunks, buckets, bits)
        # both hops have messages of equal size: each / coarse = bucket_keys * coarse / buckets
        coarse = max(2, round(math.sqrt(each * buckets / bucket_keys)))
        return Layout(chunks, buckets, bits, coarse, max(2, round(bucket_keys * coarse / each)))

    @property
    def first(self) -> int:
        """Key ranges to which a chunk sends."""
        return self.coarse or self.buckets

    def messages(self) -> int:
        """The most messages that go one way, over all hops."""
        if not self.coarse:
            return self.chunks * self.buckets
        groups = math.ceil(self.chunks / self.group)
        return self.chunks * self.coarse + groups * (self.buckets + self.coarse)


def chunked(df: DataFrame, columns: Iterable[str], text: str, chunks: int) -> DataFrame:
    """``columns`` and ``text`` as bytes, with a chunk that depends on the row's values alone."""
    keep = [F.col(c) for c in columns]
    return df.select(F.pmod(F.xxhash64(*keep, F.col(text)), F.lit(chunks)).cast("long").alias("chunk"), *keep, F.col(text).cast("binary").alias("text"))


def pack(keys: np.ndarray, flags: np.ndarray, extra: bytes = b"") -> bytes:
    """Sorted distinct keys as deltas of the fewest whole bytes, then a bit a key, then ``extra``."""
    n = len(keys)
    delta = np.diff(keys, prepend=keys[:1])
    width = max(1, (int(delta.max()).bit_length() + 7) // 8) if n else 1
    body = delta.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    head = np.array([n, width, int(keys[0]) if n else 0], dtype="<u8").tobytes()
    return head + body + np.packbits(flags).tobytes() + extra


def unpack(body: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    n, width, base = (int(x) for x in np.frombuffer(body, "<u8", 3))
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(body, np.uint8, n * width, 24).reshape(n, width)
    keys = np.cumsum(wide.reshape(-1).view("<u8").astype(U64), dtype=U64) + U64(base)
    bits = (n + 7) // 8
    flags = np.unpackbits(np.frombuffer(body, np.uint8, bits, 24 + n * width), count=n).astype(bool)
    return keys, flags, body[24 + n * width + bits :]


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and whether each occurs more than once."""
    s = np.sort(values)
    first = np.ones(len(s), dtype=bool)
    first[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(first)
    return s[at], np.diff(at, append=len(s)) > 1


def range_of(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """The key range of each key; it rises with the key."""
    use = min(bits, 40)
    return ((keys >> U64(bits - use)) * U64(ranges) >> U64(use)).astype(np.int64)


def fine_range(keys: np.ndarray, bits: int, layout: Layout) -> np.ndarray:
    """The bucket of each key; with two hops those of one coarse range lie together."""
    if not layout.coarse:
        return range_of(keys, bits, layout.buckets)
    per = -(-layout.buckets // layout.coarse)
    return range_of(keys, bits, layout.coarse * per)


def coarse_range(keys: np.ndarray, bits: int, layout: Layout) -> np.ndarray:
    """The range to which a chunk sends each key."""
    fine = fine_range(keys, bits, layout)
    return fine // -(-layout.buckets // layout.coarse) if layout.coarse else fine


def spans(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that occur in a sorted list, and where each begins, with the end of all."""
    at = np.flatnonzero(np.diff(ranges, prepend=-1)) if len(ranges) else np.zeros(0, np.int64)
    return ranges[at], np.append(at, len(ranges))


def rows(chunk: int, tag: int, buckets: list[int], bodies: list[bytes]) -> pa.Table:
    return pa.table([pa.array([chunk] * len(bodies), pa.int64()), pa.array([tag] * len(bodies), pa.int32()), pa.array(buckets, pa.int32()), pa.array(bodies, pa.binary())], schema=MESSAGE_ARROW)


def messages(chunk: int, tag: int, keys: np.ndarray, flags: np.ndarray, bits: int, layout: Layout, extra: np.ndarray | Callable[[int, int], bytes] | None = None, ranges: np.ndarray | None = None) -> pa.Table:
    """The rows of one chunk: a body for each range that has keys, with what ``extra`` has for them."""
    which, cuts = spans(coarse_range(keys, bits, layout) if ranges is None else ranges)
    more = extra if callable(extra) else (lambda a, b: b"" if extra is None else extra[a:b].tobytes())
    bodies = [pack(keys[a:b], flags[a:b], more(a, b)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return rows(chunk, tag, which.tolist(), bodies)


def _answer(table: pa.Table) -> pa.Table:
    """One bucket: which keys lie in two chunks, or twice in one?"""
    got = [unpack(b) for b in table["body"].to_pylist()]
    if got[0][2] or any(len(x[2]) for x in got):
        return _answer_wide(table, got)
    every = np.concatenate([k for k, _, _ in got])
    twice, many = distinct(every)
    twice = np.union1d(twice[many], np.concatenate([k[f] for k, f, _ in got]))
    out = []
    for keys, _, _ in got:
        i = np.searchsorted(twice, keys)
        out.append(np.packbits(twice[np.minimum(i, len(twice) - 1)] == keys if len(twice) else np.zeros(len(keys), bool)).tobytes())
    return pa.table([table["chunk"], table["tag"], table["bucket"], pa.array(out, pa.binary())], schema=MESSAGE_ARROW)


def _answer_wide(table: pa.Table, got: list[tuple[np.ndarray, np.ndarray, bytes]]) -> pa.Table:
    """The same for keys of 64 bits and 32 more, which ``extra`` holds."""
    high = np.concatenate([k for k, _, _ in got])
    low = np.concatenate([np.frombuffer(x, "<u4") for _, _, x in got])
    sizes = [len(k) for k, _, _ in got]
    order = np.lexsort((low, high))
    h, lo = high[order], low[order]
    same = (h[1:] == h[:-1]) & (lo[1:] == lo[:-1])
    # keys of a run that is longer than one, or that has a flag, are repeated
    start = np.ones(len(h), dtype=bool)
    start[1:] = ~same
    run = np.cumsum(start) - 1
    flag = np.concatenate([f for _, f, _ in got])[order]
    count = np.bincount(run) + np.bincount(run, weights=flag)
    rep = np.empty(len(h), dtype=bool)
    rep[order] = count[run] > 1
    cut = np.cumsum([0, *sizes])
    out = [np.packbits(rep[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table([table["chunk"], table["tag"], table["bucket"], pa.array(out, pa.binary())], schema=MESSAGE_ARROW)


def key_counts(bodies: list[bytes]) -> list[int]:
    return [int(np.frombuffer(b, "<u8", 1)[0]) for b in bodies]


class Bits:
    """Messages of keys, flags and perhaps 32 more bits a key; a bucket answers a bit a key."""

    def __init__(self, bits: int):
        self.bits = bits

    answer = staticmethod(_answer)

    def merge(self, bodies: list[bytes], layout: Layout) -> tuple[np.ndarray, list[bytes], list[np.ndarray]]:
        """Buckets and bodies of the distinct keys of some messages, and the place among
        them of each message's keys."""
        got = [unpack(b) for b in bodies]
        high = np.concatenate([k for k, _, _ in got])
        wide = any(len(x) for _, _, x in got)
        low = np.concatenate([np.frombuffer(x, "<u4") for _, _, x in got]) if wide else np.zeros(len(high), "<u4")
        order = np.lexsort((low, high))
        h, lo = high[order], low[order]
        start = np.ones(len(h), dtype=bool)
        start[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
        at = np.flatnonzero(start)
        place = np.empty(len(h), dtype=np.int64)
        place[order] = np.cumsum(start) - 1
        flag = np.bincount(place, weights=np.concatenate([f for _, f, _ in got]), minlength=len(at)) + np.diff(at, append=len(h)) > 1
        made = messages(0, 0, h[at], flag, self.bits, layout, np.ascontiguousarray(lo[at]) if wide else None, fine_range(h[at], self.bits, layout))
        return made["bucket"].to_numpy(), made["body"].to_pylist(), np.split(place, np.cumsum([len(k) for k, _, _ in got])[:-1])

    def sizes(self, bodies: list[bytes]) -> list[int]:
        """Items of each message, for the reading of its answer."""
        return key_counts(bodies)

    def reply(self, answers: list[bytes], sizes: list[int], places: list[np.ndarray]) -> list[bytes]:
        """Answers to the messages that were merged."""
        every = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8), count=n) for a, n in zip(answers, sizes, strict=True)])
        return [np.packbits(every[p]).tobytes() for p in places]


class Counts:
    """Messages of keys with counts, which are summed.  ``read`` and ``write`` turn the
    extra bytes of some keys into columns of counts and back, ``read_answer`` and
    ``write_answer`` those of an answer."""

    def __init__(self, bits: int, answer: Callable, read: Callable, write: Callable, read_answer: Callable, write_answer: Callable):
        self.bits, self.answer, self.read, self.write, self.read_answer, self.write_answer = bits, answer, read, write, read_answer, write_answer

    def merge(self, bodies: list[bytes], layout: Layout) -> tuple[np.ndarray, list[bytes], list[np.ndarray]]:
        got = [unpack(b) for b in bodies]
        keys, place = np.unique(np.concatenate([k for k, _, _ in got]), return_inverse=True)
        each = np.concatenate([self.read(x, len(k)) for k, _, x in got], axis=1)
        sums = np.stack([np.bincount(place, weights=c, minlength=len(keys)).astype(np.int64) for c in each])
        made = messages(0, 0, keys, np.zeros(len(keys), bool), self.bits, layout, lambda a, b: self.write(sums[:, a:b]), fine_range(keys, self.bits, layout))
        return made["bucket"].to_numpy(), made["body"].to_pylist(), np.split(place, np.cumsum([len(k) for k, _, _ in got])[:-1])

    def sizes(self, bodies: list[bytes]) -> list[int]:
        return key_counts(bodies)

    def reply(self, answers: list[bytes], sizes: list[int], places: list[np.ndarray]) -> list[bytes]:
        every = np.concatenate([self.read_answer(a, n) for a, n in zip(answers, sizes, strict=True)], axis=1)
        return [self.write_answer(every[:, p]) for p in places]


def _named(asked: DataFrame, layout: Layout) -> DataFrame:
    group = F.floor(F.col("chunk") / layout.group).cast("long")
    return asked.select((group * layout.coarse + F.col("bucket")).alias("merger"), "chunk", "tag", "bucket", "body")


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("chunk", "ascending")])


def merged(asked: DataFrame, kind, layout: Layout) -> DataFrame:
    """The messages as they reach the buckets: with two hops, merged by groups of chunks."""
    if not layout.coarse:
        return asked

    def merge(table: pa.Table) -> pa.Table:
        which, bodies, _ = kind.merge(_in_order(table)["body"].to_pylist(), layout)
        return rows(table["merger"][0].as_py(), table["tag"][0].as_py(), which.tolist(), bodies)

    return _named(asked, layout).groupBy("merger").applyInArrow(merge, MESSAGE)


def round_trip(asked: DataFrame, kind, layout: Layout) -> DataFrame:
    """The answers to messages: ``kind`` answers a bucket, and merges and parts for two hops."""
    replies = merged(asked, kind, layout).groupBy("bucket").applyInArrow(kind.answer, MESSAGE)
    if not layout.coarse:
        return replies

    def part(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return MESSAGE_ARROW.empty_table()
        table = _in_order(table)
        which, bodies, places = kind.merge(table["body"].to_pylist(), layout)
        have = dict(zip(replies["bucket"].to_pylist(), replies["body"].to_pylist(), strict=True))
        back = kind.reply([have[b] for b in which.tolist()], kind.sizes(bodies), places)
        return pa.table([table["chunk"], table["tag"], table["bucket"], pa.array(back, pa.binary())], schema=MESSAGE_ARROW)

    back = replies.withColumnRenamed("chunk", "merger")
    return _named(asked, layout).groupBy("merger").cogroup(back.groupBy("merger")).applyInArrow(part, MESSAGE)


def answer_bits(table: pa.Table, tag: int, ranges: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """The chunk's answers of one tag joined in key order.  ``ranges``: the range of each
    key sent, sorted; or the ranges that were sent to, with ``counts`` of items."""
    at = {b: body for t, b, body in zip(table["tag"].to_pylist(), table["bucket"].to_pylist(), table["body"].to_pylist(), strict=True) if t == tag}
    if counts is None:
        ranges, cuts = spans(ranges)
        counts = np.diff(cuts)
    parts = []
    for b, n in zip(ranges.tolist(), counts.tolist(), strict=True):
        if b not in at:
            raise RuntimeError(f"no answer from bucket {b}")
        parts.append(np.unpackbits(np.frombuffer(at[b], np.uint8), count=int(n)).astype(bool))
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def with_answers(docs: DataFrame, replies: DataFrame, each: Callable[[pa.Table, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """``each`` gets a chunk's documents and the answers to what it sent."""
    return docs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(each, schema)
