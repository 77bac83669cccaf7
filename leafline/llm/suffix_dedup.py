"""Suffix-array dedup: remove bytes covered by a string that starts at two places or more.

All suffixes of a corpus are too many to sort, so the suffix array is kept sparse
without losing a match.  Each window of ``length`` bytes names one *anchor*: the place
inside it whose next ``seed`` bytes hash lowest.  Equal windows name the same place, so
only windows of anchors whose seeds occur twice can repeat; a first count over the
corpus finds those seeds.  A neighbouring run of windows that share an anchor is one
*context*, a string of at most ``2 * length`` bytes.

A context is cut in two: its windows that have half of the bytes around the seed in front
of it, and the others.  All windows of a half share a *lead*, the seed and so many bytes
before or behind it (124 bytes for the usual lengths).  Contexts are range-partitioned
by their leads, with splitters from a bounded sample of leads; where there are fewer
different splitters than buckets are wanted, as beyond ``MOST_RANGES`` or where sampled
leads repeat, each range is dealt on to several buckets by a hash of the lead.  As leads are long,
a common line with different text around it is cut by many splitters.  A bucket takes
the windows of its contexts as suffixes and sorts them by multikey quicksort, eight
bytes a character; suffixes that agree in ``length`` bytes are repeated.  Splitters cut
between different leads, and equal windows have equal leads, so neighbours across two
buckets differ within their leads: no match crosses a boundary.

Equal contexts of a chunk are sent once, so a passage that fills the corpus reaches its
bucket once a chunk.  Matches never cross documents.  Strings are judged on the input.

Defined results: a null or empty text has no bytes; a text shorter than ``length``
keeps all; rows equal in id and text are two documents, each a copy of the other; a very
long text is read whole, in a block of its own; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafline.llm import exchange, kernels
from leafline.llm.exchange import U64, Layout

FILTER, SUFFIX = 0, 1
#: Leads that are sampled for splitters: from so many chunks, so many a chunk.
SAMPLE_CHUNKS, SAMPLE_EACH = 16, 2000
#: Ranges between splitters, eight sampled leads each at least.
MOST_RANGES = 4000
#: About the bytes of text for each context, and contexts that a message should hold.
CONTEXT_BYTES, LEAST_CONTEXTS = 256, 4


def anchors(data: np.ndarray, off: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors with the first and last window that name each, and the hashes of their seeds."""
    n = data.size
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    up, down = kernels.powers(kernels.BYTE_WINDOW_BASE, n + 1)
    prefix = np.zeros(n + 1, dtype=U64)
    term = data.astype(U64)
    term += U64(1)
    term *= up[:n]
    np.cumsum(term, out=prefix[1:])
    h = prefix[seed:] - prefix[:-seed]
    h *= down[: n - seed + 1]
    at = _places_of_least(h, length - seed + 1)
    p = np.flatnonzero(kernels.within(off, n, length))
    at = at[p]
    first = np.ones(len(p), dtype=bool)
    first[1:] = at[1:] != at[:-1]
    i = np.flatnonzero(first)
    return at[i], p[i], p[np.append(i[1:], len(p))[: len(i)] - 1], h[at[i]]


#: Bits of a place below a hash.  They are the same for texts of any length, so that equal windows agree.
PLACE_BITS = 22


def _places_of_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the place of the least, the leftmost of equal ones."""
    low = U64((1 << PLACE_BITS) - 1)
    span = (1 << PLACE_BITS) - width
    out = np.empty(len(h) - width + 1, dtype=np.int64)
    for a in range(0, len(out), span):
        part = h[a : a + span + width - 1] & ~low
        part |= np.arange(len(part), dtype=U64)
        out[a : a + span] = (_sliding_min(part, width) & low).astype(np.int64) + a
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


class _Chunk:
    """The anchors and contexts of one chunk's documents."""

    def __init__(self, table: pa.Table, length: int, seed: int, layout: Layout):
        self.layout, self.length, self.seed = layout, length, seed
        self.data, self.off = kernels.column_bytes(table["text"])
        found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)]
        for first, _, data, off in kernels.blocks(self.data, self.off):
            at, lo, hi, key = anchors(data, off, length, seed)
            base = self.off[first]
            found.append((at + base, lo + base, hi + base, key))
        self.at, self.lo, self.hi, key = (np.concatenate(x) for x in zip(*found, strict=True))
        self.short = key >> U64(64 - layout.bits)

    def filter_keys(self) -> tuple[np.ndarray, np.ndarray]:
        return exchange.distinct(self.short)

    def halves(self, some: np.ndarray) -> None:
        """The contexts of the anchors ``some``, cut in two, with the places of their leads."""
        at, lo, hi = self.at[some], self.lo[some], self.hi[some]
        half = (self.length - self.seed) // 2
        front, back = lo <= at - half, hi > at - half
        self.lead = np.concatenate([at[front] - half, at[back]])
        self.lo, self.hi = np.concatenate([lo[front], np.maximum(lo, at - half + 1)[back]]), np.concatenate([np.minimum(hi, at - half)[front], hi[back]])
        self.lead_bytes = self.seed + half

    def candidates(self, replies: pa.Table) -> None:
        """Keeps the anchors whose seeds occur elsewhere, in halves."""
        keys, _ = self.filter_keys()
        found = exchange.answer_bits(replies, FILTER, exchange.coarse_range(keys, self.layout.bits, self.layout))
        self.halves(found[np.searchsorted(keys, self.short)] if len(keys) else np.zeros(0, bool))

    def leads(self) -> list[bytes]:
        flat = self.data.tobytes()
        return [flat[a : a + self.lead_bytes] for a in self.lead.tolist()]

    def contexts(self, deal: "Dealt") -> tuple[dict[int, tuple[list[bytes], list[bool], list[int]]], list[bytes]]:
        """By range sent to, the distinct contexts in order with whether each occurs twice
        here and its bucket; and each half's context."""
        flat = self.data.tobytes()
        own = [flat[a:b] for a, b in zip(self.lo.tolist(), (self.hi + self.length).tolist(), strict=True)]
        times: dict[bytes, int] = {}
        place: dict[bytes, int] = {}
        # contexts of the same bytes have the same windows, so the first place does for all
        for c, b in zip(own, deal.buckets(self.leads()), strict=True):
            times[c] = times.get(c, 0) + 1
            place.setdefault(c, b)
        held: dict[int, tuple[list[bytes], list[bool], list[int]]] = {}
        for c in sorted(place):
            lists = held.setdefault(deal.coarse(place[c]), ([], [], []))
            for x, v in zip(lists, (c, times[c] > 1, place[c]), strict=True):
                x.append(v)
        return dict(sorted(held.items())), own


class Dealt:
    """Buckets of leads: ranges between splitters, and ``parts`` buckets a range."""

    def __init__(self, splitters: np.ndarray, layout: Layout):
        self.splitters, self.layout = splitters, layout
        # leads that repeat in the sample make fewer ranges, which are dealt to more parts
        self.parts = max(1, -(-layout.buckets // (len(splitters) + 1)))
        self.per = -(-(len(splitters) + 1) * self.parts // layout.coarse) if layout.coarse else 1

    def buckets(self, leads: list[bytes]) -> list[int]:
        if not len(self.splitters):
            return [zlib.crc32(x) % self.parts for x in leads]
        ranges = np.searchsorted(self.splitters, np.array(leads, dtype=self.splitters.dtype), side="right").tolist()
        return ranges if self.parts == 1 else [r * self.parts + zlib.crc32(x) % self.parts for r, x in zip(ranges, leads, strict=True)]

    def coarse(self, bucket: int) -> int:
        return bucket // self.per


class Contexts:
    """Messages of contexts; a bucket answers a bit a window."""

    def __init__(self, length: int):
        self.length, self.answer = length, _bucket(length)

    def merge(self, bodies: list[bytes], layout: Layout) -> tuple[np.ndarray, list[bytes], list[np.ndarray]]:
        got = [unpack_contexts(b) for b in bodies]
        twice: dict[bytes, bool] = {}
        bucket: dict[bytes, int] = {}
        for contexts, many, where in got:
            for c, m, b in zip(contexts, many.tolist(), where.tolist(), strict=True):
                twice[c] = m or c in twice
                bucket[c] = b
        held: dict[int, list[bytes]] = {}
        for c in sorted(bucket):
            held.setdefault(bucket[c], []).append(c)
        begin, n = {}, 0
        for b in sorted(held):
            for c in held[b]:
                begin[c] = n
                n += len(c) - self.length + 1
        places = [ranges(np.array([begin[c] for c in cs], dtype=np.int64), np.array([len(c) - self.length + 1 for c in cs], dtype=np.int64)) for cs, _, _ in got]
        return np.array(sorted(held)), [pack_contexts(held[b], [twice[c] for c in held[b]], [b] * len(held[b])) for b in sorted(held)], places

    def sizes(self, bodies: list[bytes]) -> list[int]:
        return [sum(len(c) - self.length + 1 for c in unpack_contexts(b)[0]) for b in bodies]

    reply = exchange.Bits.reply


def equal_suffixes(flat: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes at ``starts`` share their first ``length`` bytes with another.

    Multikey quicksort with characters of eight bytes: the suffixes are ordered by
    their first character, then every part of equal ones by the next, and parts of one
    are done."""
    eight = np.lib.stride_tricks.sliding_window_view(flat, 8)
    alive = np.arange(len(starts))
    group = np.zeros(len(starts), dtype=np.int64)
    for t in range(0, length, 8):
        if not len(alive):
            break
        k = eight[starts[alive] + min(t, length - 8)].view(">u8").ravel().astype(U64)
        if t == 0:
            order = np.argsort(k)
            alive, k = alive[order], k[order]
        else:
            first = np.flatnonzero(np.diff(group, prepend=-1))
            odd = k != np.repeat(k[first], np.diff(first, append=len(k)))
            if odd.any():
                split = np.zeros(int(group[-1]) + 1, dtype=bool)
                split[group[odd]] = True
                part = np.flatnonzero(split[group])
                order = part[np.lexsort((k[part], group[part]))]
                alive[part], k[part] = alive[order], k[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (group[1:] != group[:-1])
        at = np.flatnonzero(new)
        size = np.diff(at, append=len(k))
        keep = np.repeat(size > 1, size)
        group = np.repeat(np.arange(len(at)), size)[keep]
        alive = alive[keep]
    out = np.zeros(len(starts), dtype=bool)
    out[alive] = True
    return out


def pack_contexts(contexts: list[bytes], many: list[bool], buckets: list[int]) -> bytes:
    n = len(contexts)
    return np.array([n], "<u8").tobytes() + np.array([[len(c) for c in contexts], buckets], "<u4").tobytes() + np.packbits(np.array(many, bool)).tobytes() + b"".join(contexts)


def unpack_contexts(body: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Contexts, whether each occurs twice, and their buckets."""
    n = int(np.frombuffer(body, "<u8", 1)[0])
    sizes, buckets = np.frombuffer(body, "<u4", 2 * n, 8).reshape(2, n)
    bits = (n + 7) // 8
    many = np.unpackbits(np.frombuffer(body, np.uint8, bits, 8 + 8 * n), count=n).astype(bool)
    cut = (8 + 8 * n + bits + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))).tolist()
    return [body[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], many, buckets


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of ``start, start + 1, ...`` of each size, joined."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum())) if len(sizes) else np.zeros(0, np.int64)


def whole(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals without the characters that they cut."""
    part = np.append((data & 0xC0) == 0x80, False)
    for _ in range(3):
        lo = lo + (part[lo] & (lo < hi))
        hi = hi - (part[hi] & (hi > lo))
    return lo[lo < hi], hi[lo < hi]


def _bucket(length: int):
    def run(table: pa.Table) -> pa.Table:
        got = [unpack_contexts(b) for b in table["body"].to_pylist()]
        number: dict[bytes, int] = {}
        twice: list[bool] = []
        where = []
        for contexts, many, _ in got:
            ids = []
            for c, m in zip(contexts, many.tolist(), strict=True):
                i = number.setdefault(c, len(number))
                if i == len(twice):
                    twice.append(m)
                else:
                    twice[i] = True
                ids.append(i)
            where.append(np.array(ids, dtype=np.int64))
        flat = np.frombuffer(b"".join(number), dtype=np.uint8)
        sizes = np.array([len(c) for c in number], dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        times = sizes - length + 1
        rep = equal_suffixes(flat, ranges(first, times), length)
        rep |= np.repeat(np.array(twice, bool), times)
        begin = np.concatenate(([0], np.cumsum(times)[:-1]))
        body = [np.packbits(rep[ranges(begin[ids], times[ids])]).tobytes() for ids in where]
        return pa.table([table["chunk"], table["tag"], table["bucket"], pa.array(body, pa.binary())], schema=exchange.MESSAGE_ARROW)

    return run


def remove_repeated(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, seed: int = 48, bucket_bytes: int = 8 << 20, layouts: tuple[Layout, Layout] | None = None, carry: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """One row per document: ``key``, ``n_bytes``, ``n_removed``, ``removed`` (maximal byte
    intervals, end exclusive) and ``kept`` (the remaining bytes, joined).

    ``layouts``: of the seeds and of the contexts, else made to the size of the input.
    ``carry``: other columns that come along.  ``whole_characters``: intervals shrink to
    whole UTF-8 characters, so that what is kept is a text again."""
    if not 8 <= seed < length:
        raise ValueError("seed is from 8 to length - 1")
    spark = df.sparkSession
    if layouts is None:
        total = df.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        layouts = (Layout.sized(total, parts, bytes_per_key=(length - seed) // 2), Layout.sized(total, parts, bytes_per_key=CONTEXT_BYTES, bucket_keys=max(1, bucket_bytes // CONTEXT_BYTES), least_keys=LEAST_CONTEXTS))
    layout, to = layouts
    carried = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)), F.lit(None).cast("int").alias("c"))
    docs = df.select(F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(layout.chunks)).cast("long").alias("chunk"), F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), carried.alias("carried"))

    def ask_seeds(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, length, seed, layout)
        return exchange.messages(table["chunk"][0].as_py(), FILTER, *chunk.filter_keys(), layout.bits, layout)

    def sample(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, length, seed, layout)
        chunk.halves(np.argsort(chunk.short * U64(kernels.MIX_1))[: SAMPLE_EACH // 2])
        return pa.table({"lead": pa.array(chunk.leads(), pa.binary())})

    step = max(1, layout.chunks // SAMPLE_CHUNKS)
    leads = docs.where(F.col("chunk") % step == 0).where(F.col("chunk") < step * SAMPLE_CHUNKS).groupBy("chunk").applyInArrow(sample, "lead binary").toArrow()["lead"].to_pylist()
    leads.sort()
    many = min(to.buckets, MOST_RANGES)
    deal = Dealt(np.unique(np.array([leads[len(leads) * b // many] for b in range(1, many)] if leads else [], dtype=f"S{seed + (length - seed) // 2}")), to)

    def ask_suffixes(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return exchange.MESSAGE_ARROW.empty_table()
        chunk = _Chunk(table, length, seed, layout)
        chunk.candidates(replies)
        held, _ = chunk.contexts(deal)
        return exchange.rows(table["chunk"][0].as_py(), SUFFIX, list(held), [pack_contexts(*lists) for lists in held.values()])

    found = exchange.round_trip(docs.groupBy("chunk").applyInArrow(ask_seeds, exchange.MESSAGE), exchange.Bits(layout.bits), layout)
    sorted_ = exchange.round_trip(exchange.with_answers(docs, found, ask_suffixes, exchange.MESSAGE), Contexts(length), to)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = _Chunk(table, length, seed, layout)
        chunk.candidates(replies)
        held, own = chunk.contexts(deal)
        counts = np.array([sum(len(c) - length + 1 for c in h) for h, _, _ in held.values()], dtype=np.int64)
        bits = exchange.answer_bits(replies, SUFFIX, np.array(list(held), dtype=np.int64), counts)
        begin, n = {}, 0
        for h, _, _ in held.values():
            for c in h:
                begin[c] = n
                n += len(c) - length + 1
        times = chunk.hi - chunk.lo + 1
        windows = ranges(chunk.lo, times)
        rep = bits[ranges(np.array([begin[c] for c in own], dtype=np.int64), times)] if len(own) else np.zeros(0, bool)
        gone = kernels.covered(windows[rep], length, chunk.data.size)
        size, removed, spans, kept = [], [], [], []
        for a, b in zip(chunk.off[:-1].tolist(), chunk.off[1:].tolist(), strict=True):
            mask = gone[a:b]
            lo, hi = kernels.runs(mask)
            if whole_characters and len(lo):
                lo, hi = whole(chunk.data[a:b], lo, hi)
                mask = np.zeros(b - a, dtype=bool)
                mask[ranges(lo, hi - lo)] = True
            size.append(b - a)
            removed.append(int((hi - lo).sum()))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi, strict=True)])
            kept.append(chunk.data[a:b][~mask].tobytes() if len(lo) else chunk.data[a:b].tobytes())
        return pa.table({"key": table["key"], "carried": table["carried"], "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    made = "n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary"
    schema = StructType([docs.schema["key"], docs.schema["carried"], *StructType.fromDDL(made)])
    out = exchange.with_answers(docs, found.unionByName(sorted_), finish, schema)
    return out.select(F.col("key").alias(key), *(F.col(f"carried.c{k}").alias(c) for k, c in enumerate(carry)), "n_bytes", "n_removed", "removed", "kept")
