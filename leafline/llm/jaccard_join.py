"""N-gram Jaccard join by vertical partitioning of the n-gram order.

1. Shingles that lie in one document alone cannot be shared.  Counting leading hash
   bits over the corpus (``exchange``) leaves the documents of which enough shingles
   occur elsewhere; documents with equal sets are one class from here on.
2. Among the classes' sets a second count gives each shingle its document frequency.
   The global order is by falling rarity; a set's prefix is the part that two similar
   sets cannot both miss.
3. Sets that share a prefix shingle are compared, in rounds.  The first links
   sets to hubs: for the rarest and commonest shingles of a prefix, the set with the
   least random priority and the neighbour in size.  The next compare sets of
   different components at a few distances in random orders.  The last compares all
   that are in different components then.  So a group of near copies costs some
   comparisons a member and not one for every pair, and no link that joins two
   components is missed.
4. A comparison is made in fragments: the global order is cut into ``fragments`` ranges of
   about equally many items, rarest first; the overlaps of each range are counted apart,
   and summed per pair.

Shingles are runs of ``width`` words, words being ``[^\\x20\\x09-\\x0D]+`` with A-Z in
lower case; shorter texts have their whole sequence as one shingle.

Defined results: ids name documents; a null or empty text, or one without words, has no shingles and links
with nothing; a similarity of exactly the threshold links; equal rows that repeat are
one node, so equal rows get equal results; rows that share an id and differ in text come
out each with the size of its own set, but are one node that has the links of both; rows
with a null id get a null component; a very long text is read whole, in a block of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafline.llm import exchange, kernels, scratch
from leafline.llm.components import components
from leafline.llm.exchange import U64, Layout

FILTER, RARITY = 0, 1
#: How far apart in a random order sets are compared before all that are still apart are.
DISTANCES = (1, 2, 3, 5, 8, 11, 15, 20, 27, 36, 48, 64, 85, 113, 150, 200)
#: Rounds of such comparisons, each in another order.
NEIGHBOUR_ROUNDS = 2


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and their offsets."""
    sets = []
    for _, _, block, block_off in kernels.blocks(data, off):
        lower = kernels.LOWER[block]
        starts, ends, word_off = kernels.word_bounds(lower, block_off)
        words = kernels.word_hashes(lower, starts, ends)
        h = kernels.mix(kernels.windows(words, width, kernels.WORD_BASE) + U64(width))
        for a, b in zip(word_off[:-1].tolist(), word_off[1:].tolist(), strict=True):
            n = b - a
            if n >= width:
                sets.append(np.unique(h[a : b - width + 1]))
            elif n:
                sets.append(kernels.mix(kernels.windows(words[a:b], n, kernels.WORD_BASE) + U64(n)))
            else:
                sets.append(np.zeros(0, U64))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.concatenate(([0], np.cumsum(sizes)))


class _Chunk:
    def __init__(self, table: pa.Table, width: int, layout: Layout):
        self.layout = layout
        self.h, self.off = shingles(*kernels.column_bytes(table["text"]), width)
        self.short = self.h >> U64(64 - layout.bits)

    def filter_keys(self) -> tuple[np.ndarray, np.ndarray]:
        return exchange.distinct(self.short)

    def shared(self, replies: pa.Table) -> np.ndarray:
        keys, _ = self.filter_keys()
        found = exchange.answer_bits(replies, FILTER, exchange.coarse_range(keys, self.layout.bits, self.layout))
        return found[np.searchsorted(keys, self.short)] if len(keys) else np.zeros(0, bool)


def _least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` must share with any similar set."""
    return -(-percent * n // 100)


def shared_sets(df: DataFrame, key: str, text: str, width: int, percent: int, layout: Layout | None = None) -> DataFrame:
    """``id``, ``n``, and for documents of which enough shingles occur elsewhere ``sig``
    (a digest of the set) and ``shared`` (those shingles; null in rows that repeat)."""
    layout = layout or Layout.of(df, text)
    docs = exchange.chunked(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), ["key"], "text", layout.chunks)

    def ask(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, width, layout)
        return exchange.messages(table["chunk"][0].as_py(), FILTER, *chunk.filter_keys(), layout.bits, layout)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = _Chunk(table, width, layout)
        found = chunk.shared(replies)
        size, sig, shared, seen = [], [], [], set()
        for k, a, b in zip(table["key"].to_pylist(), chunk.off[:-1].tolist(), chunk.off[1:].tolist(), strict=True):
            own = found[a:b]
            size.append(b - a)
            if k is None or a == b or int(own.sum()) < _least_overlap(b - a, percent):
                sig.append(None)
                shared.append(None)
                continue
            digest = hashlib.blake2b(chunk.h[a:b].tobytes(), digest_size=16).digest()
            sig.append(digest)
            shared.append(None if (k, digest) in seen else chunk.h[a:b][own].tobytes())
            seen.add((k, digest))
        return pa.table({"id": table["key"].cast(pa.int64()), "n": pa.array(size, pa.int64()), "sig": pa.array(sig, pa.binary()), "shared": pa.array(shared, pa.binary())})

    found = exchange.round_trip(docs.groupBy("chunk").applyInArrow(ask, exchange.MESSAGE), exchange.Bits(layout.bits), layout)
    return exchange.with_answers(docs, found, finish, "id long, n long, sig binary, shared binary")


def _rarity(table: pa.Table) -> pa.Table:
    """One bucket: the class of each key's document frequency, 0 for a single document."""
    got = [exchange.unpack(b) for b in table["body"].to_pylist()]
    keys, of = np.unique(np.concatenate([k for k, _, _ in got]), return_inverse=True)
    n = np.bincount(of, weights=np.concatenate([np.frombuffer(x, "<u4") for _, _, x in got]), minlength=len(keys))
    level = np.minimum(255, np.floor(4 * np.log2(n))).astype(np.uint8)
    cut = np.cumsum([0, *(len(k) for k, _, _ in got)])
    body = [level[of[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table([table["chunk"], table["tag"], table["bucket"], pa.array(body, pa.binary())], schema=exchange.MESSAGE_ARROW)


def _u4(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(body, "<u4", n)[None, :].astype(np.int64)


def ordered_sets(sets: DataFrame, percent: int, layout: Layout | None = None) -> DataFrame:
    """``id``, ``n``, ``items`` (shared shingles in the global order, rarest first), ``classes`` (a
    byte for each: the class of its document frequency), ``prefix`` (those of the prefix),
    ``skip`` (unshared ones before them) and ``levels`` (their classes) of sets that can link."""
    if layout is None:
        parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total = sets.agg(F.sum(F.octet_length("shared")).alias("n")).first()["n"] or 0
        layout = Layout.sized(total, parts, bytes_per_key=8)
    chunks = layout.chunks
    rows = sets.select(F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("long").alias("chunk"), "id", "n", "shared")

    def hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        data, off = kernels.column_bytes(table["shared"])
        return np.frombuffer(data.tobytes(), U64), off // 8

    def ask(table: pa.Table) -> pa.Table:
        keys, n = np.unique(hashes(table)[0], return_counts=True)
        return exchange.messages(table["chunk"][0].as_py(), RARITY, keys, np.zeros(len(keys), bool), 64, layout, n.astype("<u4"))

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["id", "n", "items", "prefix", "skip", "levels", "classes"]
        h, off = hashes(table) if len(table) else (np.zeros(0, U64), np.zeros(1, np.int64))
        keys, of = np.unique(h, return_inverse=True)
        at = dict(zip(replies["bucket"].to_pylist(), replies["body"].to_pylist(), strict=True))
        level = np.frombuffer(b"".join(at[b] for b in exchange.spans(exchange.coarse_range(keys, 64, layout))[0].tolist()), np.uint8)[of]
        out = []
        for k, n, a, b in zip(table["id"].to_pylist(), table["n"].to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
            keep = level[a:b] > 0
            items, lv = h[a:b][keep], level[a:b][keep]
            least = _least_overlap(n, percent)
            if len(items) < least:
                continue
            skip = n - len(items)
            order = np.lexsort((items, lv))
            items, lv = items[order], lv[order]
            size = max(0, n - least + 1 - skip)
            out.append((k, n, items.tobytes(), items[:size].tobytes(), skip, lv[:size].tobytes(), lv.tobytes()))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    kind = exchange.Counts(64, _rarity, _u4, lambda c: c[0].astype("<u4").tobytes(), lambda b, n: np.frombuffer(b, np.uint8, n)[None, :], lambda a: a[0].tobytes())
    told = exchange.round_trip(rows.groupBy("chunk").applyInArrow(ask, exchange.MESSAGE), kind, layout)
    return exchange.with_answers(rows, told, finish, "id long, n long, items binary, prefix binary, skip long, levels binary, classes binary")


ENTRY = np.dtype([("h", "<u8"), ("id", "<i8"), ("n", "<i8"), ("at", "<i4"), ("side", "<i4"), ("component", "<i8")])
#: Sets with one shingle that are one group of work; a commoner shingle is many groups.
MOST_IN_GROUP = 200_000


def _prefix_entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The entries of some prefixes, the group count that the frequency of each shingle
    asks for, each entry's place in its prefix and the prefix's size."""
    ids, n, skip, component = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 5))
    data, off = kernels.column_bytes(batch.column(2))
    h = np.frombuffer(data.tobytes(), U64)
    level = kernels.column_bytes(batch.column(4))[0]
    size = np.diff(off // 8)
    e = np.zeros(len(h), dtype=ENTRY)
    e["h"], e["id"], e["n"], e["component"], e["side"] = h, np.repeat(ids, size), np.repeat(n, size), np.repeat(component, size), -1
    nth = np.arange(len(h)) - np.repeat((off // 8)[:-1], size)
    e["at"] = nth + np.repeat(skip, size)
    return e, level, nth, np.repeat(size, size)


def _groups(level: np.ndarray, most: int) -> np.ndarray:
    """Groups into which the sets of a shingle of that frequency class are dealt."""
    return np.ceil(2.0 ** ((level.astype(np.float64) + 1) / 4) / most).astype(np.int64)


def _regrouped(h: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Another key for each group of a shingle that is dealt to many."""
    return kernels.mix(h + kernels.mix(group.astype(U64) + U64(1)))


def _packed(e: np.ndarray, buckets: int) -> pa.RecordBatch:
    e = e[np.argsort(e["h"])]
    at, cuts = exchange.spans(exchange.range_of(e["h"], 64, buckets))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([e[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())], names=["bucket", "body"])


def _entries(buckets: int, most: int, salt: int | None, ends: int | None = None):
    """The prefixes of a batch of sets as packed entries of each key range; with ``ends``,
    only so many of the rarest and of the commonest shingles of each prefix.  The sets of
    a shingle in more than ``most`` sets are dealt to groups by ``salt``, or left out if
    that is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, level, nth, size = _prefix_entries(batch)
            groups = _groups(level, most)
            hot = groups > 1
            if salt is None:
                keep = ~hot
            else:
                dealt = kernels.mix(e["id"].astype(U64) + U64(salt << 32)) % groups.astype(U64)
                e["h"] = np.where(hot, _regrouped(e["h"], dealt), e["h"])
                keep = np.ones(len(e), bool) if ends is None else (nth < ends) | (nth >= size - ends)
            yield _packed(e[keep], buckets)

    return run


HOT = "h long, groups long, id long, n long, at int, component long"


def _hot_entries(most: int):
    """The entries of shingles in more than ``most`` sets, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, level, _, _ = _prefix_entries(batch)
            groups = _groups(level, most)
            e, groups = e[groups > 1], groups[groups > 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e["h"]).view(np.int64)), pa.array(groups), pa.array(e["id"]), pa.array(e["n"]), pa.array(e["at"]), pa.array(e["component"])], names=["h", "groups", "id", "n", "at", "component"])

    return run


def _in_pairs_of_groups(buckets: int):
    """Hot entries as packed entries of every pair of groups that has their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, groups, ids, n, at, component = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            own = (kernels.mix(ids.astype(U64)) % groups.astype(U64)).astype(np.int64)
            begin = np.cumsum(groups) - groups
            other = np.arange(int(groups.sum())) - np.repeat(begin, groups)
            e = np.zeros(len(other), dtype=ENTRY)
            for name, column in (("id", ids), ("n", n), ("at", at), ("component", component)):
                e[name] = np.repeat(column, groups)
            own, groups = np.repeat(own, groups), np.repeat(groups, groups)
            pair = np.minimum(own, other) * groups + np.maximum(own, other)
            e["h"] = _regrouped(np.repeat(h.view(U64), batch.column(1).to_numpy()), pair)
            e["side"] = np.where(own == other, -1, own)
            yield _packed(e, buckets)

    return run


def _fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes, and the places of the shared shingle, allow a link."""
    least = -(-percent * (a["n"] + b["n"]) // (100 + percent))
    return (100 * np.minimum(a["n"], b["n"]) >= percent * np.maximum(a["n"], b["n"])) & (np.minimum(a["n"] - a["at"], b["n"] - b["at"]) >= least)


def _pair_table(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Distinct pairs, the lesser id first, and in how many shingles each was met."""
    swap = a["id"] > b["id"]
    lo, hi = np.where(swap, b["id"], a["id"]), np.where(swap, a["id"], b["id"])
    nlo, nhi = np.where(swap, b["n"], a["n"]), np.where(swap, a["n"], b["n"])
    order = np.lexsort((hi, lo))
    lo, hi, nlo, nhi = lo[order], hi[order], nlo[order], nhi[order]
    new = np.ones(len(lo), dtype=bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    at = np.flatnonzero(new)
    return pa.table({"a": lo[at], "b": hi[at], "na": nlo[at], "nb": nhi[at], "met": np.diff(at, append=len(lo)).astype(np.int64)})


PAIR = "a long, b long, na long, nb long, met long"


def _hubs(percent: int):
    def hub_pairs(table: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(table["body"].to_pylist()), dtype=ENTRY)
        e = e[np.lexsort((kernels.mix(e["id"].astype(U64)), e["h"]))]
        first = np.flatnonzero(np.diff(e["h"], prepend=~e["h"][:1]) != 0)
        hub = e[np.repeat(first, np.diff(first, append=len(e)))]
        by_size = e[np.lexsort((e["id"], e["n"], e["h"]))]
        a, b = np.concatenate([e, by_size[1:]]), np.concatenate([hub, by_size[:-1]])
        ok = (a["h"] == b["h"]) & (a["id"] != b["id"]) & _fits(a, b, percent)
        return _pair_table(a[ok], b[ok])

    return hub_pairs


def _neighbours(percent: int, salt: int):
    def neighbour_pairs(table: pa.Table) -> pa.Table:
        """In each shingle's sets, in one random order, those of different components at a few distances."""
        e = np.frombuffer(b"".join(table["body"].to_pylist()), dtype=ENTRY)
        e = e[np.lexsort((kernels.mix(e["id"].astype(U64) + U64(salt << 40)), e["h"]))]
        left, right = [e[:0]], [e[:0]]
        for d in DISTANCES:
            a, b = e[d:], e[:-d]
            ok = (a["h"] == b["h"]) & (a["component"] != b["component"]) & _fits(a, b, percent)
            left.append(a[ok])
            right.append(b[ok])
        return _pair_table(np.concatenate(left), np.concatenate(right))

    return neighbour_pairs


def _across(percent: int, block: int = 1 << 20):
    def cross_pairs(table: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(table["body"].to_pylist()), dtype=ENTRY)
        e = e[np.lexsort((e["n"], e["component"], e["h"]))]
        first = np.flatnonzero(np.diff(e["h"], prepend=~e["h"][:1]) != 0)
        end = np.append(first[1:], len(e))
        mixed = e["component"][first] != e["component"][end - 1]
        found = [_pair_table(e[:0], e[:0])]
        left, right, held = [], [], 0
        for s, t in zip(first[mixed].tolist(), end[mixed].tolist(), strict=True):
            step = np.flatnonzero(np.diff(e["component"][s:t], prepend=-1)) + s
            for u, v in zip(step[:-1].tolist(), step[1:].tolist(), strict=True):  # members [u, v) against the later components
                rest, span = t - v, max(1, block // (t - v))
                for w in range(u, v, span):
                    x = min(v, w + span)
                    a, b = np.repeat(e[w:x], rest), np.tile(e[v:t], x - w)
                    ok = _fits(a, b, percent) & ((a["side"] < 0) | (a["side"] != b["side"]))
                    left.append(a[ok])
                    right.append(b[ok])
                    held += int(ok.sum())
                if held > block:
                    found.append(_pair_table(np.concatenate(left), np.concatenate(right)))
                    left, right, held = [], [], 0
        if left:
            found.append(_pair_table(np.concatenate(left), np.concatenate(right)))
        return pa.concat_tables(found)

    return cross_pairs


def _places(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The place of shingles in the global order, to 56 bits: by class, then by hash."""
    return classes.astype(U64) << U64(56) | h >> U64(8)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many items lie in each of 65,536 steps of the order."""
    for batch in batches:
        h = np.frombuffer(kernels.column_bytes(batch.column(0))[0].tobytes(), U64)
        step, n = np.unique(_places(h, kernels.column_bytes(batch.column(1))[0]) >> U64(48), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(step.astype(np.int32)), pa.array(n.astype(np.int64))], names=["step", "n"])


def fragment_bounds(ordered: DataFrame, n: int) -> list[int]:
    """Where the global order is cut into ``n`` fragments of about equally many items, in steps."""
    counts = ordered.select("items", "classes").mapInArrow(_steps, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").toArrow()
    ends = np.cumsum(np.array(counts["n"], dtype=np.int64))
    steps = np.array(counts["step"])
    return [int(steps[np.searchsorted(ends, ends[-1] * k // n)]) for k in range(1, n)] if len(steps) else []


def _fragments(bounds: list[int]):
    """The items of each set, cut at fixed places of the order."""
    cut = np.array(bounds, dtype=U64) << U64(48)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, part, body = [], [], []
            for k, items, classes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = np.frombuffer(items, U64)
                cuts = [0, *np.searchsorted(_places(h, np.frombuffer(classes, np.uint8)), cut).tolist(), len(h)]
                for f, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if a < b:
                        ids.append(k)
                        part.append(f)
                        body.append(h[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(part, pa.int32()), pa.array(body, pa.binary())], names=["id", "fragment", "items"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """How many items two sets share in one fragment; few sets are copied at once."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            n = [len(np.intersect1d(np.frombuffer(x, U64), np.frombuffer(y, U64), assume_unique=True)) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], names=["a", "b", "na", "nb", "common"])


def links(pairs: DataFrame, ordered: DataFrame, percent: int, bounds: list[int]) -> DataFrame:
    """The pairs that reach the threshold; overlaps are counted in fragments of the order and summed."""
    cut = ordered.select("id", "items", "classes").mapInArrow(_fragments(bounds), "id long, fragment int, items binary")
    spread = pairs.select("a", "b", "na", "nb", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))).alias("fragment"))
    one = spread.join(cut.select(F.col("id").alias("a"), "fragment", F.col("items").alias("x")), ["a", "fragment"])
    both = one.join(cut.select(F.col("id").alias("b"), "fragment", F.col("items").alias("y")), ["b", "fragment"])
    parts = both.select("a", "b", "na", "nb", "x", "y").mapInArrow(_overlaps, "a long, b long, na long, nb long, common long")
    summed = parts.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return summed.where(F.col("common") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("common")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, fragments: int = 2, hubs: int = 3, layout: Layout | None = None, most: int = MOST_IN_GROUP, bucket_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: ``key``, ``n_shingles`` and ``component_id``, the least id that
    it reaches by links of Jaccard similarity of at least ``percent`` hundredths.

    The key ranges in which sets meet hold about ``bucket_bytes`` of entries; a shingle
    that more than ``most`` sets share is many groups of work."""
    spark = df.sparkSession
    sets = scratch.stored(shared_sets(df, key, text, width, percent, layout), "sets")
    some = sets.where("sig IS NOT NULL")
    classes = some.groupBy("sig").agg(F.min("id").alias("class"))
    own = some.where("shared IS NOT NULL").join(classes, (some["sig"] == classes["sig"]) & (some["id"] == classes["class"])).select(some["id"], "n", "shared")
    ordered = scratch.stored(ordered_sets(own, percent, layout), "ordered")
    bounds = fragment_bounds(ordered, fragments)
    entries = (ordered.agg(F.sum(F.octet_length("prefix")).alias("n")).first()["n"] or 0) // 8
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries * ENTRY.itemsize / bucket_bytes))

    def paired(packed: DataFrame, each) -> DataFrame:
        return packed.groupBy("bucket").applyInArrow(each, PAIR).groupBy("a", "b", "na", "nb").agg(F.sum("met").alias("met"))

    def met(rows: DataFrame, each, salt: int, ends: int | None = None) -> DataFrame:
        return paired(rows.mapInArrow(_entries(buckets, most, salt, ends), "bucket int, body binary"), each)

    def met_across(rows: DataFrame) -> DataFrame:
        """All that share a prefix shingle and are in different components; a shingle of many
        groups only where it has more than one component."""
        packed = rows.mapInArrow(_entries(buckets, most, None), "bucket int, body binary")
        hot = rows.mapInArrow(_hot_entries(most), HOT)
        mixed = hot.groupBy("h").agg(F.min("component").alias("least"), F.max("component").alias("greatest")).where("least <> greatest").select("h")
        split = hot.join(mixed, "h").select("h", "groups", "id", "n", "at", "component").mapInArrow(_in_pairs_of_groups(buckets), "bucket int, body binary")
        return paired(packed.unionByName(split), _across(percent))

    def placed(label: DataFrame) -> DataFrame:
        return ordered.join(label.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "prefix", "skip", "levels", F.coalesce("component", "id").alias("component"))

    def best(pairs: DataFrame) -> DataFrame:
        """Each set's ``hubs`` partners met most often; all others are left to later rounds."""
        pairs = scratch.stored(pairs, "met-pairs")
        sides = pairs.select(F.col("a").alias("x"), "*").unionByName(pairs.select(F.col("b").alias("x"), "*"))
        # a rank with a limit is cut in the tasks that send, so a hub's many partners do not meet
        rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("met"), "a", "b"))
        return sides.withColumn("rank", rank).where(F.col("rank") <= hubs).select("a", "b", "na", "nb").distinct()

    def joined_by(label: DataFrame | None, pairs: DataFrame) -> DataFrame:
        """Components after the links among ``pairs``; those so far are stars, so little has to settle."""
        found = links(pairs, ordered, percent, bounds).select("a", "b")
        return components(found if label is None else label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))

    single = ordered.select("id", "n", "prefix", "skip", "levels", F.col("id").alias("component"))
    label = joined_by(None, best(met(single, _hubs(percent), 0, hubs)))
    for salt in range(NEIGHBOUR_ROUNDS):
        label = joined_by(label, met(placed(label), _neighbours(percent, salt + 1), salt + 1))
    label = joined_by(label, met_across(placed(label)))
    named = classes.join(label.withColumnRenamed("node", "class"), "class", "left").select("sig", F.coalesce("component", "class").alias("component_id"))
    alone = sets.where("sig IS NULL").select("id", "n", F.col("id").alias("component_id"))
    joined = some.select("id", "n", "sig").join(named, "sig").select("id", "n", "component_id")
    return alone.unionByName(joined).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
