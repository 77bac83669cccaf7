"""Benchmark decontamination: n-gram seeds, then local alignment.

All of each test item's ``n``-grams are its seeds: which of them edits left over
cannot be told from how rare they are.  Rarity counts through the words: an alignment
of the least score shares so many words with its item that the common ones are not
enough, so a document, and then the stretch of it around the hits, needs rare words of
the item as well before anything is aligned (``Passages``).  These bounds lose nothing.

Around the hits of an item in a document, Smith-Waterman aligns the item's words with the document's words, so edited copies
score too.  The score is the alignment's share of what an exact copy gives.  The words
around a hit reach as far as an alignment with that hit and the least score can, so
every alignment in which ``n`` words in a row are equal is found; one without such a
run (of three words: edits of every third word, score 0.52 at 30 words) is not.

The test items are a stated query set that is held against all documents in blocks
of about ``block_items`` items and ``block_bytes`` bytes, which bounds what is broadcast
to the workers; a block is one narrow pass over the documents, which do not move.

Words are lower-cased runs of letters and digits (all bytes above 127 are letters).
Defined results: null or empty documents and items match nothing; an item shorter
than ``n`` words has itself as its only seed; rows that repeat, on either side, each
give their rows; of equally good stretches of a text the first counts; very long texts
and items are aligned whole; an empty table on either side gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm import exchange, kernels
from leafline.llm.kernels import U64

MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits below the score in an alignment cell; they hold where the alignment started.
START_BITS = 32
#: Slots of the table that tells most n-grams from seeds before they are searched.
SLOTS = 1 << 20


class Items:
    """Test items of one block: their words' hashes, their vocabulary and their seeds.

    Built from arrays alone: a seed is 20 bytes, a word 12."""

    def __init__(self, ids: list, texts: pa.Array, n: int, least: float):
        self.ids, self.n = ids, n
        self.flat, self.off = hashed_words(*kernels.column_bytes(texts))
        size = np.diff(self.off)
        self.need = np.ceil(least * size - 1e-9).astype(np.int64)  # words that an alignment of the least score has in common
        seed, item, at = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length in np.unique(np.minimum(size, n)).tolist():
            if length:
                here = np.flatnonzero(kernels.within(self.off, len(self.flat), length))
                of = np.searchsorted(self.off, here, side="right") - 1
                fits = np.minimum(size[of], n) == length
                seed.append(ngrams(self.flat, length)[here[fits]])
                item.append(of[fits])
                at.append((here - self.off[of])[fits])
        self.seed, self.item, self.at = np.concatenate(seed), np.concatenate(item).astype(np.int32), np.concatenate(at).astype(np.int32)
        order = np.lexsort((self.at, self.item, self.seed))
        self.seed, self.item, self.at = self.seed[order], self.item[order], self.at[order]
        self.lengths = np.unique(np.minimum(size[size > 0], n)).tolist()
        self.keys = np.unique(self.seed)
        self.vocabulary, number = np.unique(self.flat, return_inverse=True)
        # the distinct words of each item with their counts, the rarest among the items first
        of = np.repeat(np.arange(len(size)), size)
        pair, times = np.unique(of * (len(self.vocabulary) + 1) + number, return_counts=True)
        word = pair % (len(self.vocabulary) + 1)
        owner = pair // (len(self.vocabulary) + 1)
        rarity = np.bincount(word, minlength=len(self.vocabulary))
        order = np.lexsort((word, rarity[word], owner))
        self.word, self.times = word[order].astype(np.int32), times[order].astype(np.int32)
        self.word_off = np.searchsorted(owner[order], np.arange(len(size) + 1))

    def words(self, item: int) -> np.ndarray:
        return self.flat[self.off[item] : self.off[item + 1]]

    def hits(self, words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words at which some seed starts, and that seed."""
        table = np.zeros(SLOTS, dtype=bool)
        table[(self.keys >> U64(44)).astype(np.int64)] = True
        where, which = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        for length in self.lengths:
            h = ngrams(words, length)
            at = np.flatnonzero(table[(h >> U64(44)).astype(np.int64)] & kernels.within(off, len(words), length))
            i = np.searchsorted(self.keys, h[at])
            at = at[self.keys[np.minimum(i, len(self.keys) - 1)] == h[at]]
            where.append(at)
            which.append(h[at])
        return np.concatenate(where), np.concatenate(which)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def lists(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of each item's list, and which of ``items`` each is of."""
        size = self.word_off[items + 1] - self.word_off[items]
        of = np.repeat(np.arange(len(items)), size)
        return np.arange(int(size.sum())) + np.repeat(self.word_off[items] - (np.cumsum(size) - size), size), of


def hashed_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = kernels.BARE[data]
    starts, ends, word_off = kernels.word_bounds(data, off)
    return kernels.word_hashes(data, starts, ends), word_off


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    return kernels.mix(kernels.windows(words, n, kernels.WORD_BASE) + U64(n))


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """Smith-Waterman of (item, passage) pairs of like sizes at once: score, start, end in the passage.

    A cell is the score above ``START_BITS`` bits for the start, so the best cell also
    says where its alignment began; a running maximum resolves the gaps along a row."""
    m, wide = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    item, passage = np.zeros((len(pairs), m), U64), np.zeros((len(pairs), wide), U64)
    real_item, real = np.zeros((len(pairs), m), bool), np.zeros((len(pairs), wide), bool)
    for k, (a, b) in enumerate(pairs):
        item[k, : len(a)], real_item[k, : len(a)] = a, True
        passage[k, : len(b)], real[k, : len(b)] = b, True
    unit = 1 << START_BITS
    fresh = (unit - 1 - np.arange(wide + 1, dtype=np.int64))[None, :]
    slope = np.arange(wide + 1, dtype=np.int64)[None, :] * (-GAP * unit)
    row = np.repeat(fresh, len(pairs), axis=0)
    best, end = row[:, 0].copy(), np.zeros(len(pairs), np.int64)
    for i in range(m):
        step = np.where((item[:, i : i + 1] == passage) & real & real_item[:, i : i + 1], MATCH, MISMATCH) * unit
        new = np.maximum(row + GAP * unit, fresh)
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + step)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        row = np.maximum(new, fresh)
        j = row.argmax(axis=1)
        top = row[np.arange(len(pairs)), j]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, j, end)
    return [(int(v) >> START_BITS, unit - 1 - (int(v) & (unit - 1)), int(e)) for v, e in zip(best, end, strict=True)]


def _slices(times: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of hits with about ``most`` items together."""
    ends, at = np.cumsum(times), 0
    while at < len(times):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


class Passages:
    """The stretches of a block of documents that are worth an alignment.

    Whatever the seeds, an alignment of the least score has so many words in common with
    its item, counted with repeats.  So a pair of document and item goes if the document
    has fewer of the item's words, then a stretch if it has.  Both bounds lose nothing, and
    they are what keeps seeds cheap that many items share."""

    def __init__(self, words: np.ndarray, off: np.ndarray, items: Items, least: float):
        self.words, self.off, self.items, self.least = words, off, items, least
        self.number = items.numbers(words)

    def found(self) -> list[tuple[int, int, int, int]]:
        """Document, item, first and last word of each stretch."""
        where, which = self.items.hits(self.words, self.off)
        if not len(where):
            return []
        order = np.argsort(where, kind="stable")
        where, which = where[order], which[order]
        lo = np.searchsorted(self.items.seed, which, "left")
        times = np.searchsorted(self.items.seed, which, "right") - lo
        doc = np.searchsorted(self.off, where, side="right") - 1
        many = len(self.items.ids)
        pairs = np.unique(np.concatenate([np.unique(np.repeat(doc[a:b], times[a:b]) * many + self.items.item[self._seeds(lo[a:b], times[a:b])]) for a, b in _slices(times)]))
        pairs = pairs[self._in_documents(pairs // many, pairs % many)]
        out: list[list[int]] = []
        for a, b in _slices(times):
            seed, at = self._seeds(lo[a:b], times[a:b]), np.repeat(np.arange(a, b), times[a:b])
            key = doc[at] * many + self.items.item[seed]
            kept = np.isin(key, pairs)
            out += self._stretches(doc[at[kept]], self.items.item[seed[kept]].astype(np.int64), where[at[kept]] - self.items.at[seed[kept]])
        return self._joined(out)

    @staticmethod
    def _seeds(lo: np.ndarray, times: np.ndarray) -> np.ndarray:
        return np.repeat(lo, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)

    def _in_documents(self, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether each document has as many of the item's words as an alignment needs."""
        ok = np.zeros(len(doc), dtype=bool)
        here = np.zeros(len(self.items.vocabulary), dtype=bool)
        at, cuts = exchange.spans(doc)
        for d, a, b in zip(at.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = self.number[self.off[d] : self.off[d + 1]]
            own = own[own >= 0]
            here[own] = True
            place, of = self.items.lists(item[a:b])
            have = np.bincount(of, weights=self.items.times[place] * here[self.items.word[place]], minlength=b - a)
            ok[a:b] = have >= self.items.need[item[a:b]]
            here[own] = False
        return ok

    def _stretches(self, doc: np.ndarray, item: np.ndarray, begin: np.ndarray) -> list[list[int]]:
        """The words around each hit as far as an alignment with it can reach, joined where they meet."""
        size = np.diff(self.items.off)[item]
        most = np.ceil(MATCH * size * (1 - self.least) / -GAP).astype(np.int64)  # words that such an alignment can insert
        first, end = np.maximum(self.off[doc], begin - most), np.minimum(self.off[doc + 1], begin + size + most)
        order = np.lexsort((first, item, doc))
        return np.column_stack((doc, item, first, end))[order].tolist()

    def _joined(self, some: list[list[int]]) -> list[tuple[int, int, int, int]]:
        some.sort()
        out: list[list[int]] = []
        for d, k, a, b in some:
            if out and out[-1][0] == d and out[-1][1] == k and a <= out[-1][3]:
                out[-1][3] = max(out[-1][3], b)
            else:
                out.append([d, k, a, b])
        if not out:
            return []
        kept = self._in_stretches(np.array(out, dtype=np.int64))
        return [tuple(x) for x, k in zip(out, kept.tolist(), strict=True) if k]

    def _in_stretches(self, some: np.ndarray) -> np.ndarray:
        """Whether each stretch has as many of the item's words, with repeats, as an alignment needs."""
        n = len(self.number) + 1
        at = np.flatnonzero(self.number >= 0)
        keys = np.sort(self.number[at] * n + at)
        ok = np.zeros(len(some), dtype=bool)
        for a in range(0, len(some), 4096):
            part = some[a : a + 4096]
            place, of = self.items.lists(part[:, 1])
            word = self.items.word[place].astype(np.int64) * n
            times = np.searchsorted(keys, word + part[of, 3]) - np.searchsorted(keys, word + part[of, 2])
            have = np.bincount(of, weights=np.minimum(times, self.items.times[place]), minlength=len(part))
            ok[a : a + 4096] = have >= self.items.need[part[:, 1]]
        return ok


def _aligned(sent, least: float, names: list[str], batch_pairs: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        for batch in batches:
            keys = batch.column(0)
            row, item, score, start, end = [], [], [], [], []
            for first, _, data, off in kernels.blocks(*kernels.column_bytes(batch.column(1))):
                words, word_off = hashed_words(data, off)
                sizes = np.diff(items.off)
                todo = sorted(Passages(words, word_off, items, least).found(), key=lambda x: (sizes[x[1]], x[3] - x[2]))
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                k = 0
                while k < len(todo):
                    size = max(1, min(batch_pairs, (1 << 21) // (todo[k][3] - todo[k][2] + 64)))
                    part = todo[k : k + size]
                    k += size
                    for (d, i, a, _), (points, s, e) in zip(part, align([(items.words(x[1]), words[x[2] : x[3]]) for x in part]), strict=True):
                        got = (points / (MATCH * int(sizes[i])), a + s - int(word_off[d]), a + e - int(word_off[d]))
                        if got[0] >= least and ((d, i) not in best or (got[0], -got[1]) > (best[d, i][0], -best[d, i][1])):
                            best[d, i] = got
                for (d, i), (x, a, b) in sorted(best.items()):
                    row.append(first + d)
                    item.append(items.ids[i])
                    score.append(x)
                    start.append(a)
                    end.append(b)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=names)

    return run


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 3, least: float = 0.5, block_items: int = 20_000, block_bytes: int = 32 << 20) -> DataFrame:
    """One row per document and item whose alignment scores at least ``least``:
    ``key``, ``item``, ``score``, ``start_word``, ``end_word`` (end exclusive)."""
    bench = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    size = bench.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, math.ceil(size["n"] / block_items), math.ceil((size["bytes"] or 0) / block_bytes))
    kind = df.select(F.col(key).alias(key)).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item}` long, score double, start_word int, end_word int"
    names = [key, item, "score", "start_word", "end_word"]
    out = None
    for part in range(parts):
        block = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).toArrow()
        items = Items(block.column(0).to_pylist(), block.column(1), n, least)
        if not len(items.keys):
            continue
        found = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(_aligned(df.sparkSession.sparkContext.broadcast(items), least, names), schema)
        out = found if out is None else out.unionByName(found)
    return df.sparkSession.createDataFrame([], schema) if out is None else out
