"""Substring dedup: remove words that lie in a window which occurs more than once.

Every window of ``window`` consecutive words gets a Rabin-Karp hash.  Two counts
decide whether it is repeated.  The first counts the leading bits of every window's
hash, as many as leave about one chance hit in ten thousand; the second counts 96
bits of the windows that the first one found twice.  Windows that are repeated are
merged into maximal intervals, whose words go.

Defined results: a null text has no words and reads as empty; a text with fewer
words than the window keeps all; rows that are equal in id and text are two
documents, so each is a copy of the other; a very long text is read whole, in blocks
of whole documents; an empty table gives an empty result; other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm import exchange, kernels
from leafline.llm.exchange import U64, Layout

FILTER, EXACT = 0, 1
BLANK = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")


class _Chunk:
    """The windows of one chunk's documents, and the keys that it sends for them."""

    def __init__(self, table: pa.Table, window: int, layout: Layout):
        self.window, self.layout, self.table = window, layout, table
        self.data, self.off = kernels.column_bytes(table["text"])
        hashes = [np.zeros(0, U64)]
        for *_, h in self._blocks(kernels.WORD_BASE):
            hashes.append(h)
        self.h = np.concatenate(hashes)
        self.short = self.h >> U64(64 - layout.bits)

    def _blocks(self, base: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for first, _, data, off in kernels.blocks(self.data, self.off):
            starts, ends, word_off = kernels.word_bounds(data, off)
            x = kernels.word_hashes(data, starts, ends)
            at = np.flatnonzero(kernels.within(word_off, len(x), self.window))
            yield first, starts, ends, word_off, at, kernels.mix(kernels.windows(x, self.window, base)[at])

    def filter_keys(self) -> tuple[np.ndarray, np.ndarray]:
        return exchange.distinct(self.short)

    def candidates(self, replies: pa.Table) -> np.ndarray:
        """Whether each window's filter key occurs elsewhere."""
        keys, _ = self.filter_keys()
        found = exchange.answer_bits(replies, FILTER, exchange.coarse_range(keys, self.layout.bits, self.layout))
        return found[np.searchsorted(keys, self.short)] if len(keys) else np.zeros(0, bool)

    def exact(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct 96-bit keys of the windows ``some``, whether repeated here, and each window's key."""
        second = np.concatenate([np.zeros(0, U64), *(h for *_, h in self._blocks(kernels.WORD_BASE_2))])[some]
        low, high = (second >> U64(32)).astype(np.uint32), self.h[some]
        order = np.lexsort((low, high))
        h, lo = high[order], low[order]
        start = np.ones(len(h), dtype=bool)
        start[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
        at = np.flatnonzero(start)
        where = np.empty(len(h), dtype=np.int64)
        where[order] = np.cumsum(start) - 1
        return h[at], lo[at], np.diff(at, append=len(h)) > 1, where


def _chunk_id(table: pa.Table) -> int:
    return table["chunk"][0].as_py()


def repeated_windows(df: DataFrame, key: str, text: str, window: int, layout: Layout | None = None) -> tuple[DataFrame, DataFrame, Layout]:
    """The chunked documents and the answers to both counts."""
    layout = layout or Layout.of(df, text)
    docs = exchange.chunked(df.select(F.col(key).alias("key"), F.col(text).alias("text")), ["key"], "text", layout.chunks)

    def ask(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, layout)
        return exchange.messages(_chunk_id(table), FILTER, *chunk.filter_keys(), layout.bits, layout)

    def ask_exactly(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return exchange.MESSAGE_ARROW.empty_table()
        chunk = _Chunk(table, window, layout)
        high, low, many, _ = chunk.exact(chunk.candidates(replies))
        return exchange.messages(_chunk_id(table), EXACT, high, many, 64, layout, low)

    found = exchange.round_trip(docs.groupBy("chunk").applyInArrow(ask, exchange.MESSAGE), exchange.Bits(layout.bits), layout)
    sure = exchange.round_trip(exchange.with_answers(docs, found, ask_exactly, exchange.MESSAGE), exchange.Bits(64), layout)
    return docs, found.unionByName(sure), layout


def remove_repeated(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, layout: Layout | None = None) -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``n_removed``, ``removed`` (word intervals,
    end exclusive) and ``kept`` (UTF-8 of the kept words, joined by one space)."""
    docs, replies, layout = repeated_windows(df, key, text, window, layout)
    kind = df.select(key).schema[0].dataType.simpleString()

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, layout)
        rep = chunk.candidates(replies)
        high, _, _, where = chunk.exact(rep)
        sure = exchange.answer_bits(replies, EXACT, exchange.coarse_range(high, 64, layout))
        rep[rep] = sure[where] if len(sure) else False
        words, gone, spans, kept, seen = [], [], [], [], 0
        for _, starts, ends, word_off, at, _ in chunk._blocks(kernels.WORD_BASE):
            cut = kernels.covered(at[rep[seen : seen + len(at)]], window, len(starts))
            base = int(chunk.off[len(words)])
            seen += len(at)
            for a, b in zip(word_off[:-1].tolist(), word_off[1:].tolist(), strict=True):
                mask = cut[a:b]
                lo, hi = kernels.runs(mask)
                words.append(b - a)
                gone.append(int((hi - lo).sum()))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi, strict=True)])
                keep = zip([0, *hi.tolist()], [*lo.tolist(), b - a], strict=True)
                kept.append(b" ".join(_joined(chunk.data[base + starts[a + x] : base + ends[a + y - 1]]) for x, y in keep if x < y))
        return pa.table({"key": table["key"], "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "kept": pa.array(kept, pa.binary())})

    out = exchange.with_answers(docs, replies, finish, f"key {kind}, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept binary")
    return out.withColumnRenamed("key", key)


def _joined(piece: np.ndarray) -> bytes:
    """The words of a run, each separator as one space."""
    flat = piece.tobytes().translate(BLANK)
    return b" ".join(flat.split()) if b"  " in flat else flat
