"""Cross-entropy difference: how much likelier a text is under a target model than under a background.

Both models are word bigram models with one vocabulary, one order and one smoothing:
``p(w | v) = a * c(v, w) / c(v) + (1 - a) * p(w)``, ``p(w) = (c(w) + b) / (n + b * v)``.
The target model counts the target documents, the background model counts all; the
vocabulary has the words that occur at least ``least`` times in all documents, and
one entry for the rest.  A document is scored by models from which its own counts
are taken out, so target documents gain nothing from having been counted.

Counts of all words and of all bigrams are summed over the corpus by packed key
ranges (see ``exchange``); no table of them is collected or broadcast.  A key is the
leading bits of a 64-bit hash, all of them from some 16 million words on: two of a
billion different keys are the same with a chance of about one in forty.

Words are runs of letters and digits in lower case.  Defined results: a null or empty
text, or one without words, has 0 tokens, losses 0 and a null score; without target
documents the target model is uniform; rows that repeat are documents of their own; a
very long text is read whole, in blocks; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm import exchange, kernels
from leafline.llm.decontaminate import hashed_words
from leafline.llm.exchange import U64, Layout

TARGET, WORD, PAIR, TOTAL = 0, 1, 2, 3
OTHER = 0x5851F42D4C957F2D


def pack_counts(*columns: np.ndarray) -> bytes:
    """Counts as one byte each; 255 stands for the next of the eight-byte counts that follow."""
    flat = np.concatenate(columns)
    return np.minimum(flat, 255).astype(np.uint8).tobytes() + flat[flat >= 255].astype("<u8").tobytes()


def unpack_counts(body: bytes, n: int, columns: int = 2) -> np.ndarray:
    """The counts that ``pack_counts`` wrote, as ``columns`` rows of ``n``."""
    flat = np.frombuffer(body, np.uint8, n * columns).astype(np.int64)
    flat[flat == 255] = np.frombuffer(body, "<u8", -1, n * columns)
    return flat.reshape(columns, n)


class _Counts:
    """Distinct keys of a chunk with their counts in target documents and in all."""

    def __init__(self, keys: np.ndarray, target: np.ndarray, layout: Layout):
        self.layout = layout
        self.keys, self.of = np.unique(keys >> U64(64 - layout.bits), return_inverse=True)
        self.every = np.bincount(self.of, minlength=len(self.keys))
        self.target = np.bincount(self.of[target], minlength=len(self.keys))

    def messages(self, chunk: int, tag: int) -> pa.Table:
        extra = lambda a, b: pack_counts(self.target[a:b], self.every[a:b])
        return exchange.messages(chunk, tag, self.keys, np.zeros(len(self.keys), bool), self.layout.bits, self.layout, extra)

    def sums(self, replies: pa.Table, tag: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the corpus for each distinct key."""
        at = {b: body for t, b, body in zip(replies["tag"].to_pylist(), replies["bucket"].to_pylist(), replies["body"].to_pylist(), strict=True) if t == tag}
        which, cuts = exchange.spans(exchange.coarse_range(self.keys, self.layout.bits, self.layout))
        got = [unpack_counts(at[b], n) for b, n in zip(which.tolist(), np.diff(cuts).tolist(), strict=True)]
        both = np.concatenate(got, axis=1) if got else np.zeros((2, 0), np.int64)
        return both[0].astype(np.float64), both[1].astype(np.float64)


def _summed(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of a bucket's messages, the place of each key among the distinct ones, and their sums."""
    rows = [exchange.unpack(b) for b in table["body"].to_pylist()]
    keys, of = np.unique(np.concatenate([k for k, _, _ in rows]), return_inverse=True)
    counts = np.concatenate([unpack_counts(x, len(k)) for k, _, x in rows], axis=1)
    target, every = (np.bincount(of, weights=counts[k], minlength=len(keys)).astype(np.int64) for k in (0, 1))
    return [len(k) for k, _, _ in rows], of, target, every


def _sum(table: pa.Table) -> pa.Table:
    """One bucket: sums of each key's counts for every message that has it."""
    sizes, of, target, every = _summed(table)
    cut = np.cumsum([0, *sizes])
    body = [pack_counts(target[of[a:b]], every[of[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table([table["chunk"], table["tag"], table["bucket"], pa.array(body, pa.binary())], schema=exchange.MESSAGE_ARROW)


def _totals(table: pa.Table) -> pa.Table:
    """One bucket's entries and words, in target documents and in all, by vocabulary bound from 1 to 8."""
    _, _, target, every = _summed(table)
    return pa.table({f"t{x}": [[int((every >= x).sum()), int(target[every >= x].sum()), int(every[every >= x].sum())]] for x in range(1, 9)})


class _Chunk:
    def __init__(self, table: pa.Table, replies: pa.Table, layout: Layout):
        self.layout = layout
        words, off = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
        for *_, data, block_off in kernels.blocks(*kernels.column_bytes(table["text"])):
            h, word_off = hashed_words(data, block_off)
            off.append(word_off[1:] + off[-1][-1])
            words.append(h)
        self.raw, self.off = np.concatenate(words), np.concatenate(off)
        self.doc = np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))
        wanted = [np.frombuffer(b, "<i8") for t, b in zip(replies["tag"].to_pylist(), replies["body"].to_pylist(), strict=True) if t == TARGET]
        ids = table["key"].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
        self.is_target = np.isin(ids, np.concatenate(wanted)) if wanted else np.zeros(len(ids), bool)
        self.words = _Counts(self.raw, self.is_target[self.doc], layout)

    def pairs(self, replies: pa.Table, least: int) -> None:
        """The bigrams, of vocabulary words and the entry for the rest."""
        self.sum_target, self.sum_every = self.words.sums(replies, WORD)
        self.known = (self.sum_every >= least)[self.words.of]
        word = np.where(self.known, self.raw, U64(OTHER))
        self.second = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        self.pair = _Counts(kernels.mix(word[self.second - 1] * U64(kernels.WORD_BASE) + word[self.second]), self.is_target[self.doc[self.second]], self.layout)
        self.word = word


def _own(of: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """For each item, how often its key occurs in its document."""
    _, back, n = np.unique(doc * size + of, return_inverse=True, return_counts=True)
    return n[back]


def score(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", least: int = 2, weight: float = 0.7, smooth: float = 0.1, layout: Layout | None = None) -> DataFrame:
    """``key``, ``n_tokens``, ``loss_target``, ``loss_background`` (nats, summed over the
    tokens) and ``score``, their difference a token: below 0 is closer to the target.

    ``targets``: a table whose column ``key`` holds the ids of the target documents."""
    if not 1 <= least <= 8:
        raise ValueError("least is from 1 to 8")
    layout = layout or Layout.of(df, text, more_bits=64)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(layout.chunks)).cast("long")
    docs = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    docs = docs.select(place(F.coalesce(F.col("key").cast("long"), F.xxhash64("text"))).alias("chunk"), "key", "text")
    wanted = targets.select(F.col(key).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    told = wanted.groupBy(place("id").alias("chunk")).agg(F.collect_list("id").alias("ids")).mapInArrow(_told, exchange.MESSAGE)

    def ask_words(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return exchange.MESSAGE_ARROW.empty_table()
        return _Chunk(table, replies, layout).words.messages(table["chunk"][0].as_py(), WORD)

    def ask_pairs(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return exchange.MESSAGE_ARROW.empty_table()
        chunk = _Chunk(table, replies, layout)
        chunk.pairs(replies, least)
        return chunk.pair.messages(table["chunk"][0].as_py(), PAIR)

    asked = exchange.with_answers(docs, told, ask_words, exchange.MESSAGE)
    kind = exchange.Counts(layout.bits, _sum, unpack_counts, lambda c: pack_counts(*c), unpack_counts, lambda c: pack_counts(*c))
    first = told.unionByName(exchange.round_trip(asked, kind, layout))
    pair_sums = exchange.round_trip(exchange.with_answers(docs, first, ask_pairs, exchange.MESSAGE), kind, layout)
    # the totals are 24 numbers, summed once; each chunk gets them as one short row
    merged = exchange.merged(asked, kind, layout)
    by_bound = merged.groupBy("bucket").applyInArrow(_totals, ", ".join(f"t{x} array<long>" for x in range(1, 9)))
    one = by_bound.agg(F.concat(*(F.array(*(F.coalesce(F.sum(F.col(f"t{x}")[k]), F.lit(0)).cast("double") for k in range(3))) for x in range(1, 9))).alias("totals"))
    totals = one.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(layout.chunks - 1).cast("long"))).alias("chunk"), "totals").mapInArrow(_total_rows, exchange.MESSAGE)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["key", "n_tokens", "loss_target", "loss_background"]
        if not len(table):
            return pa.table([table["key"], pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())], names=names)
        chunk = _Chunk(table, replies, layout)
        chunk.pairs(replies, least)
        pair_target, pair_every = chunk.pair.sums(replies, PAIR)
        totals = next(np.frombuffer(b, "<f8").reshape(8, 3) for t, b in zip(replies["tag"].to_pylist(), replies["body"].to_pylist(), strict=True) if t == TOTAL)
        (size, in_target, in_every), (_, all_target, all_every) = totals[least - 1], totals[0]
        entries = size + 1
        tokens = np.diff(chunk.off)
        # own counts, of the vocabulary entries and of the bigrams
        entry = np.where(chunk.known, chunk.words.of, len(chunk.words.keys))
        own_word = _own(entry, chunk.doc, len(chunk.words.keys) + 1)
        own_pair = _own(chunk.pair.of, chunk.doc[chunk.second], len(chunk.pair.keys) + 1)
        losses = []
        for sums, pair_sum, rest, total, mine in ((chunk.sum_target, pair_target, all_target - in_target, all_target, chunk.is_target), (chunk.sum_every, pair_every, all_every - in_every, all_every, np.ones(len(tokens), bool))):
            own = mine[chunk.doc]
            count = np.append(sums, rest)[entry] - own_word * own
            loss = (count + smooth) / ((total - tokens * mine)[chunk.doc] + smooth * entries)
            context = count[chunk.second - 1]
            seen = pair_sum[chunk.pair.of] - own_pair * own[chunk.second]
            after = np.divide(seen, context, out=np.zeros(len(seen)), where=context > 0)
            loss[chunk.second] = np.where(context > 0, weight * after + (1 - weight) * loss[chunk.second], loss[chunk.second])
            losses.append(np.bincount(chunk.doc, weights=-np.log(loss), minlength=len(tokens)))
        return pa.table([table["key"], pa.array(tokens, pa.int64()), *(pa.array(x, pa.float64()) for x in losses)], names=names)

    kind = docs.schema["key"].dataType.simpleString()
    out = exchange.with_answers(docs, first.unionByName(pair_sums).unionByName(totals), finish, f"key {kind}, n_tokens long, loss_target double, loss_background double")
    return out.withColumn("score", F.when(F.col("n_tokens") > 0, (F.col("loss_target") - F.col("loss_background")) / F.col("n_tokens"))).withColumnRenamed("key", key)


def _told(batches):
    """The target ids of each chunk as one packed row."""
    for batch in batches:
        bodies = [np.array(ids, dtype="<i8").tobytes() for ids in batch.column(1).to_pylist()]
        n = len(bodies)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([TARGET] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array(bodies, pa.binary())], names=["chunk", "tag", "bucket", "body"])


def _total_rows(batches):
    """The totals as a message to each chunk."""
    for batch in batches:
        bodies = [np.array(t, dtype="<f8").tobytes() for t in batch.column(1).to_pylist()]
        n = len(bodies)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([TOTAL] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array(bodies, pa.binary())], names=["chunk", "tag", "bucket", "body"])
