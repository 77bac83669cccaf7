"""Mixing sources to target weights by temperature.

A source with share ``p`` of all tokens gets a weight in proportion to ``p ** a``.  The
exponent ``a`` is bisected: with ``target_entropy`` to the exponent of which the weights
have that share of the greatest entropy, ``log(sources)``, above 1 where the natural
shares have more; otherwise to the least exponent up to 1 for which no source is
repeated more than ``most_repeats`` times in a budget.

The weights are realised as budgeted block permutations.  A source's documents are
dealt by a hash to blocks of about ``block_tokens`` tokens, in hash order within a block;
blocks are permuted by a seed.  A source is passed through in this order until its
quota is used: whole passes first, then whole blocks, then the first documents of one
block, up to the document that reaches the quota.  Cumulative sums run over blocks,
and over the documents of one block, never over all documents of a source.

Defined results: a null source is a source of its own; documents without tokens are
scheduled once with each whole pass and cost nothing; rows that repeat are documents
of their own and may share a place; only counts of tokens matter, however long a text
is; an empty table gives an empty schedule; other columns pass through, and where one
has a name of the new columns, the new one gets a trailing ``_``.  Where so many sources
share the greatest count that no exponent brings the entropy down to the target (as when
all are equal), the natural shares are kept, exponent 1, with a warning.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafline.llm import kernels, scratch

#: Source totals are read by the driver, which bisects over them; more are refused.
MOST_SOURCES = 1_000_000
#: The greatest exponent that is tried; it tells shares apart that differ by one token in 10^15.
MOST_EXPONENT = 2.0**60
#: Tables of at most so many sources or blocks are broadcast, about 50 bytes a row.
MOST_BROADCAST = 100_000


def weights(tokens: dict, exponent: float) -> dict:
    """Normalised ``share ** exponent`` of each source with tokens."""
    total = sum(tokens.values())
    logs = {s: exponent * math.log(n / total) for s, n in tokens.items() if n > 0}
    top = max(logs.values(), default=0.0)
    raw = {s: math.exp(x - top) for s, x in logs.items()}
    norm = sum(raw.values())
    return {s: x / norm for s, x in raw.items()}


def entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def bisect(good, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The least exponent that is good, where all greater ones are."""
    if good(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def exponent_for(tokens: dict, budget: float, target_entropy: float | None, most_repeats: float) -> float:
    """Entropy falls as the exponent rises, and up to 1 so do the repeats of small sources."""
    some = {s: n for s, n in tokens.items() if n > 0}
    if not some:
        return 1.0
    if target_entropy is not None:
        goal = target_entropy * math.log(len(some)) if len(some) > 1 else 0.0
        met = lambda a: entropy(weights(some, a)) <= goal + 1e-12
        if met(0.0):
            return 0.0
        high = 1.0
        while not met(high):
            high *= 2
            if high > MOST_EXPONENT:
                warnings.warn(f"no exponent has {target_entropy} of the greatest entropy; the natural shares are kept", stacklevel=2)
                return 1.0
        return bisect(met, high=high)
    return bisect(lambda a: all(w * budget <= most_repeats * some[s] * (1 + 1e-12) for s, w in weights(some, a).items()))


def count_words(df: DataFrame, text: str, name: str = "tokens") -> DataFrame:
    """``df`` with the number of its words, ``[^\\x20\\x09-\\x0D]+``; null counts 0."""

    @F.arrow_udf("long")
    def words(texts: pa.Array) -> pa.Array:
        data, off = kernels.column_bytes(texts)
        parts = [np.diff(kernels.word_bounds(block, block_off)[2]) for *_, block, block_off in kernels.blocks(data, off)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return df.withColumn(name, words(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))


@dataclass(frozen=True)
class Plan:
    """What each source and each block of it contributes."""

    quotas: DataFrame
    ends: DataFrame
    seed: int
    source: str
    keys: tuple[str, ...]


def _placed(df: DataFrame, quotas: DataFrame, source: str, keys: tuple[str, ...], seed: int) -> DataFrame:
    here = df.join(quotas, F.col(source).eqNullSafe(F.col("m_source"))).withColumn("place", F.xxhash64(F.lit(seed), *(F.col(k) for k in keys)))
    return here.withColumn("block", F.pmod(F.xxhash64("place"), F.col("m_blocks")).cast("int"))


def plan(df: DataFrame, tokens: str = "tokens", source: str = "source", keys: tuple[str, ...] = ("doc_id",), budget: int | None = None, target_entropy: float | None = 0.9, most_repeats: float = 4.0, block_tokens: int = 1_000_000, seed: int = 17) -> Plan:
    """Weights of the sources and the blocks that realise them, from ids, sources and tokens.

    ``keys``: columns that, with the seed, deal a document to its place."""
    sums = df.groupBy(source).agg(F.sum(tokens).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    total = {r[source]: int(r["n"] or 0) for r in sums}
    budget = sum(total.values()) if budget is None else budget
    w = weights(total, exponent_for(total, budget, target_entropy, most_repeats))
    rows = [(s, max(1, math.ceil(n / block_tokens)), int(w.get(s, 0.0) * budget) // n if n else 1, int(w.get(s, 0.0) * budget) % n if n else 0) for s, n in total.items()]
    kind = df.select(source).schema[0].dataType.simpleString()
    quotas = df.sparkSession.createDataFrame(rows, f"m_source {kind}, m_blocks int, m_passes long, m_rest long")
    # both sizes are known here: a row a source, and a row a block
    small = sum(r[1] for r in rows) <= MOST_BROADCAST
    quotas = F.broadcast(quotas) if len(rows) <= MOST_BROADCAST else quotas
    placed = _placed(df.select(source, tokens, *keys), quotas, source, keys, seed)
    totals = placed.groupBy("m_source", "block").agg(F.sum(tokens).alias("m_tokens"), F.first("m_rest").alias("m_rest"))
    order = Window.partitionBy("m_source").orderBy(F.xxhash64(F.lit(seed), "block"), "block")
    ranked = totals.select("m_source", "block", "m_rest", "m_tokens", F.row_number().over(order).alias("block_rank"), F.coalesce(F.sum("m_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("m_before"))
    ranked = ranked.withColumn("m_left", F.col("m_rest") - F.col("m_before"))
    # in the block where the quota ends: the last place that is still taken
    cut = ranked.where("m_left > 0 AND m_left < m_tokens").select(F.col("m_source").alias("c_source"), F.col("block").alias("c_block"), "m_left")
    ending = placed.select("m_source", "block", "place", F.col(tokens).alias("m_n")).join(F.broadcast(cut) if len(rows) <= MOST_BROADCAST else cut, F.col("m_source").eqNullSafe(F.col("c_source")) & (F.col("block") == F.col("c_block")))
    within = Window.partitionBy("m_source", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = ending.withColumn("m_sum", F.coalesce(F.sum("m_n").over(within), F.lit(0))).where("m_sum < m_left").groupBy("m_source", "block").agg(F.max("place").alias("m_last"))
    ends = ranked.join(last.select(F.col("m_source").alias("e_source"), F.col("block").alias("e_block"), "m_last"), F.col("m_source").eqNullSafe(F.col("e_source")) & (F.col("block") == F.col("e_block")), "left")
    ends = ends.select(F.col("m_source").alias("b_source"), F.col("block").alias("b_block"), "block_rank", F.when(F.col("m_left") >= F.col("m_tokens"), F.lit((1 << 63) - 1)).when(F.col("m_left") > 0, F.col("m_last")).alias("m_until"))
    ends = scratch.stored(ends, "mix-blocks")
    return Plan(quotas, F.broadcast(ends) if small else ends, seed, source, keys)


def realise(df: DataFrame, made: Plan) -> DataFrame:
    """One row for each time that a document is scheduled: the columns of ``df`` and
    ``epoch`` (from 0), ``block``, ``block_rank`` (the block's place in its source) and
    ``place`` (the order in the block).  Rows meet only the tables of sources and blocks."""
    given = F.struct(*(F.col(f"`{c}`").alias(c) for c in df.columns)).alias("m_row")
    own = list(dict.fromkeys((made.source, *made.keys)))
    placed = _placed(df.select(given, *(F.col(f"`{c}`").alias(f"m_key_{k}") for k, c in enumerate(own))), made.quotas, f"m_key_{own.index(made.source)}", tuple(f"m_key_{own.index(c)}" for c in made.keys), made.seed)
    chosen = placed.join(made.ends, F.col(f"m_key_{own.index(made.source)}").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    times = F.col("m_passes") + F.when(F.coalesce(F.col("place") <= F.col("m_until"), F.lit(False)), 1).otherwise(0)
    used = chosen.withColumn("m_times", times.cast("int")).where("m_times > 0").select("m_row", F.explode(F.sequence(F.lit(0), F.col("m_times") - 1)).alias("epoch"), "block", "block_rank", "place")
    names = list(df.columns)
    for c in ("epoch", "block", "block_rank", "place"):
        while c in names:
            c += "_"
        names.append(c)
    return used.select(*(F.col("m_row").getField(c).alias(c) for c in df.columns), *(F.col(c).alias(n) for c, n in zip(("epoch", "block", "block_rank", "place"), names[len(df.columns) :], strict=True)))


def schedule(df: DataFrame, **options) -> DataFrame:
    """``realise(df, plan(df, **options))``."""
    return realise(df, plan(df, **options))
