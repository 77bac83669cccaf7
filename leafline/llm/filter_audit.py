"""How five document filters interact: what each removes in every order of application.

The filters fail a document with

* ``A`` fewer than 200 words,
* ``B`` fewer than one distinct word in two,
* ``C`` more than three capitals A-Z in a hundred code points,
* ``D`` any of ``#$%&*|``,
* ``E`` a text that a smaller id has too, anywhere in the table.

A to D need the text alone.  The texts of an Arrow batch are one buffer of bytes:
byte classes (word, capital, symbol, first byte of a character) are tables of 256
flags, and prefix sums of a class, read at the document offsets, count it for every
document at once.  Distinct words come from the hashes of a document's words, sorted;
words with equal hashes are compared byte by byte, so a chance hit counts as two words.
The four answers are bits of one mask, and the mask, the part and a digest of the text
are all that leaves the pass.

E is decided by digest.  Rows are summed by digest, id, part and labels and then by
digest, part and labels, so a text that a third of all documents share is a few rows
before its smallest id is sought; no text is joined back.

The 120 orders meet only the summed masks, at most 32 a part.

Defined results: a null text reads as empty and is equal to an empty one; a null
language is the part of the empty text; a document without labels is neither good nor
toxic, and one with several label rows is what any of them says; a null id is smaller
than no id and fails E never; rows that share id and text do not fail E by each other;
a text of any length is read whole; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, StructType

from leafline.llm import kernels

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

CAPITAL = np.zeros(256, dtype=bool)
CAPITAL[65:91] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(SYMBOLS)] = True
#: The first bytes of UTF-8 characters.
FIRST = (np.arange(256) & 0xC0) != 0x80


def counted(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set in each document."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return np.diff(sums[off])


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at each of ``a`` equal those at the like place of ``b``."""
    out = np.ones(len(a), dtype=bool)
    if len(a) == 0:
        return out
    ends = np.cumsum(size)
    step = np.arange(int(ends[-1]), dtype=np.int64) - np.repeat(ends - size, size)
    differs = data[np.repeat(a, size) + step] != data[np.repeat(b, size) + step]
    if differs.any():
        out[np.repeat(np.arange(len(a)), size)[differs]] = False
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_off: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Distinct words of each document.  Words of one hash that differ are told apart."""
    n = len(word_off) - 1
    h = kernels.word_hashes(data, starts, ends) if hashes is None else hashes
    doc = np.repeat(np.arange(n), np.diff(word_off))
    order = np.lexsort((h, doc))
    d, k, size = doc[order], h[order], (ends - starts)[order]
    again = np.zeros(len(order), dtype=bool)  # equal to the word before it in this order
    at = np.flatnonzero((d[1:] == d[:-1]) & (k[1:] == k[:-1])) + 1
    alike = size[at] == size[at - 1]
    alike[alike] = same_bytes(data, starts[order[at[alike]]], starts[order[at[alike] - 1]], size[at[alike]])
    again[at[alike]] = True
    out = np.diff(word_off) - np.bincount(d[again], minlength=n)
    for x in np.unique(d[at[~alike]]).tolist():  # a chance hit of two hashes
        out[x] = len({data[a:b].tobytes() for a, b in zip(starts[word_off[x] : word_off[x + 1]].tolist(), ends[word_off[x] : word_off[x + 1]].tolist(), strict=True)})
    return out


def masks(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each document fails."""
    out = [np.zeros(0, np.int8)]
    for _, _, part, at in kernels.blocks(data, off):
        starts, ends, word_off = kernels.word_bounds(part, at)
        words = np.diff(word_off)
        fails = (
            words < LEAST_WORDS,
            100 * distinct_words(part, starts, ends, word_off) < LEAST_DISTINCT * words,
            100 * counted(CAPITAL[part], at) > MOST_CAPITALS * counted(FIRST[part], at),
            counted(SYMBOL[part], at) > 0,
        )
        out.append(sum(f.astype(np.int8) << i for i, f in enumerate(fails)))
    return np.concatenate(out)


def masked(df: DataFrame, text: str = "text", mask: str = "mask") -> DataFrame:
    """``df`` without ``text`` and with the ``mask`` of A to D.  One narrow pass."""
    rest = [c for c in df.columns if c != text]
    if mask in rest:
        raise ValueError(f"there is a column {mask} already")
    shown = df.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").cast("binary").alias(mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(masks(*kernels.column_bytes(batch.column(batch.num_columns - 1))), pa.int8())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=names)

    names = shown.columns
    return shown.mapInArrow(run, StructType(shown.schema.fields[:-1]).add(mask, ByteType()))


def failed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How many documents, good ones and toxic ones of each part fail just the filters of ``mask``."""
    # the digest stands for the text, so it is made before the text is left behind
    shown = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text")
    says = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = masked(shown).join(says, F.col("doc_id") == F.col("label_id"), "left")
    marked = marked.select("doc_id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = marked.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    named, unnamed = F.col("doc_id").isNotNull(), F.col("doc_id").isNull()
    lowest = by_id.groupBy(*kind).agg(F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum(F.when(named, F.col("n"))).alias("named"), F.sum(F.when(unnamed, F.col("n"))).alias("unnamed"))
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    passing = F.when(first, F.col("at_least")).otherwise(0)
    n = lowest.select("part", "mask", "good", "toxic", F.coalesce(passing, F.lit(0)).alias("first"), F.coalesce("named", F.lit(0)).alias("named"), F.coalesce("unnamed", F.lit(0)).alias("unnamed"))
    each = n.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").cast("int").alias("mask"), (F.col("first") + F.col("unnamed")).alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(16)).cast("int").alias("mask"), (F.col("named") - F.col("first")).alias("n")),
    )).alias("x"))
    return each.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    steps = [(order, k + 1, 1 << FILTERS.index(order[k]), sum(1 << FILTERS.index(c) for c in order[:k])) for order in ORDERS for k in range(len(FILTERS))]
    order, step, bit, before = (F.get(F.lit(list(column)), F.col("k")) for column in zip(*steps, strict=True))
    # only masks meet the steps: at most 32 rows a part
    each = failed(docs, labels).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("k"))
    own, gone = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(before) != 0
    each = each.select("part", "n", "good", "toxic", order.alias("filter_order"), step.alias("step"), own.alias("own"), gone.alias("gone"), F.bit_count("mask").alias("fails"))
    removed = F.col("own") & ~F.col("gone")
    sums = lambda when, what="n": F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    # of the filters that a document fails, each comes first in an equal share of the orders
    share = F.when(F.col("own"), F.col("n") * F.expr(f"{len(ORDERS)} div greatest(fails, 1)"))
    return each.groupBy("part", "filter_order", "step").agg(
        sums(~F.col("own") & ~F.col("gone")).alias("kept"),
        sums(removed).alias("removed"),
        sums(F.col("own") & F.col("gone")).alias("redundant"),
        sums(F.col("own") & (F.col("fails") == 1)).alias("unique_fails"),
        sums(removed, "good").alias("good_lost"),
        sums(removed, "toxic").alias("toxic_lost"),
        F.coalesce(F.sum(share), F.lit(0)).cast("long").alias("shapley"),
    )
