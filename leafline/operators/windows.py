"""Long sequences scored in overlapping windows, and put together again.

A model reads at most ``size`` words at once.  Windows are planned from the lengths alone,
exploded, scored apart on any executor, and each word's answer is taken from the window
in which it is farther from an edge.  What a window answers for is known from its own
bounds and its neighbours', so putting together is a filter: no row moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan(sequences: DataFrame, keys: Sequence[str], n: Column, size: int, overlap: int) -> DataFrame:
    """A row a window: ``window``, ``start``, ``end`` and the words ``own_start`` to ``own_end`` that it
    answers for (ends exclusive).  No words, no window; words of two windows go to the one with
    the greater distance to its nearer edge, of equal ones to the first."""
    if not 0 <= overlap < size:
        raise ValueError("overlap is from 0 to size - 1")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    spread = sequences.where(n > 0).select(*keys, n.cast("int").alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("window"))
    start = F.col("window") * step
    rows = spread.select(*keys, "_n", "window", start.alias("start"), F.least(start + size, F.col("_n")).alias("end"))

    def kept(first: Column, end: Column, after_end: Column) -> Column:
        """Of the words that a window shares with the next, how many stay: a leading part of them."""
        shared = F.sequence(F.lit(0), end - first - 1)
        mine = lambda k: F.least(first + k - (first - step), end - first - k - 1)
        theirs = lambda k: F.least(k, after_end - first - k - 1)
        return F.when(end > first, F.size(F.filter(shared, lambda k: mine(k) >= theirs(k)))).otherwise(0)

    before = F.when(F.col("window") > 0, F.col("start") + kept(F.col("start"), F.least(F.col("start") - step + size, F.col("_n")), F.col("end"))).otherwise(0)
    after = F.when(F.col("end") < F.col("_n"), F.col("start") + step + kept(F.col("start") + step, F.col("end"), F.least(F.col("start") + step + size, F.col("_n")))).otherwise(F.col("end"))
    return rows.select(*keys, "window", "start", "end", before.alias("own_start"), after.alias("own_end"))


def stitched(scored: DataFrame, place: str) -> DataFrame:
    """The answers that count, of rows that have a window's ``own_start`` and ``own_end`` and a word's ``place``."""
    return scored.where((F.col(place) >= F.col("own_start")) & (F.col(place) < F.col("own_end"))).drop("own_start", "own_end")
