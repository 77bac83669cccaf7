"""Column edges of a page found among the starts or ends of its lines.

Every pair of lines that are far enough apart proposes a straight edge.  A proposal gains
a point for each line that hugs it and loses ``OUTSIDE_COST`` for each that lies clearly
outside of it, which text inside a column cannot do.  The best proposal's lines are fitted
by a polynomial, by least squares, three times over the lines that hug the last fit.

A page's lines come together once and its pairs are scored by arrays, so no pair is a row; the sums
of the fits come from windows in the JVM.  A group is one page's lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Fixed values, in pixels of the render that the measures are calibrated for: how far a flush line may
# lie inside and outside of its edge, from where it is clearly outside and what that costs, the
# steepest edge, the least height between two proposing lines, the lines that a fit needs and a curved
# one, the lines and the height that an edge needs, and the share of lines that may lie outside of it.
INSIDE, OUTSIDE, CLEARLY_OUTSIDE, OUTSIDE_COST = 6.0, 10.0, 14.0, 6
STEEPEST, LEAST_APART = 0.035, 300.0
LEAST_FIT, LEAST_CURVED, LEAST_LINES, LEAST_SPAN, MOST_OUTSIDE = 6, 15, 8, 500.0, 0.3
FITS = 3
#: Distances of lines from proposed edges that are held at a time.
BLOCK = 1 << 20


def _hugs(r: Column, start: bool) -> Column:
    return r.between(-OUTSIDE, INSIDE) if start else r.between(-INSIDE, OUTSIDE)


def _strays(r: Column, start: bool) -> Column:
    return r < -CLEARLY_OUTSIDE if start else r > CLEARLY_OUTSIDE


def proposals(lines: DataFrame, keys: Sequence[str], start: bool = True) -> DataFrame:
    """The best straight edge of each page: the two lines that propose it, ``points``, ``hugging`` and
    ``outside`` lines.  ``lines`` has ``line``, ``x`` (starts, or ends if not ``start``) and ``y``.

    More points win, then fewer lines outside, then more that hug, then the first pair.  Places are
    subtracted in the type they are given in, so decimals (of up to 18 digits) lose nothing before the slope."""
    kind = lines.schema["x"].dataType
    exact = isinstance(kind, T.DecimalType) and kind.precision <= 18
    x = (F.col("x") * 10**kind.scale).cast("long") if exact else F.col("x").cast("double")
    line = F.struct("line", x.alias("x"), F.col("y").cast("double").alias("y"))
    packed = lines.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("_l"))
    kinds = {"first": lines.schema["line"].dataType, "second": lines.schema["line"].dataType}
    fields = [T.StructField(n, kinds.get(n, T.DoubleType() if n in ("first_x", "first_y", "slope") else T.IntegerType())) for n in _BEST]
    scale = 10.0**kind.scale if exact else 1.0

    @F.arrow_udf(T.StructType(fields))
    def best(pages: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(pages), 0).to_numpy(zero_copy_only=False))])
        flat = pages.flatten()
        number, x, y = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        rows = [_best_pair(number[a:b], x[a:b], y[a:b], scale, start) for a, b in zip(ends, ends[1:], strict=False)]
        return pa.array([r and dict(zip(_BEST, r, strict=True)) for r in rows], pa.struct([(f.name, to_arrow_type(f.dataType)) for f in fields]))

    some = reduce(lambda p, q: p & q, (F.col(k).isNotNull() for k in keys))
    return packed.where(some).select(*keys, best("_l").alias("b")).where("b IS NOT NULL").select(*keys, "b.*")


_BEST = ("first", "second", "first_x", "first_y", "slope", "points", "hugging", "outside")


def _best_pair(number: np.ndarray, x: np.ndarray, y: np.ndarray, scale: float, start: bool) -> tuple | None:
    """The best proposal of one page; none if no pair proposes.  Pairs are scored in blocks, so a page with many
    lines takes time but no more memory."""
    at, best, rank, n = x / scale, None, None, len(x)
    step = max(1, BLOCK // max(1, n * n))
    for k in range(0, n, step):
        i, j = np.nonzero(number[k : k + step, None] < number)
        i += k
        apart = y[j] - y[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (x[j] - x[i]) / scale / apart
            good = (np.abs(apart) >= LEAST_APART) & (np.abs(slope) <= STEEPEST)
        i, j, slope = i[good], j[good], slope[good]
        if not len(i):
            continue
        off = at - (at[i, None] + slope[:, None] * (y - y[i, None]))
        hugging = np.count_nonzero((off >= (-OUTSIDE if start else -INSIDE)) & (off <= (INSIDE if start else OUTSIDE)), axis=1)
        outside = np.count_nonzero(off < -CLEARLY_OUTSIDE if start else off > CLEARLY_OUTSIDE, axis=1)
        points = hugging - OUTSIDE_COST * outside
        # more points, fewer lines outside (with both equal as many hug), the first pair
        top = np.flatnonzero(points == points.max())
        t = top[outside[top].argmin()]
        if rank is None or (-points[t], outside[t]) < rank:
            rank = (-points[t], outside[t])
            best = (number[i[t]].item(), number[j[t]].item(), at[i[t]].item(), y[i[t]].item(), slope[t].item(), int(points[t]), int(hugging[t]), int(outside[t]))
    return best


def _solved(s: Sequence[Column], m: Sequence[Column], curved: Column) -> list[Column]:
    """Coefficients of x over t by the normal equations, from the sums ``s`` of powers of t and ``m`` of
    x times those, solved by Cramer's rule; the third is 0 where the fit is straight."""

    def det(a, b, c):
        return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])

    rows = [[s[i + k] for k in range(3)] for i in range(3)]
    bent = [F.try_divide(det(*([*row[:k], m[i], *row[k + 1 :]] for i, row in enumerate(rows))), det(*rows)) for k in range(3)]
    flat = s[0] * s[2] - s[1] * s[1]
    straight = [F.try_divide(m[0] * s[2] - m[1] * s[1], flat), F.try_divide(s[0] * m[1] - s[1] * m[0], flat), F.lit(0.0)]
    return [F.when(curved, b).otherwise(f) for b, f in zip(bent, straight, strict=True)]


def edges(lines: DataFrame, keys: Sequence[str], start: bool = True, least_lines: int = LEAST_LINES) -> DataFrame:
    """The edge of each page that has one: ``c0 + c1 t + c2 t^2`` with t = (y - middle) / scale, the
    heights ``low`` to ``high`` and the number ``n`` of lines that it is fitted on.

    The sums of a fit are windows over a page's lines, so all fits share one exchange."""
    page = Window.partitionBy(*keys)
    kept = F.col("kept")
    over = lambda value: F.sum(F.when(kept, value)).over(page)
    df = lines.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(proposals(lines, keys, start), list(keys))
    df = df.select(*keys, "x", "y", _hugs(F.col("x") - (F.col("first_x") + F.col("slope") * (F.col("y") - F.col("first_y"))), start).alias("kept"))
    for _ in range(FITS):
        df = df.withColumn("n", F.count_if(kept).over(page)).withColumn("low", F.min(F.when(kept, F.col("y"))).over(page)).withColumn("high", F.max(F.when(kept, F.col("y"))).over(page))
        df = df.where(F.col("n") >= LEAST_FIT)
        middle, scale = (F.col("low") + F.col("high")) / 2, F.greatest((F.col("high") - F.col("low")) / 2, F.lit(1.0))
        df = df.select(*keys, "x", "y", "kept", "n", middle.alias("middle"), scale.alias("scale")).withColumn("t", (F.col("y") - F.col("middle")) / F.col("scale"))
        power = lambda k: F.lit(1.0) if k == 0 else F.pow("t", F.lit(float(k)))
        df = df.select("*", *(over(power(k)).alias(f"s{k}") for k in range(5)), *(over(F.col("x") * power(k)).alias(f"m{k}") for k in range(3)))
        c = _solved([F.col(f"s{k}") for k in range(5)], [F.col(f"m{k}") for k in range(3)], F.col("n") >= LEAST_CURVED)
        df = df.select(*keys, "x", "y", "middle", "scale", "t", *(v.alias(f"c{k}") for k, v in enumerate(c)))
        df = df.withColumn("off", F.col("x") - (F.col("c0") + F.col("c1") * F.col("t") + F.col("c2") * F.col("t") * F.col("t"))).withColumn("kept", _hugs(F.col("off"), start))
    done = df.groupBy(*keys, "c0", "c1", "c2", "middle", "scale").agg(F.min(F.when(kept, F.col("y"))).alias("low"), F.max(F.when(kept, F.col("y"))).alias("high"), F.count_if(kept).alias("n"), F.count_if(_strays(F.col("off"), start)).alias("outside"))
    good = (F.col("n") >= max(least_lines, LEAST_FIT)) & (F.col("high") - F.col("low") >= LEAST_SPAN) & (F.col("outside") <= MOST_OUTSIDE * F.col("n"))
    return done.where(good).select(*keys, "c0", "c1", "c2", "middle", "scale", "low", "high", "n")
