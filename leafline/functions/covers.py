"""What boxes cover together, as array expressions: seams closed, cut to a cell's core, exact union area."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafline.functions import boxes
from leafline.functions.boxes import SIDES

#: Fixed values, in points: the air along a cell's edges that is no text, and the widest gap between
#: two boxes in which no line of print can stand.
EDGE, SEAM = 3.0, 3.0


def struct_of(b: tuple[Column, ...]) -> Column:
    return F.struct(*(v.alias(s) for v, s in zip(b, SIDES, strict=True)))


def _of(r: Column) -> tuple[Column, ...]:
    return tuple(r[s] for s in SIDES)


def bridges(rects: Column, seam: float = SEAM) -> Column:
    """The strips between boxes that overlap along one axis and are at most ``seam`` apart along the other."""

    def strip(a: Column, b: Column) -> Column:
        low, high = [F.greatest(a[s], b[s]) for s in ("x0", "y0")], [F.least(a[s], b[s]) for s in ("x1", "y1")]
        beside = (high[1] > low[1]) & (high[0] <= low[0]) & (low[0] - high[0] <= seam)
        above = (high[0] > low[0]) & (high[1] <= low[1]) & (low[1] - high[1] <= seam)
        # where they overlap the strip spans the overlap, where they part it spans the gap
        return F.when(beside | above, F.struct(*(F.least(v, w).alias(s) for v, w, s in zip(low, high, SIDES[:2], strict=True)), *(F.greatest(v, w).alias(s) for v, w, s in zip(low, high, SIDES[2:], strict=True))))

    pairs = F.transform(rects, lambda a, i: F.transform(F.slice(rects, i + 2, F.size(rects)), lambda b: strip(a, b)))
    return F.filter(F.flatten(pairs), lambda s: s.isNotNull())


def union_area(rects: Column) -> Column:
    """The area that boxes cover together: between neighbouring x edges a sweep over y sums what no
    box before has reached."""
    edges = F.array_sort(F.array_distinct(F.concat(F.transform(rects, lambda r: r["x0"]), F.transform(rects, lambda r: r["x1"]))))
    by_y = F.array_sort(F.transform(rects, lambda r: F.struct(r["y0"].alias("y0"), r["y1"].alias("y1"), r["x0"].alias("x0"), r["x1"].alias("x1"))))

    def swept(state: Column, r: Column) -> Column:
        return F.struct(F.greatest(state["reach"], r["y1"]).alias("reach"), (state["sum"] + F.greatest(r["y1"] - F.greatest(r["y0"], state["reach"]), F.lit(0.0))).alias("sum"))

    def slab(x: Column, i: Column) -> Column:
        after = F.get(edges, i + 1)
        inside = F.filter(by_y, lambda r: (r["x0"] <= x) & (r["x1"] >= after))
        start = F.struct(F.lit(float("-inf")).alias("reach"), F.lit(0.0).alias("sum"))
        return F.coalesce((after - x) * F.aggregate(inside, start, swept, lambda s: s["sum"]), F.lit(0.0))

    return F.aggregate(F.transform(edges, slab), F.lit(0.0), lambda a, v: a + v)


def covered_share(b: tuple[Column, ...], rects: Column) -> Column:
    """The share of a cell's core that an array of boxes covers together, 0 without an area.

    Seams are bridged between whole boxes near the core and then cut to it: a box just past the core
    may reach into it by its bridge alone.  Without a box that meets the core the share is 0."""
    core = boxes.core(b, EDGE)
    area = boxes.area(core)
    near = F.filter(rects, lambda r: boxes.meet((core[0] - SEAM, core[1] - SEAM, core[2] + SEAM, core[3] + SEAM), _of(r)))
    cut = F.filter(F.transform(F.concat(near, bridges(near)), lambda r: boxes.clip(_of(r), core)), lambda p: p.isNotNull())
    met = F.exists(rects, lambda r: boxes.meet(core, _of(r)))
    return F.when(F.coalesce((area > 0) & met, F.lit(False)), F.least(F.lit(1.0), union_area(cut) / area)).otherwise(0.0)


def most_covering(b: tuple[Column, ...], rects: Column) -> Column:
    """The place in ``rects`` of the box that alone covers most of the core, the first of equal ones; null without one."""
    core = boxes.core(b, EDGE)
    shares = F.transform(rects, lambda r: boxes.shared_area(core, _of(r)))
    most = F.array_max(shares)
    return F.when(most > 0, F.array_position(shares, most).cast("int") - 1)
