"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors are scaled to length one, where cosine ``c`` is the distance ``sqrt(2 - 2c)``.
Equal vectors of a label are one point with a multiplicity.  The top level of the tree is
global: of each label some points, chosen by a hash and about one for ``block`` points,
are centres, and every point belongs to the cell of its nearest one.  A pair of cells
whose centres are farther apart than both covering radii and the threshold goes before
any point is copied.  Cells are cut to blocks of about ``block`` points, so a label that
holds a third of all rows is many blocks, and each pair of blocks that is left is one
group.  A group builds the lower levels of each block: nested levels whose radii halve, every node with the true distance to its
farthest descendant.  Both trees are walked down together, a level at a time; a pair of
nodes whose centres are farther apart than both covering radii and the threshold goes,
with all pairs below.  What is left at the points is compared by cosine in double
precision.  A group returns a count and one edge a point, not its pairs.

Defined results: a null label, and a vector that is null, empty, zero, or has null or
non-finite components, links with nothing; vectors of different lengths do not link;
rows that repeat are vectors of their own with equal ids; a null id gets a null
component; a cosine of exactly the threshold links; vectors may be of any length; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from leafline.llm import scratch
from leafline.llm.components import components

#: Radii of the levels above the points; each is half the one before.
RADII = (1.0, 0.5, 0.25)
#: Allowance for rounding in the bounds; it only lets more pairs through to the last test.
SLACK = 1e-9
#: Centres of all labels together, and their numbers; both are sent to every worker.
MOST_CENTRES, MOST_CENTRE_NUMBERS = 20_000, 4_000_000
#: Allowance for rounding in the distances between cells.
CELL_SLACK = 1e-6


class CoverTree:
    """Levels of nodes over unit vectors; the last level has the points themselves."""

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        distance = lambda i, others: np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (points[others] @ points[i])))
        members = [np.arange(n)]
        #: per level: centres, covering radii, parents in the level above
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for radius in RADII:
            centres, reach, parents, new = [], [], [], []
            for parent, own in enumerate(members):
                while len(own):
                    d = distance(own[0], own)
                    inside = d <= radius
                    inside[0] = True
                    centres.append(own[0])
                    reach.append(float(d[inside].max()))
                    parents.append(parent)
                    new.append(own[inside])
                    own = own[~inside]
            members = new
            self.levels.append((np.array(centres), np.array(reach), np.array(parents)))
        order = np.concatenate(members) if members else np.zeros(0, np.int64)
        self.levels.append((order, np.zeros(len(order)), np.repeat(np.arange(len(members)), [len(m) for m in members])))


def dual_pairs(one: CoverTree, two: CoverTree, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of points whose cosine is at least ``least``."""
    near = math.sqrt(2.0 - 2.0 * least) + SLACK
    active = None
    for (ca, ra, pa_), (cb, rb, pb) in zip(one.levels, two.levels, strict=True):
        if active is None:
            rows, cols = np.arange(len(ca)), np.arange(len(cb))
            mask = np.ones((len(ca), len(cb)), dtype=bool)
        else:
            rows, cols = np.flatnonzero(active.any(axis=1)[pa_]), np.flatnonzero(active.any(axis=0)[pb])
            mask = active[np.ix_(pa_[rows], pb[cols])]
        d2 = 2.0 - 2.0 * (one.points[ca[rows]] @ two.points[cb[cols]].T)
        bound = ra[rows][:, None] + rb[cols][None, :] + near
        mask &= d2 <= bound * bound + SLACK
        active = np.zeros((len(ca), len(cb)), dtype=bool)
        active[np.ix_(rows, cols)] = mask
    i, j = np.nonzero(active)
    return one.levels[-1][0][i], two.levels[-1][0][j]


def _roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each of ``n`` points reaches inside the group."""
    best = ids.copy()
    while True:
        was = best.copy()
        np.minimum.at(best, a, was[b])
        np.minimum.at(best, b, was[a])
        if (best == was).all():
            return best


def _group(least: float):
    def run(table: pa.Table) -> pa.Table:
        names = ["id", "links", "root"]
        side = table["block"].to_numpy()
        ids, times = table["id"].to_numpy(), table["times"].to_numpy()
        x = np.stack([np.asarray(v, dtype=np.float64) for v in table["vector"].to_numpy()])
        size = np.sqrt((x * x).sum(axis=1))
        unit = x / size[:, None]
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        ia, ib = np.flatnonzero(side == p), np.flatnonzero(side == q)
        if not len(ia) or not len(ib):
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        one = CoverTree(unit[ia])
        two = one if p == q else CoverTree(unit[ib])
        a, b = dual_pairs(one, two, least)
        a, b = ia[a], ib[b]
        if p == q:
            a, b = a[a < b], b[a < b]
        cosine = np.einsum("ij,ij->i", x[a], x[b]) / (size[a] * size[b])
        a, b = a[cosine >= least], b[cosine >= least]
        links = np.bincount(a, weights=times[b], minlength=len(ids)) + np.bincount(b, weights=times[a], minlength=len(ids))
        root = _roots(len(ids), a, b, ids)
        some = np.flatnonzero(links)
        return pa.table([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=names)

    return run


def _cells(points: DataFrame, block: int) -> tuple[DataFrame, DataFrame, Broadcast]:
    """The points with the cell of their nearest centre, the cells with the first and number
    of their blocks and covering radius, and the centres.  A label without is one cell, -1."""
    sizes = points.groupBy("label", "dims").agg(F.count("*").alias("n")).withColumn("wanted", F.greatest(F.lit(1.0), F.col("n") / block))
    most = sizes.agg(F.sum("wanted").alias("centres"), F.sum(F.col("wanted") * F.col("dims")).alias("numbers"), F.count("*").alias("labels")).first()
    share = min(1.0, MOST_CENTRES / (most["centres"] or 1), MOST_CENTRE_NUMBERS / (most["numbers"] or 1))
    chance = F.least(F.lit(1.0), F.col("wanted") * share / F.col("n"))
    chosen = points.join(sizes, ["label", "dims"]).where((F.col("wanted") > 1) & (F.pmod(F.xxhash64("vector", F.lit(1)), F.lit(1 << 30)) < chance * (1 << 30)))
    centres: dict[tuple, np.ndarray] = {}
    for r in chosen.select("label", "dims", "vector").sort("label", "dims", "vector").toLocalIterator():
        centres.setdefault((r["label"], r["dims"]), []).append(np.asarray(r["vector"]))
    centres = {k: np.stack([v / np.sqrt((v * v).sum()) for v in vs]) for k, vs in centres.items()}
    sent = points.sparkSession.sparkContext.broadcast(centres)

    def place(batches):
        for batch in batches:
            label, dims, vector = (batch.column(batch.schema.get_field_index(c)) for c in ("label", "dims", "vector"))
            keys = list(zip(label.to_pylist(), dims.to_pylist(), strict=True))
            flat, begin = vector.flatten().to_numpy(), np.cumsum([0, *(d for _, d in keys)])
            cell, far = np.full(len(keys), -1, np.int32), np.full(len(keys), 2.0)
            by: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                by.setdefault(k, []).append(i)
            for k, mine in by.items():
                if k in sent.value:
                    x = np.stack([flat[begin[i] : begin[i + 1]] for i in mine])
                    d2 = 2.0 - 2.0 * (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ sent.value[k].T
                    cell[mine], far[mine] = d2.argmin(axis=1), np.sqrt(np.maximum(0.0, d2.min(axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    placed = scratch.stored(points.mapInArrow(place, StructType([*points.schema.fields, StructField("cell", IntegerType()), StructField("far", DoubleType())])), "placed")
    counted = placed.groupBy("label", "dims", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("blocks", F.ceil(F.col("n") / (1.5 * block)).cast("int"))
    first = F.coalesce(F.sum("blocks").over(Window.partitionBy("label", "dims").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return placed, scratch.stored(counted.withColumn("first", first).select("label", "dims", "cell", "first", "blocks", "radius"), "cells"), sent


def _near(cells: DataFrame, sent: Broadcast, least: float):
    """Each cell with the blocks of all cells, its own among them, that may hold a partner."""
    reach = math.sqrt(2.0 - 2.0 * least) + CELL_SLACK
    known: dict[tuple, list[tuple]] = {}
    for r in cells.where("cell >= 0").sort("label", "dims", "cell").toLocalIterator():  # at most a row a centre
        known.setdefault((r["label"], r["dims"]), []).append((r["cell"], r["first"], r["blocks"], r["radius"]))
    table = cells.sparkSession.sparkContext.broadcast({k: np.array(v) for k, v in known.items()})

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            others = []
            for r in rows:
                if r["cell"] < 0:
                    others.append(np.arange(r["first"], r["first"] + r["blocks"], dtype=np.int32))
                    continue
                every, centre = table.value[r["label"], r["dims"]], sent.value[r["label"], r["dims"]]
                d2 = 2.0 - 2.0 * centre[every[:, 0].astype(int)] @ centre[r["cell"]]
                ok = np.sqrt(np.maximum(0.0, d2)) <= every[:, 3] + r["radius"] + reach
                others.append(np.concatenate([np.arange(f, f + n) for f, n in every[ok][:, 1:3].astype(int).tolist()]).astype(np.int32))
            plain = [batch.column(batch.schema.get_field_index(c)) for c in ("label", "dims", "cell", "first", "blocks")]
            yield pa.RecordBatch.from_arrays([*plain, pa.array(others, pa.list_(pa.int32()))], names=["label", "dims", "cell", "first", "blocks", "others"])

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, block: int = 1024) -> DataFrame:
    """One row per vector: ``key``, ``n_links``, ``component_id`` and ``kept``."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    length = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & (length > 0) & (length < float("inf")), F.lit(False))
    rows = rows.withColumn("good", good)
    points = scratch.stored(rows.where("good").groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("times")).withColumn("dims", F.size("vector")), "points")
    placed, cells, centres = _cells(points, block)
    near = cells.mapInArrow(_near(cells, centres, least), StructType([*cells.schema.fields[:5], StructField("others", ArrayType(IntegerType()))]))
    own = F.col("first") + F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int")
    spread = placed.join(near, ["label", "dims", "cell"]).select("label", "dims", own.alias("block"), "id", "times", "vector", F.explode("others").alias("other"))
    paired = spread.select("label", "dims", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "times", "vector")
    found = scratch.stored(paired.groupBy("label", "dims", "p", "q").applyInArrow(_group(least), "id long, links long, root long"), "links")
    summed = found.groupBy("id").agg(F.sum("links").alias("links"))
    label_of = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())
    known = points.select("label", "vector", "id", "times").join(summed, "id", "left").join(label_of.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.where("good").join(known, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
