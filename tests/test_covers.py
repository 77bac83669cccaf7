"""Covers against a grid, column edges against numpy's least squares."""

import random

import numpy as np
import pytest
from oracle import differences
from pyspark.sql import functions as F

from leafline.functions import boxes, covers
from leafline.operators import tracks
from leafline.plans import catalogue


def slow_share(box, rects, step=0.5):
    """The share on a grid of half points, with the rule of the seams written out."""
    dx, dy = min(3, (box[2] - box[0]) / 4), min(3, (box[3] - box[1]) / 4)
    core = (box[0] + dx, box[1] + dy, box[2] - dx, box[3] - dy)
    if core[2] <= core[0] or core[3] <= core[1] or not any(r[0] < core[2] and core[0] < r[2] and r[1] < core[3] and core[1] < r[3] for r in rects):
        return 0.0
    near = [r for r in rects if r[0] < core[2] + 3 and r[2] > core[0] - 3 and r[1] < core[3] + 3 and r[3] > core[1] - 3]
    every = list(near)
    for i, a in enumerate(near):
        for b in near[i + 1 :]:
            x0, x1, y0, y1 = max(a[0], b[0]), min(a[2], b[2]), max(a[1], b[1]), min(a[3], b[3])
            if x1 > x0 and 0 <= y0 - y1 <= 3:
                every.append((x0, y1, x1, y0))
            if y1 > y0 and 0 <= x0 - x1 <= 3:
                every.append((x1, y0, x0, y1))
    xs, ys = np.arange(core[0], core[2], step) + step / 2, np.arange(core[1], core[3], step) + step / 2
    grid = np.zeros((len(xs), len(ys)), bool)
    for r in every:
        grid |= np.outer((xs > r[0]) & (xs < r[2]), (ys > r[1]) & (ys < r[3]))
    return grid.mean()


def test_shares_against_a_grid(spark):
    made = random.Random(4)
    side = lambda top: sorted(made.sample(range(0, top, 2), 2))
    rows = []
    for k in range(120):
        (x0, x1), (y0, y1) = side(60), side(40)
        rects = [[*(float(v) for v in (a, c, b, d))] for (a, b), (c, d) in ((side(60), side(40)) for _ in range(made.randrange(6)))]
        rows.append((k, float(x0), float(y0), float(max(x1, x0 + 12)), float(max(y1, y0 + 12)), rects))
    rows += [(900, 0.0, 0.0, 0.0, 5.0, [[0.0, 0.0, 9.0, 9.0]]), (901, 0.0, 0.0, 40.0, 20.0, []), (902, 0.0, 0.0, 40.0, 20.0, [[0.0, 0.0, 20.0, 20.0], [22.0, 0.0, 40.0, 20.0]]), (903, 0.0, 0.0, 40.0, 20.0, [[0.0, 0.0, 20.0, 20.0], [24.0, 0.0, 40.0, 20.0]])]
    df = spark.createDataFrame(rows, "k int, x0 double, y0 double, x1 double, y1 double, r array<array<double>>")
    df = df.withColumn("r", F.transform("r", lambda r: F.struct(*(r[i].alias(s) for i, s in enumerate(boxes.SIDES)))))
    got = {r["k"]: r for r in df.select("k", covers.covered_share(boxes.box(), F.col("r")).alias("share"), covers.most_covering(boxes.box(), F.col("r")).alias("most")).collect()}
    for k, x0, y0, x1, y1, rects in rows:
        assert got[k]["share"] == pytest.approx(slow_share((x0, y0, x1, y1), rects), abs=1e-9), (k, rects)
    assert (got[902]["share"], got[902]["most"]) == (1.0, 0) and got[903]["share"] < 0.9 and got[901]["most"] is None


def slow_edge(lines, start=True):
    x, y = np.array([p[1] for p in lines]), np.array([p[2] for p in lines])
    hugs = lambda r: (r >= -10) & (r <= 6) if start else (r >= -6) & (r <= 10)
    strays = lambda r: r < -14 if start else r > 14
    found = []
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            if abs(y[j] - y[i]) >= 300 and abs(slope := (x[j] - x[i]) / (y[j] - y[i])) <= 0.035:
                r = x - (x[i] + slope * (y - y[i]))
                n, out = int(hugs(r).sum()), int(strays(r).sum())
                found.append((-(n - 6 * out), out, -n, i, j))
    if not found:
        return None
    *_, i, j = min(found)
    keep = hugs(x - (x[i] + (x[j] - x[i]) / (y[j] - y[i]) * (y - y[i])))
    for _ in range(3):
        if keep.sum() < 6:
            return None
        fit = np.polyfit(y[keep], x[keep], 2 if keep.sum() >= 15 else 1)
        r = x - np.polyval(fit, y)
        keep = hugs(r)
    if keep.sum() < 8 or np.ptp(y[keep]) < 500 or strays(r).sum() > 0.3 * keep.sum():
        return None
    return int(keep.sum()), float(np.polyval(fit, y[keep].min())), float(np.polyval(fit, y[keep].max()))


@pytest.mark.parametrize("start", [True, False])
def test_edges_against_numpy(spark, start):
    made = random.Random(6)
    pages = {}
    for page in range(14):
        lean, bend = made.uniform(-0.02, 0.02), made.uniform(-1e-6, 1e-6)
        lines = []
        for line in range(made.choice([3, 9, 14, 30, 45])):
            y = float(made.randrange(0, 2800))
            off = made.choice([0, 0, 0, 1, 2, 30, 45]) * (1 if start else -1) + made.random()
            lines.append((line, 300 + lean * y + bend * y * y + off + (-40 if made.random() < 0.02 else 0), y))
        pages[page] = lines
    df = spark.createDataFrame([(k, *p) for k, lines in pages.items() for p in lines], "page int, line int, x double, y double")
    at = lambda r, y: r["c0"] + r["c1"] * (y - r["middle"]) / r["scale"] + r["c2"] * ((y - r["middle"]) / r["scale"]) ** 2
    got = {r["page"]: (r["n"], at(r, r["low"]), at(r, r["high"])) for r in tracks.edges(df, ["page"], start).collect()}
    want = {k: e for k, lines in pages.items() if (e := slow_edge(lines, start))}
    assert got.keys() == want.keys() and len(got) > 5
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-5)
    assert tracks.edges(df.where("false"), ["page"], start).count() == 0


def test_lines_on_the_border_of_an_edge_hug_as_in_sql(spark):
    """Many lines lie exactly ten inside or six outside; sums of doubles put some on the wrong side."""
    sf = "/root/testdata/sf0.01"
    assert differences(catalogue.QUERIES["q130_edge_proposals"](spark, sf), catalogue.ORACLE_SQL["q130_edge_proposals"], sf) == ""
