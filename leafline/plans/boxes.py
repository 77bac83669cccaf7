"""Queries over boxes, taken from the first four embedding dimensions, and their SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.functions import boxes, covers
from leafline.operators import layouts, matching, tracks
from leafline.operators import sequences as seq
from leafline.plans.registry import registry
from leafline.sources.tables import load

QUERIES, ORACLE_SQL, query = registry()

_BOX = """b AS (SELECT vec_id, label, least(CAST(embedding[1] AS DOUBLE), CAST(embedding[3] AS DOUBLE)) AS x0, least(CAST(embedding[2] AS DOUBLE), CAST(embedding[4] AS DOUBLE)) AS y0,
 greatest(CAST(embedding[1] AS DOUBLE), CAST(embedding[3] AS DOUBLE)) AS x1, greatest(CAST(embedding[2] AS DOUBLE), CAST(embedding[4] AS DOUBLE)) AS y1 FROM embeddings)"""
_PAIR = """p AS (SELECT a.label, a.vec_id AS a_id, c.vec_id AS b_id, (least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS inter,
 (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (c.x1 - c.x0) * (c.y1 - c.y0) AS ab FROM b a JOIN b c ON a.label = c.label AND a.vec_id < c.vec_id AND a.x0 < c.x1 AND c.x0 < a.x1 AND a.y0 < c.y1 AND c.y0 < a.y1)"""


def boxed(spark: SparkSession, sf: str) -> DataFrame:
    d = [F.element_at("embedding", k).cast("double") for k in (1, 2, 3, 4)]
    return load(spark, sf, "embeddings").select("vec_id", "label", F.least(d[0], d[2]).alias("x0"), F.least(d[1], d[3]).alias("y0"), F.greatest(d[0], d[2]).alias("x1"), F.greatest(d[1], d[3]).alias("y1"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = boxed(spark, sf)
    return matching.overlapping(b, b, ["label"], size=0.05).where("a_vec_id < b_vec_id")


@query(f"WITH {_BOX}, {_PAIR} SELECT label, a_id, b_id, round(inter / (aa + ab - inter), 6) AS iou FROM p WHERE inter / (aa + ab - inter) >= 0.5")
def q17_iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = _pairs(spark, sf).withColumn("iou", boxes.iou(boxes.box("a_"), boxes.box("b_"))).where("iou >= 0.5")
    return found.select("label", F.col("a_vec_id").alias("a_id"), F.col("b_vec_id").alias("b_id"), F.round("iou", 6).alias("iou"))


@query(f"WITH {_BOX}, {_PAIR} SELECT label, a_id, b_id, round(inter / least(aa, ab), 6) AS share FROM p WHERE inter / least(aa, ab) >= 0.5")
def q18_containment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = _pairs(spark, sf).withColumn("share", boxes.contained(boxes.box("a_"), boxes.box("b_"))).where("share >= 0.5")
    return found.select("label", F.col("a_vec_id").alias("a_id"), F.col("b_vec_id").alias("b_id"), F.round("share", 6).alias("share"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    b = boxed(spark, sf)
    pairs = matching.overlapping(b.where("vec_id % 2 = 0"), b.where("vec_id % 2 = 1"), ["label"], size=0.05)
    return pairs.withColumn("iou", boxes.iou(boxes.box("a_"), boxes.box("b_"))).where("iou >= 0.2").select("label", "a_vec_id", "b_vec_id", "iou")


def _report(spark: SparkSession, sf: str, matched: DataFrame) -> DataFrame:
    old = F.col("vec_id") % 2 == 0
    counts = load(spark, sf, "embeddings").groupBy("label").agg(F.count_if(old).alias("old"), F.count_if(~old).alias("new"))
    hits = matched.groupBy("label").agg(F.count("*").alias("matched"), F.sum("iou").alias("total"))
    return counts.join(hits, "label", "left").select("label", "old", "new", F.coalesce("matched", F.lit(0)).alias("matched"), F.round(F.coalesce("total", F.lit(0.0)), 6).alias("total_iou"))


def _walk(order: str) -> str:
    """SQL of a greedy walk over the candidate pairs of each label in an order."""
    return f"""WITH {_BOX}, p AS (SELECT a.label, a.vec_id AS a_id, c.vec_id AS b_id, (least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS inter, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (c.x1 - c.x0) * (c.y1 - c.y0) AS ab
 FROM b a JOIN b c ON a.label = c.label AND a.vec_id % 2 = 0 AND c.vec_id % 2 = 1 AND a.x0 < c.x1 AND c.x0 < a.x1 AND a.y0 < c.y1 AND c.y0 < a.y1),
r AS (SELECT label, a_id, b_id, inter / (aa + ab - inter) AS iou FROM p WHERE inter / (aa + ab - inter) >= 0.2), w AS (SELECT label, list({{'a': a_id, 'b': b_id, 'iou': iou}} ORDER BY {order}) AS w FROM r GROUP BY 1),
t AS (SELECT label, list_reduce(w, lambda s, x: CASE WHEN list_contains(s.a, x.a) OR list_contains(s.b, x.b) THEN s ELSE {{'a': list_append(s.a, x.a), 'b': list_append(s.b, x.b), 'n': s.n + 1, 'total': s.total + x.iou}} END, {{'a': []::BIGINT[], 'b': []::BIGINT[], 'n': 0::BIGINT, 'total': 0::DOUBLE}}) AS t FROM w),
c AS (SELECT label, count(*) FILTER (vec_id % 2 = 0) AS old, count(*) FILTER (vec_id % 2 <> 0) AS new FROM embeddings GROUP BY 1)
SELECT c.label, old, new, coalesce(t.n, 0) AS matched, round(coalesce(t.total, 0), 6) AS total_iou FROM c LEFT JOIN t ON c.label = t.label"""


@query(_walk("a_id, iou DESC, b_id"))
def q19_greedy_by_row(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf, matching.greedy_by_row(_runs(spark, sf), ["label"], "a_vec_id", "b_vec_id", "iou"))


@query(_walk("iou DESC, a_id, b_id"))
def q19b_greedy_by_score(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf, matching.greedy_by_score(_runs(spark, sf), ["label"], "a_vec_id", "b_vec_id", "iou"))


@query(f"""
WITH {_BOX}, d AS (SELECT l.vec_id, r.vec_id AS n, abs(l.x0 - r.x0) AS d FROM b l JOIN b r ON l.label = r.label AND l.vec_id % 2 = 0 AND r.vec_id % 2 = 1 AND abs(l.x0 - r.x0) <= 0.01)
SELECT vec_id, arg_min(n, row(d, n)) AS nearest FROM d GROUP BY 1""")
def q19c_nearest_within(spark: SparkSession, sf: str) -> DataFrame:
    b = boxed(spark, sf).select("vec_id", "label", "x0")
    return matching.nearest_within(b.where("vec_id % 2 = 0"), b.where("vec_id % 2 = 1"), ["label"], "x0", "vec_id", 0.01).select("vec_id", "nearest")


@query(f"""
WITH {_BOX}, d AS (SELECT l.label, l.vec_id AS a, r.vec_id AS b, abs(l.x0 - r.x0) AS d FROM b l JOIN b r ON l.label = r.label AND l.vec_id % 10 = 0 AND r.vec_id % 2 = 1 AND abs(l.x0 - r.x0) <= 0.01),
w AS (SELECT label, list({{'a': a, 'b': b}} ORDER BY a, d, b) AS w FROM d GROUP BY 1),
t AS (SELECT label, list_reduce(w, lambda s, x: CASE WHEN list_contains(s.a, x.a) OR list_contains(s.b, x.b) THEN s ELSE {{'a': list_append(s.a, x.a), 'b': list_append(s.b, x.b)}} END, {{'a': []::BIGINT[], 'b': []::BIGINT[]}}) AS t FROM w)
SELECT label, unnest(t.a) AS left_key, unnest(t.b) AS right_key FROM t""")
def q19d_nearest_once(spark: SparkSession, sf: str) -> DataFrame:
    b = boxed(spark, sf).select("vec_id", "label", "x0")
    found = matching.nearest_once(b.where("vec_id % 10 = 0"), b.where("vec_id % 2 = 1"), ["label"], "x0", "vec_id", 0.01)
    return found.select("label", "left_key", "right_key")


@query(f"""
WITH {_BOX}, x AS (SELECT label, x0 AS v FROM b UNION SELECT label, x1 FROM b), xs AS (SELECT label, v AS lo, lead(v) OVER (PARTITION BY label ORDER BY v) AS hi FROM x),
s AS (SELECT xs.label, lo, hi, y0, y1, max(y1) OVER (PARTITION BY xs.label, lo ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM xs JOIN b ON b.label = xs.label AND x0 <= lo AND x1 >= hi)
SELECT label, round(sum((hi - lo) * greatest(0, y1 - greatest(y0, coalesce(reach, y0)))), 6) AS area FROM s GROUP BY 1""")
def q26_union_area(spark: SparkSession, sf: str) -> DataFrame:
    return matching.union_area(boxed(spark, sf), ["label"], size=0.05).select("label", F.round("area", 6).alias("area"))


@query(f"""
WITH {_BOX}, r AS (SELECT label, x0 AS nxt, max(x1) OVER (PARTITION BY label ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b WHERE x1 - x0 < 0.02)
SELECT label, arg_max(reach, row(nxt - reach, -reach)) AS start, arg_max(nxt, row(nxt - reach, -reach)) AS "end" FROM r WHERE nxt > reach GROUP BY 1""")
def q34_widest_band(spark: SparkSession, sf: str) -> DataFrame:
    return seq.widest_gap(boxed(spark, sf).where("x1 - x0 < 0.02"), ["label"], "x0", "x1")


_RECTS = ((-0.2, -0.2, -0.05, 0.1), (-0.05, -0.1, 0.1, 0.02), (0.0, 0.0, 0.2, 0.2), (0.05, -0.3, 0.3, -0.02))
_RECT_SQL = ", ".join("{{'x0': {}::DOUBLE, 'y0': {}::DOUBLE, 'x1': {}::DOUBLE, 'y1': {}::DOUBLE}}".format(*r) for r in _RECTS)


def _rects() -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(s) for s, v in zip(boxes.SIDES, r, strict=True))) for r in _RECTS))


@query(f"""WITH {_BOX} SELECT vec_id, CASE WHEN greatest(x0, -0.1) < least(x1, 0.1) AND greatest(y0, -0.1) < least(y1, 0.1) THEN round((least(x1, 0.1) - greatest(x0, -0.1)) * (least(y1, 0.1) - greatest(y0, -0.1)), 6) END AS left_area,
 CAST(trunc(x0 / (800 / 1700.0) * 1) AS INTEGER) AS px0, CAST(trunc(y1 * 10000 / (1000 / 2200.0)) AS INTEGER) AS py1 FROM b""")
def q104_clipped_and_rescaled(spark: SparkSession, sf: str) -> DataFrame:
    b = boxed(spark, sf)
    c = boxes.clip(boxes.box(), tuple(F.lit(v) for v in (-0.1, -0.1, 0.1, 0.1)))
    big = boxes.rescaled((F.col("x0"), F.col("y0") * 10000, F.col("x1"), F.col("y1") * 10000), (F.lit(800.0), F.lit(1000.0)), (F.lit(1700.0), F.lit(2200.0)))
    return b.select("vec_id", F.round((c["x1"] - c["x0"]) * (c["y1"] - c["y0"]), 6).alias("left_area"), big[0].alias("px0"), big[3].alias("py1"))


@query(f"""WITH {_BOX}, s AS (SELECT vec_id, list_max(list_transform([{_RECT_SQL}], lambda r: greatest(least(x1, r.x1) - greatest(x0, r.x0), 0) * greatest(least(y1, r.y1) - greatest(y0, r.y0), 0) / ((x1 - x0) * (y1 - y0)))) AS share FROM b WHERE x1 > x0 AND y1 > y0)
SELECT vec_id, round(share, 6) AS share, CASE WHEN share >= 0.5 THEN 'footnotes' ELSE 'body' END AS section FROM s""")
def q105_section_by_zone(spark: SparkSession, sf: str) -> DataFrame:
    share = boxes.zone_share(boxes.box(), _rects())
    rows = boxed(spark, sf).where("x1 > x0 AND y1 > y0").withColumn("share", share)
    return rows.select("vec_id", F.round("share", 6).alias("share"), F.when(F.col("share") >= 0.5, "footnotes").otherwise("body").alias("section"))


_SHARE_SQL = "greatest(least(x1, {2}) - greatest(x0, {0}), 0) * greatest(least(y1, {3}) - greatest(y0, {1}), 0) / ((x1 - x0) * (y1 - y0))"


@query(f"""WITH {_BOX}, s AS (SELECT vec_id, {_SHARE_SQL.format(*_RECTS[0])} AS red, {_SHARE_SQL.format(*_RECTS[2])} AS outside, {_SHARE_SQL.format(*_RECTS[1])} AS framed FROM b WHERE x1 > x0 AND y1 > y0)
SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN 'unjudged' WHEN vec_id % 50 = 1 THEN 'running_head' WHEN vec_id % 7 = 2 AND greatest(red, outside) < 0.9 THEN 'page_number' WHEN red >= 0.1 AND red >= outside THEN 'redaction' WHEN outside >= 0.1 THEN 'outside'
 WHEN vec_id % 7 = 2 THEN 'page_number' WHEN framed < 0.25 THEN 'undetected' END AS reason FROM s""")
def q106_exclusion_verdict(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda k: boxes.zone_share(boxes.box(), F.array(F.struct(*(F.lit(v).alias(s) for s, v in zip(boxes.SIDES, _RECTS[k], strict=True)))))
    why = boxes.verdict(F.col("vec_id") % 50 != 0, F.col("vec_id") % 50 == 1, share(0), share(2), F.col("vec_id") % 7 == 2, share(1))
    return boxed(spark, sf).where("x1 > x0 AND y1 > y0").select("vec_id", why["reason"].alias("reason"))


@query(f"""WITH {_BOX}, n AS (SELECT *, list_filter([{_RECT_SQL}], lambda r: x0 < r.x1 AND r.x0 < x1 AND y0 < r.y1 AND r.y0 < y1) AS near FROM b),
f AS (SELECT *, greatest(x0, list_min(list_transform(near, lambda r: r.x0)) - 0.01) AS a, least(x1, list_max(list_transform(near, lambda r: r.x1)) + 0.01) AS z FROM n),
w AS (SELECT *, CASE WHEN x1 <= x0 THEN 'refused' WHEN len(near) = 0 THEN 'unreached' WHEN a >= z OR z - a < (x1 - x0) * 0.4 THEN 'refused' ELSE '' END AS why FROM f)
SELECT vec_id, why, round(CASE WHEN why = '' THEN a END, 6) AS x0, round(CASE WHEN why = '' THEN z END, 6) AS x1 FROM w""")
def q107_fitted_span(spark: SparkSession, sf: str) -> DataFrame:
    f = boxes.fit_span(boxes.box(), _rects(), 0.01)
    return boxed(spark, sf).select("vec_id", f["why"].alias("why"), F.round(f["x0"], 6).alias("x0"), F.round(f["x1"], 6).alias("x1"))


@query(f"""WITH {_BOX}, i AS (SELECT *, least(greatest(x0, 0), 0.15) AS i0, least(greatest(y0, 0), 0.15) AS j0, least(greatest(x1, 0), 0.15) AS i1, least(greatest(y1, 0), 0.15) AS j1 FROM b),
h AS (SELECT *, list_filter([{_RECT_SQL}], lambda r: i0 < r.x1 AND r.x0 < i1 AND j0 < r.y1 AND r.y0 < j1) AS near FROM i),
t AS (SELECT *, CASE WHEN x0 < 0 AND len(near) > 0 THEN list_min(list_transform(near, lambda r: r.x0)) ELSE x0 END AS a, CASE WHEN y0 < 0 AND len(near) > 0 THEN list_min(list_transform(near, lambda r: r.y0)) ELSE y0 END AS c,
 CASE WHEN x1 > 0.15 AND len(near) > 0 THEN list_max(list_transform(near, lambda r: r.x1)) ELSE x1 END AS z, CASE WHEN y1 > 0.15 AND len(near) > 0 THEN list_max(list_transform(near, lambda r: r.y1)) ELSE y1 END AS e FROM h),
k AS (SELECT *, least(greatest(a, 0), 0.15) AS fa, least(greatest(c, 0), 0.15) AS fc, least(greatest(z, 0), 0.15) AS fz, least(greatest(e, 0), 0.15) AS fe FROM t)
SELECT vec_id, round(CASE WHEN fa < fz AND fc < fe THEN fz - fa ELSE i1 - i0 END, 6) AS width, round(CASE WHEN fa < fz AND fc < fe THEN fe - fc ELSE j1 - j0 END, 6) AS height FROM k""")
def q108_fitted_overrun(spark: SparkSession, sf: str) -> DataFrame:
    f = boxes.fit_overrun(boxes.box(), F.lit(0.15), F.lit(0.15), _rects())
    return boxed(spark, sf).select("vec_id", F.round(f["x1"] - f["x0"], 6).alias("width"), F.round(f["y1"] - f["y0"], 6).alias("height"))


# Boxes of a page in points from the embedding's, and covers near them: two with a seam, two that overlap
_POINTS = """g AS (SELECT vec_id, 300 + 900 * x0 AS x0, 300 + 900 * y0 AS y0, 300 + 900 * x1 AS x1, 300 + 900 * y1 AS y1 FROM b WHERE x1 > x0 AND y1 > y0)"""
_COVERS = ((80.0, 80.0, 290.0, 400.0), (292.5, 80.0, 420.0, 300.0), (150.0, 390.0, 300.0, 500.0), (400.0, 303.0, 520.0, 520.0))
_COVER_SQL = ", ".join("({}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {})".format(*r, k) for k, r in enumerate(_COVERS))
_SHARE = f"""{_POINTS}, c AS (SELECT * FROM (VALUES {_COVER_SQL}) v(a0, b0, a1, b1, k)),
k AS (SELECT *, x0 + least(3, (x1 - x0) / 4) AS u0, y0 + least(3, (y1 - y0) / 4) AS v0, x1 - least(3, (x1 - x0) / 4) AS u1, y1 - least(3, (y1 - y0) / 4) AS v1 FROM g),
h AS (SELECT vec_id, c.* FROM k JOIN c ON a0 < u1 + 3 AND a1 > u0 - 3 AND b0 < v1 + 3 AND b1 > v0 - 3),
q AS (SELECT l.vec_id, greatest(l.a0, r.a0) AS m0, least(l.a1, r.a1) AS m1, greatest(l.b0, r.b0) AS n0, least(l.b1, r.b1) AS n1 FROM h l JOIN h r ON l.vec_id = r.vec_id AND l.k < r.k),
e AS (SELECT vec_id, a0, b0, a1, b1 FROM h UNION ALL SELECT vec_id, m0, n1, m1, n0 FROM q WHERE m1 > m0 AND n1 <= n0 AND n0 - n1 <= 3 UNION ALL SELECT vec_id, m1, n0, m0, n1 FROM q WHERE n1 > n0 AND m1 <= m0 AND m0 - m1 <= 3),
t AS (SELECT e.vec_id, greatest(a0, u0) AS a0, greatest(b0, v0) AS b0, least(a1, u1) AS a1, least(b1, v1) AS b1 FROM e JOIN k USING (vec_id) WHERE greatest(a0, u0) < least(a1, u1) AND greatest(b0, v0) < least(b1, v1)),
xs AS (SELECT vec_id, v AS lo, lead(v) OVER (PARTITION BY vec_id ORDER BY v) AS hi FROM (SELECT vec_id, a0 AS v FROM t UNION SELECT vec_id, a1 FROM t)), ys AS (SELECT vec_id, v AS lo, lead(v) OVER (PARTITION BY vec_id ORDER BY v) AS hi FROM (SELECT vec_id, b0 AS v FROM t UNION SELECT vec_id, b1 FROM t)),
w AS (SELECT xs.vec_id, (xs.hi - xs.lo) * (ys.hi - ys.lo) AS area FROM xs JOIN ys USING (vec_id) WHERE EXISTS (SELECT 1 FROM t WHERE t.vec_id = xs.vec_id AND a0 <= xs.lo AND a1 >= xs.hi AND b0 <= ys.lo AND b1 >= ys.hi)),
n AS (SELECT vec_id, sum(area) AS area FROM w GROUP BY 1), o AS (SELECT vec_id, max((least(a1, u1) - greatest(a0, u0)) * (least(b1, v1) - greatest(b0, v0))) AS most FROM k JOIN c ON a0 < u1 AND u0 < a1 AND b0 < v1 AND v0 < b1 GROUP BY 1),
s AS (SELECT k.vec_id, CASE WHEN o.most IS NULL THEN 0 ELSE least(1, n.area / ((u1 - u0) * (v1 - v0))) END AS share FROM k LEFT JOIN n ON n.vec_id = k.vec_id LEFT JOIN o ON o.vec_id = k.vec_id)"""


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return boxed(spark, sf).where("x1 > x0 AND y1 > y0").select("vec_id", *((300 + 900 * F.col(s)).alias(s) for s in boxes.SIDES))


def _cover_boxes(some=_COVERS) -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(s) for s, v in zip(boxes.SIDES, r, strict=True))) for r in some))


@query(f"WITH {_BOX}, {_SHARE} SELECT vec_id, round(share, 6) AS share FROM s")
def q132_covered_share(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).select("vec_id", F.round(covers.covered_share(boxes.box(), _cover_boxes()), 6).alias("share"))


@query(f"""WITH {_BOX}, {_SHARE} SELECT vec_id, CASE WHEN share >= 0.1 THEN 'redaction' END AS reason, CASE WHEN share < 0.9 AND share > 0 THEN 'part' WHEN share > 0 THEN 'whole' ELSE 'none' END AS cover FROM s""")
def q133_cover_verdict(spark: SparkSession, sf: str) -> DataFrame:
    share = covers.covered_share(boxes.box(), _cover_boxes())
    no = F.lit(False)
    rows = _points(spark, sf).withColumn("share", share)
    why = boxes.verdict(F.lit(True), no, F.col("share"), F.lit(0.0), no, F.lit(1.0))
    return rows.select("vec_id", why["reason"].alias("reason"), F.when((F.col("share") < boxes.FULL_COVER) & (F.col("share") > 0), "part").when(F.col("share") > 0, "whole").otherwise("none").alias("cover"))


# Lines of a page from the line items of a part: most start at a leaning edge, some are indented, few lie outside
_LINES = """i AS (SELECT l_partkey AS page, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS line, l_orderkey AS o, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS n FROM lineitem),
l AS (SELECT page, line, CAST((o * 37 + n * 11) % 3000 AS DOUBLE) AS y, 200 + 0.01 * ((o * 37 + n * 11) % 3000) + CASE WHEN q % 7 = 0 THEN 40 + q WHEN q % 19 = 0 THEN -25 ELSE q % 5 END AS x FROM i)"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    # the SQL leaves lines of one order and number in any order; here the rest of a line decides
    n = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_quantity"))
    q, y = F.col("l_quantity").cast("int"), (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 3000
    off = F.when(q % 7 == 0, 40 + q).when(q % 19 == 0, -25).otherwise(q % 5)
    x = F.lit(Decimal("0.01")) * y.cast("decimal(4,0)") + (200 + off).cast("decimal(4,0)")  # exact, as in the SQL
    return load(spark, sf, "lineitem").select(F.col("l_partkey").alias("page"), n.alias("line"), y.cast("double").alias("y"), x.alias("x"))


@query(f"""WITH {_LINES}, p AS (SELECT a.page, a.line AS first, b.line AS second, a.x AS fx, a.y AS fy, (b.x - a.x) / (b.y - a.y) AS slope FROM l a JOIN l b ON a.page = b.page AND a.line < b.line AND abs(b.y - a.y) >= 300 WHERE abs((b.x - a.x) / (b.y - a.y)) <= 0.035),
r AS (SELECT p.page, first, second, l.x - (fx + slope * (l.y - fy)) AS r FROM p JOIN l USING (page)), s AS (SELECT page, first, second, count(*) FILTER (r BETWEEN -10 AND 6) AS hugging, count(*) FILTER (r < -14) AS outside FROM r GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY hugging - 6 * outside DESC, outside, hugging DESC, first, second) AS rank FROM s) SELECT page, CAST(first AS INTEGER) AS first, CAST(second AS INTEGER) AS second, CAST(hugging AS INTEGER) AS hugging, CAST(outside AS INTEGER) AS outside FROM k WHERE rank = 1""")
def q130_edge_proposals(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.proposals(_lines(spark, sf), ["page"]).select("page", "first", "second", "hugging", "outside")


@query()
def q131_column_edges(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda y: F.col("c0") + F.col("c1") * (y - F.col("middle")) / F.col("scale") + F.col("c2") * F.pow((y - F.col("middle")) / F.col("scale"), F.lit(2))
    found = tracks.edges(_lines(spark, sf), ["page"])
    return found.select("page", "n", F.round(at(F.col("low")), 4).alias("top"), F.round(at(F.col("high")), 4).alias("bottom"))


@query(f"""WITH {_BOX}, k AS (SELECT vec_id, vec_id % 7 AS k, x0, y0, x1, y1, x1 > x0 AND y1 > y0 AS legal FROM b)
SELECT vec_id, CASE WHEN k = 6 THEN 'Expecting value' WHEN NOT legal THEN 'cell 0: a box without an area' END AS fault, CASE k WHEN 1 THEN 'escaped' WHEN 2 THEN 'marked' WHEN 3 THEN 'cut' WHEN 4 THEN 'controls' WHEN 5 THEN 'escaped,cut' ELSE '' END AS edits,
 CASE WHEN k = 6 OR NOT legal THEN NULL ELSE round(x1 - x0, 6) END AS width, CASE WHEN k = 6 OR NOT legal THEN NULL WHEN k IN (1, 5) THEN 'said "out." and ' || vec_id WHEN k = 2 THEN 'see "' || vec_id WHEN k = 4 THEN 'line' || chr(10) || vec_id ELSE 'plain ' || vec_id END AS text FROM k""")
def q140_mended_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with a planted fault each: stray marks, loose backslashes, trailing text, line breaks, garbage."""
    k, n = F.col("vec_id") % 7, F.col("vec_id").cast("string")
    quote, slash = F.lit('"'), F.lit("\\")
    text = F.when(k.isin(1, 5), F.concat(F.lit('said \\"out."'), F.lit(" and "), n)).when(k == 2, F.concat(F.lit("see "), slash, F.lit(" "), n)).when(k == 4, F.concat(F.lit("line\n"), n)).otherwise(F.concat(F.lit("plain "), n))
    text = F.when(k == 2, F.concat(F.lit("see "), slash, n)).otherwise(text)
    body = F.concat(F.lit('[{"bbox": ['), F.concat_ws(", ", *(F.col(s).cast("string") for s in boxes.SIDES)), F.lit('], "category": "Text", "text": '), quote, text, quote, F.lit("}]"))
    answer = F.when(k == 6, F.lit("no answer")).when(k.isin(3, 5), F.concat(body, F.lit("]}"))).otherwise(body)
    got = boxed(spark, sf).select("vec_id", layouts.cells(answer).alias("m"))
    cell = F.get("m.cells", F.lit(0))
    return got.select("vec_id", F.col("m.fault").alias("fault"), F.array_join("m.edits", ",").alias("edits"), F.round(F.get(cell["bbox"], F.lit(2)) - F.get(cell["bbox"], F.lit(0)), 6).alias("width"), cell["text"].alias("text"))
