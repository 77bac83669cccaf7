"""Queries over ordered rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.functions import pages, scalars
from leafline.operators import relational as rel
from leafline.operators import sequences as seq
from leafline.operators import scoring, windows
from leafline.plans.registry import registry
from leafline.sources.tables import load

QUERIES, ORACLE_SQL, query = registry()


@query("""
SELECT e.event_id, p.event_id AS matched_event_id FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.ts - p.ts <= INTERVAL 1 DAY""")
def q16_as_of(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    found = rel.as_of(events.where("event_type = 'error'"), events.where("event_type = 'purchase'"), ["user_id"], "ts", ["event_id"])
    return found.where(F.col("matched_at") >= F.col("ts") - F.expr("INTERVAL 1 DAY")).select("event_id", "matched_event_id")


@query("""
WITH c AS (SELECT 'conversation' AS kind, conv_id AS id, turn AS v FROM conversations UNION ALL SELECT 'order', l_orderkey, l_linenumber FROM lineitem),
s AS (SELECT kind, id, v, v - lag(v) OVER (PARTITION BY kind, id ORDER BY v) AS step FROM c)
SELECT kind, id, count(*) AS n, min(v) = 0 AND max(v) = count(*) - 1 AND count(*) FILTER (step <> 1) = 0 AS whole, count(*) FILTER (step <> 1) AS breaks FROM s GROUP BY 1, 2""")
def q20_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    turns = load(spark, sf, "conversations").select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("v"))
    lines = load(spark, sf, "lineitem").select(F.lit("order").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("v"))
    return seq.contiguous(turns.unionByName(lines), ["kind", "id"], "v")


@query("""
WITH u AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), r AS (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS g FROM u)
SELECT min(doc_id) AS start, max(doc_id) AS "end", max(doc_id) - min(doc_id) + 1 AS n FROM r GROUP BY g""")
def q25_gaps_and_islands(spark: SparkSession, sf: str) -> DataFrame:
    unlabelled = load(spark, sf, "documents").select("doc_id").join(load(spark, sf, "labels"), "doc_id", "left_anti")
    return seq.islands(unlabelled, "doc_id")


@query("""
WITH d AS (SELECT source, count(*) AS pages, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1),
n AS (SELECT *, CAST(least(pages, greatest(1, ceil(size / 20000.0), ceil(pages / 10.0))) AS BIGINT) AS shards FROM d)
SELECT source, shards, shard, CAST(floor(shard * pages / shards) AS BIGINT) AS first_page, CAST(floor((shard + 1) * pages / shards) AS BIGINT) - 1 AS last_page
FROM (SELECT *, unnest(range(shards)) AS shard FROM n)""")
def q27_shard_plan(spark: SparkSession, sf: str) -> DataFrame:
    sized = load(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("pages"), F.sum("n_chars").alias("size"))
    return seq.plan_shards(sized, "pages", "size", 20000, 10).select("source", "shards", "shard", "first_page", "last_page")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS arrival FROM orders")
def q28_arrival_rank(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf, "orders").select("o_orderkey", (F.row_number().over(order) - 1).cast("long").alias("arrival"))


@query("""
WITH t AS (SELECT conv_id, turn, CASE WHEN substr(md5(concat(conv_id, '|', turn)), 1, 1) < '4' THEN 999 ELSE turn + 10 END AS v FROM conversations),
w AS (SELECT *, lag(v) OVER p AS b, lead(v) OVER p AS a FROM t WINDOW p AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN b + 1 = a - 1 AND v <> b + 1 AND b + 1 = turn + 10 THEN b + 1 ELSE v END AS resolved FROM w""")
def q29_by_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.substring(F.md5(F.concat("conv_id", F.lit("|"), "turn")), 1, 1) < "4"
    read = load(spark, sf, "conversations").select("conv_id", "turn", F.when(odd, 999).otherwise(F.col("turn") + 10).alias("v"), F.array(F.col("turn") + 10).alias("candidates"))
    return seq.by_neighbours(read, ["conv_id"], "turn", "v", "candidates").select("conv_id", "turn", "resolved")


@query("""
WITH t AS (SELECT conv_id, turn, CASE WHEN substr(md5(concat('i|', conv_id, '|', turn)), 1, 1) < '6' THEN NULL ELSE turn * 3 + 5 END AS v FROM conversations),
w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN turn END IGNORE NULLS) OVER b AS lt, last_value(v IGNORE NULLS) OVER b AS lv,
 first_value(CASE WHEN v IS NOT NULL THEN turn END IGNORE NULLS) OVER a AS rt, first_value(v IGNORE NULLS) OVER a AS rv FROM t
 WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT conv_id, turn, CAST(round_even(coalesce(lv + (rv - lv) * (turn - lt) / CAST(rt - lt AS DOUBLE), CAST(coalesce(lv + turn - lt, rv - (rt - turn)) AS DOUBLE)), 0) AS BIGINT) AS expected FROM w""")
def q30_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    gone = F.substring(F.md5(F.concat(F.lit("i|"), "conv_id", F.lit("|"), "turn")), 1, 1) < "6"
    read = load(spark, sf, "conversations").select("conv_id", "turn", F.when(~gone, F.col("turn") * 3 + 5).alias("v"))
    return seq.interpolate(read, ["conv_id"], "turn", "v").select("conv_id", "turn", "expected")


@query("""
WITH t AS (SELECT conv_id, turn, turn + 1 AS e, turn + 1 + CASE WHEN substr(md5(concat('m|', conv_id)), 1, 1) < '8' AND turn > 0 THEN 4 ELSE 0 END AS v FROM conversations),
c AS (SELECT conv_id, v - e AS off, count(*) AS n, min(turn) AS f FROM t GROUP BY 1, 2),
b AS (SELECT conv_id, arg_min(off, row(-n, f)) AS off, max(n) AS n, sum(n) AS a FROM c GROUP BY 1)
SELECT conv_id, turn, CASE WHEN off <> 0 AND n * 2 >= a THEN v - off ELSE v END AS corrected FROM t JOIN b USING (conv_id)""")
def q30b_modal_offset(spark: SparkSession, sf: str) -> DataFrame:
    moved = (F.substring(F.md5(F.concat(F.lit("m|"), "conv_id")), 1, 1) < "8") & (F.col("turn") > 0)
    read = load(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("e"), (F.col("turn") + 1 + F.when(moved, 4).otherwise(0)).alias("v"))
    return seq.modal_offset(read, ["conv_id"], "v", "e", "turn").select("conv_id", "turn", "corrected")


@query("""
SELECT user_id, event_id FROM events QUALIFY coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) = false""")
def q31_leading_run(spark: SparkSession, sf: str) -> DataFrame:
    seen = F.bool_or(F.col("event_type") == "purchase").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return load(spark, sf, "events").withColumn("seen", seen).where("NOT seen").select("user_id", "event_id")


@query("""
WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem),
d AS (SELECT DISTINCT l_orderkey, v FROM l), h AS (SELECT *, lead(v) OVER (PARTITION BY l_orderkey ORDER BY v) AS nx FROM d), p AS (SELECT *, lag(v) OVER (PARTITION BY l_orderkey ORDER BY o) AS pv FROM l)
SELECT l_orderkey, CASE WHEN nx - v - 1 > 3 THEN 'large_gap' ELSE 'missing' END AS finding, v + 1 AS first, nx - 1 AS last FROM h WHERE nx > v + 1
UNION ALL SELECT l_orderkey, 'duplicate', v, v FROM l GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT l_orderkey, 'backward', v, v FROM p WHERE v < pv""")
def q32_sequence_checks(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("v"), F.row_number().over(order).alias("o"))
    return seq.sequence_checks(lines, ["l_orderkey"], "o", "v", most_missing=3)


@query("""
WITH w AS (SELECT user_id, value, avg(value) OVER r AS m, count(*) OVER r AS c, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT user_id, round(CASE WHEN max(n) <= 5 THEN avg(value) ELSE max(m) FILTER (c = 5) END, 6) AS most, round(CASE WHEN max(n) <= 5 THEN avg(value) ELSE min(m) FILTER (c = 5) END, 6) AS least FROM w GROUP BY 1""")
def q33_worst_run(spark: SparkSession, sf: str) -> DataFrame:
    out = seq.worst_run(load(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 5)
    return out.select("user_id", F.round("most", 6).alias("most"), F.round("least", 6).alias("least"))


@query("""
WITH a AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS l FROM events)
SELECT event_id, l[(len(l) + 1) // 2] AS smooth FROM a""")
def q33b_running_median(spark: SparkSession, sf: str) -> DataFrame:
    return seq.running_median(load(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", "smooth")


@query("""
WITH s AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM events)
SELECT event_id, segment, row_number() OVER (PARTITION BY user_id ORDER BY segment, round_even(value / 50, 0), ts, event_id) AS reading_rank FROM s""")
def q35_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    cut = seq.segments(load(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase")
    order = Window.partitionBy("user_id").orderBy("segment", F.bround(F.col("value") / 50), "ts", "event_id")
    return cut.select("event_id", "segment", F.row_number().over(order).cast("long").alias("reading_rank"))


_KIND = "substr(md5(concat('e|', conv_id, '|', turn)), 1, 1)"


@query(f"""
WITH p AS (SELECT conv_id, turn, CASE WHEN {_KIND} < '2' THEN 'delete' WHEN {_KIND} < '4' THEN 'move' WHEN {_KIND} < '6' THEN 'insert' WHEN {_KIND} < '8' THEN 'replace' WHEN {_KIND} < 'a' THEN 'rotate' ELSE '' END AS kind, (turn + 2) % 4 AS target FROM conversations),
m AS (SELECT *, kind = 'move' OR (kind IN ('delete', 'replace', 'rotate') AND turn % 2 = 1) AS moved FROM p),
r AS (SELECT conv_id, turn AS source, CASE WHEN kind IN ('replace', 'rotate') THEN kind ELSE 'original' END AS made, CASE kind WHEN 'rotate' THEN 90 END AS turned, CASE WHEN moved THEN target ELSE turn END AS slot, CASE WHEN moved THEN 1 ELSE 0 END AS rank, turn AS tie, unnest(CASE kind WHEN 'replace' THEN [0, 1] ELSE [0] END) AS part FROM m WHERE kind <> 'delete'
 UNION ALL SELECT conv_id, NULL, 'insert', NULL, target, 2, turn, unnest([0, 1]) FROM p WHERE kind = 'insert')
SELECT conv_id, source, made, part, turned, row_number() OVER (PARTITION BY conv_id ORDER BY slot, rank, tie, part) - 1 AS final FROM r""")
def q36_slot_order(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "conversations").select("conv_id", "turn")
    digit = F.substring(F.md5(F.concat(F.lit("e|"), "conv_id", F.lit("|"), "turn")), 1, 1)
    kind = F.when(digit < "2", "delete").when(digit < "4", "move").when(digit < "6", "insert").when(digit < "8", "replace").when(digit < "a", "rotate")
    also = F.when(kind.isin("delete", "replace", "rotate") & (F.col("turn") % 2 == 1), F.array(kind, F.lit("move"))).otherwise(F.array(kind))
    edits = pages.select("conv_id", F.col("turn").alias("page"), ((F.col("turn") + 2) % 4).alias("target"), F.explode(also).alias("kind"), F.lit(2).alias("count"), F.lit(90).alias("turn")).where("kind IS NOT NULL")
    out = seq.slot_order(pages.withColumnRenamed("turn", "page"), edits, "conv_id", "page")
    return out.select("conv_id", "source", "made", F.col("part").cast("int").alias("part"), F.col("turn").alias("turned"), F.col("final").cast("long").alias("final"))


_TOKEN = "CASE p_partkey % 5 WHEN 0 THEN concat(p_partkey, '-', p_partkey + p_size) WHEN 1 THEN concat(p_partkey, 'b') WHEN 2 THEN concat(p_partkey, '-', greatest(p_partkey - p_size, 0)) WHEN 3 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END"


@query(f"""
WITH t AS (SELECT p_partkey, {_TOKEN} AS token FROM part), k AS (SELECT *, CASE WHEN regexp_full_match(token, '[0-9]+-[0-9]+') THEN 'range' WHEN regexp_full_match(token, '[0-9]+[a-f]') THEN 'suffixed' WHEN regexp_full_match(token, '[0-9]+') THEN 'single' END AS kind FROM t),
v AS (SELECT *, CAST(nullif(regexp_extract(token, '^([0-9]+)', 1), '') AS INTEGER) AS a, CAST(nullif(regexp_extract(token, '-([0-9]+)$', 1), '') AS INTEGER) AS b FROM k),
s AS (SELECT *, CASE WHEN kind = 'range' THEN b ELSE a END AS z FROM v)
SELECT p_partkey, kind, CASE WHEN kind IS NOT NULL AND z >= a AND z - a <= 200 THEN a END AS first, CASE WHEN kind IS NOT NULL AND z >= a AND z - a <= 200 THEN z END AS last FROM s""")
def q41_number_shape(spark: SparkSession, sf: str) -> DataFrame:
    token = F.expr(_TOKEN.replace("VARCHAR", "STRING"))
    read = load(spark, sf, "part").select("p_partkey", token.alias("token"))
    return read.select("p_partkey", scalars.number_type(F.col("token")).alias("kind"), scalars.page_span(F.col("token")).alias("s")).select("p_partkey", "kind", "s.first", "s.last")


@query("""
SELECT p_partkey, CAST(unnest(CASE WHEN p_partkey % 3 = 0 THEN list_filter(range(p_size, p_size + p_partkey % 7 + 1), lambda x: x BETWEEN 1 AND 99)
 WHEN p_partkey % 3 = 1 THEN list_filter([p_size, p_size + 60], lambda x: x BETWEEN 1 AND 99) ELSE [] END) AS INTEGER) AS number FROM part""")
def q42_range_expansion(spark: SparkSession, sf: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    token = F.when(key % 3 == 0, F.concat(F.lit("["), size, F.lit("-"), size + key % 7, F.lit("]"))).when(key % 3 == 1, F.concat(F.lit("["), size, F.lit(", "), size + 60, F.lit("]"))).otherwise("none")
    return load(spark, sf, "part").select("p_partkey", F.explode(scalars.expand_brackets(token)).alias("number"))


_UNITS = """u AS (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS unit, CASE CAST(l_quantity AS INT) % 10 WHEN 0 THEN concat(l_partkey % 3000, ' REPORTS 2d') WHEN 1 THEN concat('REPORTS ', l_suppkey, 'a') WHEN 2 THEN concat('# ', l_partkey % 900, '-', l_partkey % 900 + l_suppkey)
 WHEN 3 THEN concat(l_partkey, ' - ', l_partkey + 5) WHEN 4 THEN concat('**', l_linenumber, '**') WHEN 5 THEN concat('L', l_partkey % 999, ' in the case of ', l_suppkey) WHEN 6 THEN concat('• ', l_suppkey, 'b') WHEN 7 THEN 'no number here' WHEN 8 THEN concat(l_partkey % 500, '¹', chr(10), 'Cite as 12 R ', l_suppkey)
 ELSE concat('12', chr(10), l_linenumber, 'd') END AS text, CAST(l_suppkey * 7 % 800 AS DOUBLE) AS x0, CAST(l_suppkey * 7 % 800 + 190 AS DOUBLE) AS x1, CAST(l_partkey % 1000 AS DOUBLE) AS y0, CAST(l_partkey % 1000 + 20 AS DOUBLE) AS y1,
 CASE l_returnflag WHEN 'R' THEN 'header' WHEN 'A' THEN 'footer' END AS zone FROM lineitem)"""
_READING = """CASE WHEN regexp_matches({0}, '^L?[0-9]{{1,4}}L?$') THEN struct_pack(d := regexp_extract({0}, '[0-9]+'), k := 'single') WHEN regexp_matches({0}, '^[0-9]{{2,4}}[a-fA-F]$') THEN struct_pack(d := {0}, k := 'suffixed')
 WHEN regexp_matches({0}, '^[0-9]{{1,4}}[-–][0-9]{{1,4}}$') AND CAST(regexp_extract({0}, '^[0-9]+') AS INT) >= 1 AND CAST(regexp_extract({0}, '[0-9]+$') AS INT) - CAST(regexp_extract({0}, '^[0-9]+') AS INT) BETWEEN 1 AND 200
 THEN struct_pack(d := concat(CAST(regexp_extract({0}, '^[0-9]+') AS INT), '-', CAST(regexp_extract({0}, '[0-9]+$') AS INT)), k := 'range') END"""


@query(rf"""WITH {_UNITS}, s AS (SELECT *, string_split(text, chr(10)) AS ls FROM u), l AS (SELECT *, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS line FROM s),
c AS (SELECT *, trim(regexp_replace(regexp_replace(raw, '[⁰¹²³⁴-⁹*_`~#]+', '', 'g'), '^[•·\s]+', '')) AS t FROM l), w AS (SELECT *, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS tk, regexp_replace(t, '\s*[-–]\s*', '-') AS joined FROM c),
r AS (SELECT *, CASE WHEN regexp_matches(t, '^[0-9]{{1,4}}\s*[-–]\s*[0-9]{{1,4}}$') AND {_READING.format("joined")} IS NOT NULL THEN [struct_pack(s := 'both', v := {_READING.format("joined")})]
 WHEN len(tk) = 1 THEN [struct_pack(s := 'both', v := {_READING.format("tk[1]")})] ELSE [struct_pack(s := 'left', v := {_READING.format("tk[1]")}), struct_pack(s := 'right', v := {_READING.format("tk[-1]")})] END AS rs FROM w),
e AS (SELECT l_orderkey, unit, line, zone, x0, x1, y0, y1, unnest(rs) AS r FROM r),
g AS (SELECT *, r.s AS side, r.v.d AS detected, r.v.k AS kind, CASE WHEN y1 < 85 THEN 'header' WHEN y0 > 950 THEN 'footer' END AS band, greatest(CASE r.s WHEN 'left' THEN x0 WHEN 'right' THEN 1000 - x1 ELSE least(x0, 1000 - x1) END, 0) / 1000 AS distance FROM e WHERE r.v IS NOT NULL),
k AS (SELECT *, coalesce(zone, band) AS zn, CASE WHEN distance <= 0.25 AND zone IS NOT NULL AND band IS NOT NULL THEN 1.0 WHEN (distance <= 0.25 AND (zone IS NOT NULL OR band IS NOT NULL)) OR (side = 'both' AND zone IS NOT NULL AND band IS NOT NULL) THEN 0.8 ELSE 0.5 END AS score FROM g
 WHERE coalesce(zone, band) IS NOT NULL AND (side = 'both' OR distance <= 0.25))
SELECT l_orderkey, detected, kind, zn AS zone, CAST(score AS DOUBLE) AS score FROM k QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY zn <> 'header', score DESC, distance, line, unit, side, detected) = 1""")
def q102_page_number_candidates(spark: SparkSession, sf: str) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    kind = F.col("l_quantity").cast("int") % 10
    text = F.when(kind == 0, F.concat(p % 3000, F.lit(" REPORTS 2d"))).when(kind == 1, F.concat(F.lit("REPORTS "), s, F.lit("a"))).when(kind == 2, F.concat(F.lit("# "), p % 900, F.lit("-"), p % 900 + s))
    text = text.when(kind == 3, F.concat(p, F.lit(" - "), p + 5)).when(kind == 4, F.concat(F.lit("**"), n, F.lit("**"))).when(kind == 5, F.concat(F.lit("L"), p % 999, F.lit(" in the case of "), s)).when(kind == 6, F.concat(F.lit("• "), s, F.lit("b")))
    text = text.when(kind == 7, "no number here").when(kind == 8, F.concat(p % 500, F.lit("¹\nCite as 12 R "), s)).otherwise(F.concat(F.lit("12\n"), n, F.lit("d")))
    x0, y0 = (s * 7 % 800).cast("double"), (p % 1000).cast("double")
    zone = F.when(F.col("l_returnflag") == "R", "header").when(F.col("l_returnflag") == "A", "footer")
    units = load(spark, sf, "lineitem").select("l_orderkey", (p * 10 + n).alias("unit"), text.alias("text"), x0.alias("x0"), (x0 + 190).alias("x1"), y0.alias("y0"), (y0 + 20).alias("y1"), F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"), zone.alias("zone"))
    return pages.candidates(units, ["l_orderkey"]).where("rank = 1").select("l_orderkey", "detected", F.col("type").alias("kind"), "zone", "score")


@query("""
WITH n AS (SELECT l_orderkey AS k, l_linenumber AS page, min(1000 + CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE 2 * l_linenumber END) AS low, bool_or(l_returnflag = 'R') AS ranged FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL),
b AS (SELECT o_orderkey AS k, 1 + o_orderkey % 3 AS s, 1 + o_orderkey % 3 + o_custkey % 4 AS e FROM orders),
j AS (SELECT b.k, s, e, n.low, CASE WHEN ranged THEN n.low + 1 ELSE n.low END AS high, (SELECT max_by(m.low, m.page) FROM n m WHERE m.k = b.k AND m.page > b.s AND m.page <= b.e) AS later FROM b LEFT JOIN n ON n.k = b.k AND n.page = b.s),
f AS (SELECT *, CASE WHEN e <= s THEN low ELSE high END AS f, CASE WHEN e <= s THEN high ELSE coalesce(later, high) END AS l FROM j)
SELECT k, CASE WHEN l >= f THEN f END AS "first", CASE WHEN l >= f THEN l END AS "last", CASE WHEN low IS NULL THEN 'no_number' WHEN l < f THEN 'backwards' END AS fault FROM f""")
def q118_printed_spans(spark: SparkSession, sf: str) -> DataFrame:
    number = 1000 + F.when(F.col("l_partkey") % 9 == 0, 0).otherwise(2 * F.col("l_linenumber"))
    lines = load(spark, sf, "lineitem").where("l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("page"))
    numbers = lines.agg(F.min(number).alias("low"), F.bool_or(F.col("l_returnflag") == "R").alias("r")).select("k", "page", "low", F.when(F.col("r"), F.col("low") + 1).alias("high"))
    start = 1 + F.col("o_orderkey") % 3
    bounds = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), start.alias("start"), (start + F.col("o_custkey") % 4).alias("end"))
    return seq.printed_spans(bounds, numbers, "k").select("k", "first", "last", "fault")


_SIZE, _OVERLAP = 100, 20


@query(rf"""WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \n\t\r\v\f]+')) AS n FROM documents), w AS (SELECT doc_id, n, unnest(generate_series(0, CAST(greatest(0, ceil((n - {_SIZE}) / {_SIZE - _OVERLAP}.0)) AS BIGINT))) AS w FROM d WHERE n > 0),
b AS (SELECT doc_id, w, w * {_SIZE - _OVERLAP} AS s, least(w * {_SIZE - _OVERLAP} + {_SIZE}, n) AS e FROM w), t AS (SELECT doc_id, w, s, e, unnest(generate_series(s, e - 1)) AS k FROM b),
o AS (SELECT doc_id, k, arg_min(w, row(-least(k - s, e - k - 1), w)) AS owner FROM t GROUP BY 1, 2) SELECT doc_id, CAST(owner AS INTEGER) AS "window", CAST(min(k) AS INTEGER) AS first, CAST(max(k) AS INTEGER) AS last, count(*) AS n FROM o GROUP BY 1, 2""")
def q137_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's words in windows, scored apart (here the word's place in its window) and stitched."""
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \n\t\r\x0B\f]+"), F.lit(0)))
    plan = windows.plan(load(spark, sf, "documents").select("doc_id", n.alias("n")), ["doc_id"], F.col("n"), _SIZE, _OVERLAP)
    scored = plan.select("doc_id", "window", "own_start", "own_end", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("place"))
    return windows.stitched(scored, "place").groupBy("doc_id", "window").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a volume (the parts of a supplier) with two measures and whether they are known as bad."""
    pages = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("volume"), F.col("l_partkey").alias("page")).agg(F.avg("l_quantity").cast("double").alias("ink"), F.avg("l_discount").cast("double").alias("lean"))
    return pages.withColumn("bad", F.when(F.col("page") % 3 == 0, (F.col("ink") > 40).cast("int")))


@query("""WITH p AS (SELECT l_suppkey AS volume, l_partkey AS page, CAST(avg(l_quantity) AS DOUBLE) AS ink, CAST(avg(l_discount) AS DOUBLE) AS lean FROM lineitem GROUP BY 1, 2),
m AS (SELECT volume, page % 2 AS parity, median(ink) AS ink, median(lean) AS lean FROM p GROUP BY 1, 2) SELECT p.volume, page, round(p.ink - m.ink, 6) AS ink_rel, round(p.lean - m.lean, 6) AS lean_rel FROM p JOIN m ON p.volume = m.volume AND page % 2 = parity""")
def q138_relative_measures(spark: SparkSession, sf: str) -> DataFrame:
    got = scoring.relative(_measured(spark, sf), ["volume"], "page", ["ink", "lean"])
    return got.select("volume", "page", F.round("ink_rel", 6).alias("ink_rel"), F.round("lean_rel", 6).alias("lean_rel"))


@query("""WITH p AS (SELECT l_suppkey AS volume, l_partkey AS page, CAST(avg(l_quantity) AS DOUBLE) AS ink FROM lineitem GROUP BY 1, 2), m AS (SELECT volume, page % 2 AS parity, median(ink) AS ink FROM p GROUP BY 1, 2),
r AS (SELECT p.volume, page, p.ink - m.ink AS x, CASE WHEN page % 3 = 0 THEN CAST(p.ink > 40 AS INTEGER) END AS y FROM p JOIN m ON p.volume = m.volume AND page % 2 = parity), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r WHERE y IS NOT NULL)
SELECT volume, page, round(least(1, greatest(0, a + b * x)), 4) AS score FROM r, f""")
def q139_scored_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.relative(_measured(spark, sf), ["volume"], "page", ["ink"])
    model = scoring.fit(rows, ["ink_rel"], "bad", "least squares", ridge=0.0)
    return scoring.score(rows.select("volume", "page", "ink_rel"), model).select("volume", "page", F.round("score", 4).alias("score"))
