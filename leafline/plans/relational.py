"""Queries of counts, queues, semi and anti joins, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.operators import relational as rel
from leafline.plans.registry import registry
from leafline.sources.tables import load

QUERIES, ORACLE_SQL, query = registry()


@query("""
SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS total
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name""")
def q1_fk_joins(spark: SparkSession, sf: str) -> DataFrame:
    places = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    spent = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("t"))
    each = load(spark, sf, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    summed = each.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.sum("t").alias("t"))
    return summed.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("r_name", "n_name", "customers", "orders", F.round("t", 2).alias("total"))


GROUPS = [("O", "1-URGENT", "waiting"), ("O", "2-HIGH", "waiting"), ("O", "3-MEDIUM", "queued"), ("O", "4-NOT SPECIFIED", "queued"), ("O", "5-LOW", "queued"), *(("P", p, "in_review") for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")), *(("F", p, "done") for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")), ("X", "-", "failed")]
_VALUES = ", ".join(str(g) for g in GROUPS)


@query(f"""
WITH m(s, p, status_group) AS (VALUES {_VALUES}),
g AS (SELECT DISTINCT status_group FROM m),
c AS (SELECT status_group, count(*) AS n, count(DISTINCT o_custkey) AS n_distinct FROM orders JOIN m ON s = o_orderstatus AND p = o_orderpriority GROUP BY 1)
SELECT g.status_group, coalesce(n, 0) AS n, coalesce(n_distinct, 0) AS n_distinct FROM g LEFT JOIN c USING (status_group)
UNION ALL SELECT 'total', count(*), count(DISTINCT o_custkey) FROM orders""")
def q2_status_groups(spark: SparkSession, sf: str) -> DataFrame:
    members = spark.createDataFrame(GROUPS, "o_orderstatus string, o_orderpriority string, status_group string")
    return rel.grouped_report(load(spark, sf, "orders"), members, ["o_orderstatus", "o_orderpriority"], "status_group", "o_custkey")


@query("""
WITH f AS (SELECT user_id, bool_or(event_type = 'view') AS viewed, bool_or(event_type = 'click') AS clicked, bool_or(event_type = 'purchase' AND value > 100) AS bought, bool_or(event_type = 'refund') AS refunded FROM events GROUP BY 1)
SELECT 'viewed' AS stage, count(*) FILTER (viewed) AS n FROM f UNION ALL SELECT 'clicked', count(*) FILTER (clicked) FROM f
UNION ALL SELECT 'bought', count(*) FILTER (bought) FROM f UNION ALL SELECT 'refunded', count(*) FILTER (refunded) FROM f""")
def q2b_funnel(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return rel.funnel(load(spark, sf, "events"), "user_id", {"viewed": kind == "view", "clicked": kind == "click", "bought": (kind == "purchase") & (F.col("value") > 100), "refunded": kind == "refund"})


@query("SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def q3_left_join_count(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return load(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("lines"))


@query("""
SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def q4_latest_row(spark: SparkSession, sf: str) -> DataFrame:
    last = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.select("user_id", "event_type", "e.event_id", "e.value")


@query("SELECT conv_id, turn, role FROM conversations c WHERE turn = (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id)")
def q4a_live_run(spark: SparkSession, sf: str) -> DataFrame:
    return rel.live_run(load(spark, sf, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role")


@query("""
WITH s AS (SELECT conv_id, arg_max(role, turn) AS last_role, bool_or(role = 'system') AS has_system, count(*) AS total, count(*) FILTER (role = 'user') AS by_user,
 count(*) FILTER (role = 'assistant') AS by_assistant FROM conversations GROUP BY 1)
SELECT conv_id, total, by_user, by_assistant, concat(by_user, ' user, ', by_assistant, ' assistant') AS label FROM s WHERE last_role = 'assistant' AND NOT has_system""")
def q4b_finished_runs(spark: SparkSession, sf: str) -> DataFrame:
    role = F.col("role")
    runs = load(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.bool_or(role == "system").alias("has_system"), F.count("*").alias("total"), F.count_if(role == "user").alias("by_user"), F.count_if(role == "assistant").alias("by_assistant"))
    label = F.concat(F.col("by_user"), F.lit(" user, "), F.col("by_assistant"), F.lit(" assistant"))
    return runs.where("last_role = 'assistant' AND NOT has_system").select("conv_id", "total", "by_user", "by_assistant", label.alias("label"))


@query("""
SELECT source, count(*) AS labelled, count(*) FILTER (quality = 0) AS low, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 0 AND toxic = 0) AS minor
FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def q5_filtered_counts(spark: SparkSession, sf: str) -> DataFrame:
    both = load(spark, sf, "documents").select("doc_id", "source").join(load(spark, sf, "labels"), "doc_id")
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return both.groupBy("source").agg(F.count("*").alias("labelled"), F.count_if(low).alias("low"), F.count_if(toxic).alias("toxic"), F.count_if(low & (F.col("toxic") == 0)).alias("minor"))


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def q6_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", "source").join(load(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("""
SELECT doc_id FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
OR md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def q7_either_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("m"))
    toxic = load(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("t", F.lit(1))
    copies = docs.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m", "n")
    return docs.join(toxic, "doc_id", "left").join(copies, "m", "left").where("t IS NOT NULL OR n IS NOT NULL").select("doc_id")


@query("""
SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'document', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q8_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").join(load(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    docs = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left_anti").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    return orders.unionByName(docs)


@query("""
SELECT event_id, user_id, EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts AND p.ts <= e.ts + INTERVAL 6 HOUR) AS fulfilled,
 user_id * 2 + CASE WHEN value > 100 THEN 1 ELSE 0 END AS sort_key FROM events e WHERE event_type = 'error'""")
def q9_answered_later(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    # the next purchase decides, so a window does what a range join would
    after = Window.partitionBy("user_id").orderBy("ts").rowsBetween(1, Window.unboundedFollowing)
    buy = F.when(F.col("event_type") == "purchase", F.col("ts"))
    seen = events.withColumn("next", F.first(buy, ignorenulls=True).over(after)).where("event_type = 'error'")
    fulfilled = F.coalesce((F.col("next") > F.col("ts")) & (F.col("next") <= F.col("ts") + F.expr("INTERVAL 6 HOURS")), F.lit(False))
    return seen.select("event_id", "user_id", fulfilled.alias("fulfilled"), (F.col("user_id") * 2 + F.when(F.col("value") > 100, 1).otherwise(0)).alias("sort_key"))


@query("""
SELECT event_id, user_id FROM events e WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts
 AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'error' AND r.ts > e.ts AND r.ts < p.ts))""")
def q10_no_rival(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").where("event_type IN ('error', 'purchase')").select("event_id", "user_id", "ts", "event_type")
    order = Window.partitionBy("user_id").orderBy("ts")
    return events.withColumn("next", F.lead("event_type").over(order)).where("event_type = 'error' AND next = 'purchase'").select("event_id", "user_id")


@query("""
WITH i AS (SELECT s_suppkey, s_suppkey * 20 AS lo, s_suppkey * 20 + 30 AS hi FROM supplier)
SELECT s_suppkey, count(*) AS parts, min(p_partkey) AS first_part FROM part JOIN i ON p_partkey BETWEEN lo AND hi GROUP BY 1""")
def q11_point_in_interval(spark: SparkSession, sf: str) -> DataFrame:
    intervals = load(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") * 20).alias("lo"), (F.col("s_suppkey") * 20 + 30).alias("hi"))
    found = rel.point_in_interval(load(spark, sf, "part").select("p_partkey"), intervals, "p_partkey", "lo", "hi", width=64)
    return found.groupBy("s_suppkey").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first_part"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus = 'P' THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderstatus = 'P' THEN 2 ELSE 3 END AS rank
FROM orders ORDER BY rank, o_orderdate, o_orderkey LIMIT 50""")
def q12_claim_rank(spark: SparkSession, sf: str) -> DataFrame:
    old = (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "P")
    rank = F.when(old, 0).when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3)
    return load(spark, sf, "orders").withColumn("rank", rank).orderBy("rank", "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "rank")


@query("""
SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned
FROM orders ORDER BY returned DESC, o_orderkey""")
def q13_count_as_sort_key(spark: SparkSession, sf: str) -> DataFrame:
    returned = load(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    each = load(spark, sf, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("returned"))
    return each.orderBy(F.desc("returned"), "o_orderkey")


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0) AS k FROM events WHERE coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0) < 50")
def q14_json_cast(spark: SparkSession, sf: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))
    return load(spark, sf, "events").select("event_id", k.alias("k")).where("k < 50")


@query("""
SELECT user_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'error') AS has_error, bool_or(event_type NOT IN ('view', 'click')) AS has_outside
FROM events GROUP BY 1, 2 HAVING bool_or(event_type NOT IN ('view', 'click'))""")
def q15_array_exists(spark: SparkSession, sf: str) -> DataFrame:
    days = load(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("types"))
    outside = F.exists("types", lambda t: ~t.isin("view", "click"))
    return days.where(outside).select("user_id", "day", F.exists("types", lambda t: t == "error").alias("has_error"), outside.alias("has_outside"))


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01'
UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 450000 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def q50_owing_arms(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    # one pass over the lines and one join serve all arms
    seen = lines.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    both = orders.join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    old = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    high = (F.col("o_totalprice") > 450000) & ~F.coalesce("returned", F.lit(False))
    return both.where(rel.any_of(F.col("l_orderkey").isNull(), old, high)).select("o_orderkey").distinct()


@query("""
WITH f AS (SELECT d.doc_id, l.doc_id IS NULL AS owed, l.doc_id IS NULL AND n_chars > 500 AS due, l.doc_id IS NOT NULL AS written, l.doc_id IS NOT NULL AND quality = 0 AS stranded FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT count(*) AS total, count(*) FILTER (owed) AS owed, count(*) FILTER (due) AS due, count(*) FILTER (written) AS written, count(*) FILTER (stranded) AS stranded,
 count(*) = count(*) FILTER (owed) + count(*) FILTER (written) AS reconciles FROM f""")
def q51_owed_and_written(spark: SparkSession, sf: str) -> DataFrame:
    both = load(spark, sf, "documents").select("doc_id", "n_chars").join(load(spark, sf, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    written = F.coalesce("seen", F.lit(False))
    counts = both.agg(F.count("*").alias("total"), F.count_if(~written).alias("owed"), F.count_if(~written & (F.col("n_chars") > 500)).alias("due"), F.count_if(written).alias("written"), F.count_if(written & (F.col("quality") == 0)).alias("stranded"))
    return counts.withColumn("reconciles", F.col("total") == F.col("owed") + F.col("written"))


@query("""
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY o_custkey) AS running FROM n)
SELECT o_custkey, n, CAST(running AS BIGINT) AS running FROM r WHERE running <= 500 OR running = n""")
def q52_whole_group_budget(spark: SparkSession, sf: str) -> DataFrame:
    return rel.whole_groups(load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey", 500)


@query("""
WITH g AS (SELECT l_orderkey, count(DISTINCT l_linenumber) = max(l_linenumber) AS covered, bool_and(l_returnflag = 'R') AS all_returned FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(covered, false) AS covered, CASE WHEN l_orderkey IS NULL THEN 'waiting' WHEN all_returned AND covered THEN 'complete' WHEN covered THEN 'captured' ELSE 'in_work' END AS status
FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""")
def q53_coverage_status(spark: SparkSession, sf: str) -> DataFrame:
    covered = F.size(F.collect_set("l_linenumber")) == F.max("l_linenumber")
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(covered.alias("c"), F.every(F.col("l_returnflag") == "R").alias("all_returned"))
    both = load(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.when(F.col("l_orderkey").isNull(), "waiting").when(F.col("all_returned") & F.col("c"), "complete").when(F.col("c"), "captured").otherwise("in_work")
    return both.select("o_orderkey", F.coalesce("c", F.lit(False)).alias("covered"), status.alias("status"))


@query("""
WITH s AS (SELECT user_id, event_id AS opened_by, ts AS lo, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS hi FROM events WHERE event_type = 'signup')
SELECT e.event_id, min(opened_by) AS opened_by FROM events e JOIN s ON s.user_id = e.user_id AND lo < e.ts AND e.ts < hi WHERE event_type = 'error' GROUP BY 1""")
def q54_span_holder(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").where("event_type IN ('signup', 'error')").select("event_id", "user_id", "ts", "event_type")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    opens = F.when(F.col("event_type") == "signup", F.struct("ts", "event_id"))
    before = F.last(opens, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(opens, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    held = events.withColumn("b", before).withColumn("a", after).where("event_type = 'error' AND b.ts < ts AND ts < a.ts")
    return held.select("event_id", F.col("b.event_id").alias("opened_by"))


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'orphan' ELSE 'match' END AS state
FROM (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def q21_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return rel.reconcile(load(spark, sf, "labels"), load(spark, sf, "documents").where("doc_id % 3 = 0"), "doc_id")


@query("""
SELECT l.doc_id, CASE WHEN toxic = 1 AND d.doc_id IS NULL THEN 'keep' WHEN d.doc_id IS NULL THEN 'delete' WHEN quality = 0 AND toxic = 0 AND n_chars > 1000 THEN 'stale'
 WHEN toxic = 1 AND quality = 1 THEN 'reopen' ELSE 'keep' END AS action
FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 1) d USING (doc_id)
UNION ALL SELECT doc_id, 'create' FROM documents WHERE doc_id % 3 <> 1 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def q21b_card_state(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("toxic") == 1, "applied").when(F.col("quality") == 0, "answered").otherwise("open")
    stored = load(spark, sf, "labels").select("doc_id", status.alias("status"), (F.col("quality") == 0).alias("minor"), F.lit("short").alias("readings"))
    fresh = load(spark, sf, "documents").where("doc_id % 3 <> 1").select("doc_id", F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("readings"))
    return rel.card_state(stored, fresh, ["doc_id"])


@query("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS admit_rank FROM orders WHERE o_orderstatus = 'O'),
f AS (SELECT o_orderpriority, 500 - least(480, count(*) FILTER (o_orderstatus = 'P')) AS room FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderpriority, admit_rank FROM p JOIN f USING (o_orderpriority) WHERE admit_rank <= room""")
def q39_capacity(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    # a cap bounds what any group admits, so ranks beyond it are cut in the tasks that send
    flying = orders.groupBy("o_orderpriority").agg((500 - F.least(F.lit(480), F.count_if(F.col("o_orderstatus") == "P"))).alias("room"))
    rank = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    pending = orders.where("o_orderstatus = 'O'").withColumn("admit_rank", rank).where("admit_rank <= 500")
    return pending.join(flying, "o_orderpriority").where("admit_rank <= room").select("o_orderkey", "o_orderpriority", "admit_rank")


@query("""
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND md5(text) NOT IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def q40_id_difference(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("m"))
    once = docs.groupBy("m").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select("doc_id")
    return once.join(load(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN quality ELSE n_chars END AS value, CASE WHEN l.doc_id IS NOT NULL THEN 'manual' ELSE 'model' END AS zone FROM documents d LEFT JOIN labels l USING (doc_id)")
def q37_overlay(spark: SparkSession, sf: str) -> DataFrame:
    human = load(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("human"))
    both = load(spark, sf, "documents").select("doc_id", "n_chars").join(human, "doc_id", "left")
    return both.select("doc_id", F.coalesce("human", "n_chars").alias("value"), F.when(F.col("human").isNotNull(), "manual").otherwise("model").alias("zone"))


@query("""
SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts FROM events GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_ts) = 1""")
def q22_mode_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    counted = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    return counted.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("first_ts"))).alias("event_type"))


@query("""
SELECT l_partkey, l_suppkey, l_orderkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_quantity DESC, l_orderkey, l_linenumber, l_suppkey, l_shipdate) = 1""")
def q38_best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.struct(-F.col("l_discount"), -F.col("l_quantity"), "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    best = load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min_by(F.struct("l_suppkey", "l_orderkey"), rank).alias("b"))
    return best.select("l_partkey", "b.l_suppkey", "b.l_orderkey")


@query("""
WITH last AS (SELECT l_partkey, l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS r FROM lineitem WHERE l_returnflag = 'N')
SELECT p_partkey, l_orderkey AS reused_order, l_quantity AS reused_quantity FROM part LEFT JOIN last ON l_partkey = p_partkey AND r = 1""")
def q55_reusable_results(spark: SparkSession, sf: str) -> DataFrame:
    done = load(spark, sf, "lineitem").where("l_returnflag = 'N'").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_quantity", "l_shipdate", "l_linenumber")
    newest = done.groupBy("p_partkey").agg(F.max_by(F.struct("l_orderkey", "l_quantity"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")).alias("d"))
    return load(spark, sf, "part").select("p_partkey").join(newest, "p_partkey", "left").select("p_partkey", F.col("d.l_orderkey").alias("reused_order"), F.col("d.l_quantity").alias("reused_quantity"))
