"""Queries of the review pages: probes, updates, reports and lists, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import review
from leafline.operators import sequences as seq
from leafline.plans.registry import registry
from leafline.sources.tables import load

QUERIES, ORACLE_SQL, query = registry()


@query("SELECT concat('out/', doc_id, '.xml') AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q58_orphan_objects(spark: SparkSession, sf: str) -> DataFrame:
    path = F.format_string("out/%d.xml", "doc_id").alias("path")
    return review.orphans(load(spark, sf, "documents").select(path), load(spark, sf, "labels").select(path), "path")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN concat('checked ', quality) ELSE source END AS source, lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def q59_bulk_update(spark: SparkSession, sf: str) -> DataFrame:
    fresh = load(spark, sf, "labels").select("doc_id", F.concat(F.lit("checked "), F.col("quality")).alias("source"))
    return review.update_by_key(load(spark, sf, "documents").select("doc_id", "source", "lang"), fresh, ["doc_id"], ["source"])


@query("""SELECT d.doc_id, CASE WHEN quality IS NOT NULL AND lang = 'en' THEN 'english' ELSE lang END AS lang, coalesce(quality IS NOT NULL AND lang = 'en', false) AS swapped
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q60_compare_and_swap(spark: SparkSession, sf: str) -> DataFrame:
    updates = load(spark, sf, "labels").select("doc_id", F.lit("en").alias("expected"), F.lit("english").alias("value"))
    return review.swap_if_unchanged(load(spark, sf, "documents").select("doc_id", "lang"), updates, ["doc_id"], "lang")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type LIKE 'p%' GROUP BY 1")
def q61_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").where(F.col("event_type").startswith("p")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (list_contains(json_keys(props), 'k')) AS with_k, count(*) FILTER (list_contains(json_keys(props), 'left_over')) AS with_left_over,
 count(*) FILTER (NOT list_contains(json_keys(props), 'left_over')) AS without FROM events""")
def q62_json_key_exists(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda key: F.coalesce(F.array_contains(F.json_object_keys("props"), key), F.lit(False))
    return load(spark, sf, "events").agg(F.count_if(has("k")).alias("with_k"), F.count_if(has("left_over")).alias("with_left_over"), F.count_if(~has("left_over")).alias("without"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_linenumber + 1 >= 5 THEN 'failed' WHEN l_returnflag = 'A' THEN 'queued' ELSE 'done' END AS status,
 CASE WHEN l_returnflag = 'A' THEN least(l_linenumber + 1, 5) ELSE l_linenumber END AS attempts FROM lineitem""")
def q63_conditional_update(spark: SparkSession, sf: str) -> DataFrame:
    status, attempts = review.requeued(F.when(F.col("l_returnflag") == "A", "running").otherwise("done"), F.col("l_linenumber"), 5)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", status.alias("status"), attempts.alias("attempts"))


@query("SELECT l_returnflag, count(DISTINCT concat(l_suppkey, ':', l_partkey)) AS volumes FROM lineitem GROUP BY 1")
def q64_concatenated_key(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct(F.concat_ws(":", "l_suppkey", "l_partkey")).alias("volumes"))


@query("SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS stored_bytes, CAST(max(strlen(text)) AS BIGINT) AS largest FROM documents GROUP BY 1")
def q65_storage_size(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    return load(spark, sf, "documents").groupBy("lang").agg(F.sum(size).alias("stored_bytes"), F.max(size).alias("largest"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 250000")
def q66_request_filters(spark: SparkSession, sf: str) -> DataFrame:
    asked = {"status": "O", "priority": ["1-URGENT", "2-HIGH"], "least": 250000, "most": ""}
    allowed = {"status": "o_orderstatus =", "priority": "o_orderpriority in", "least": "o_totalprice >=", "most": "o_totalprice <="}
    out = load(spark, sf, "orders")
    for condition in review.request_filters(asked, allowed):
        out = out.where(condition)
    return out.select("o_orderkey")


@query("""SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem a WHERE l_returnflag = 'N'
 AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_linenumber = a.l_linenumber AND b.l_returnflag = 'R')""")
def q67_multi_key_semi(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    keys = ["l_partkey", "l_suppkey", "l_linenumber"]
    return lines.where("l_returnflag = 'N'").join(lines.where("l_returnflag = 'R'").select(*keys), keys, "left_semi").select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) OR p_partkey + 1 IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def q68_adjacent_key_semi(spark: SparkSession, sf: str) -> DataFrame:
    full = load(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return review.beside(load(spark, sf, "part").select("p_partkey"), full, [], "p_partkey", (0, 1))


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM events e WHERE event_type = 'refund' AND e.user_id = o.o_custkey % 50 AND e.event_id % 1000 BETWEEN o_orderkey % 1000 - 1 AND o_orderkey % 1000 + 1)""")
def q69_neighbourhood_probe(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 50).alias("user_id"), (F.col("o_orderkey") % 1000).alias("at"))
    marks = load(spark, sf, "events").where("event_type = 'refund'").select("user_id", (F.col("event_id") % 1000).alias("at"))
    return review.beside(orders, marks, ["user_id"], "at", (-1, 0, 1)).select("o_orderkey", "o_custkey")


@query("""WITH s AS (SELECT o_custkey, min(o_orderdate) + INTERVAL 5 YEAR AS stamp FROM orders GROUP BY 1)
SELECT o_custkey FROM s WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = s.o_custkey AND o.o_orderdate > stamp)""")
def q70_newer_than_stamp(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderdate")
    stamps = orders.groupBy("o_custkey").agg((F.min("o_orderdate") + F.expr("INTERVAL 5 YEARS")).alias("stamp"))
    return review.newer_than(stamps, orders, ["o_custkey"], "o_orderdate", "stamp").select("o_custkey")


@query("""WITH a AS (SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN '' ELSE l_returnflag END AS source FROM lineitem), b AS (SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN '' ELSE l_linestatus END AS source FROM lineitem)
SELECT a.l_orderkey, count(*) AS n FROM a JOIN b ON a.l_orderkey = b.l_orderkey AND (a.source = '' OR b.source = '' OR a.source = b.source) GROUP BY 1""")
def q71_wildcard_join(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem")
    a = lines.select("l_orderkey", F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_returnflag")).alias("source"))
    b = lines.select("l_orderkey", F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("l_linestatus")).alias("source"))
    return review.wildcard_join(a, b, ["l_orderkey"], "source").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE role <> 'system' AND strlen(text) > 0)
SELECT conv_id, turn, place, place IS NOT NULL AS placed FROM conversations LEFT JOIN m USING (conv_id, turn)""")
def q72_rehomed_rows(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    turns = load(spark, sf, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    kept = turns.where("role <> 'system' AND octet_length(text) > 0").select("conv_id", "turn", (F.row_number().over(order) - 1).cast("long").alias("place"))
    return review.rehome(turns.select("conv_id", "turn"), kept, ["conv_id", "turn"], "place")


@query("""WITH k AS (SELECT user_id, ts AS before, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase'))
SELECT event_id, before, after FROM events e JOIN k ON k.user_id = e.user_id AND before < e.ts AND e.ts < after WHERE event_type = 'refund' AND after - before <= INTERVAL 48 HOUR""")
def q73_between_neighbouring_keys(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    found = review.between_keys(events.where("event_type = 'refund'").select("event_id", "user_id", "ts"), events.where("event_type = 'purchase'"), ["user_id"], "ts")
    return found.where(F.col("after") - F.col("before") <= F.expr("INTERVAL 48 HOURS")).select("event_id", "before", "after")


@query("""SELECT event_id, least(ts + INTERVAL 8 HOUR, coalesce((SELECT min(ts) FROM events n WHERE n.user_id = e.user_id AND n.event_type = 'error' AND n.ts > e.ts), ts + INTERVAL 8 HOUR)) AS clipped
FROM events e WHERE event_type = 'view'""")
def q74_clip_at_next_key(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    spans = events.where("event_type = 'view'").select("event_id", "user_id", "ts", (F.col("ts") + F.expr("INTERVAL 8 HOURS")).alias("until"))
    return review.clip_at_next(spans, events.where("event_type = 'error'"), ["user_id"], "ts", "until", "ts").select("event_id", "clipped")


@query("SELECT l_orderkey, string_agg(concat(l_linenumber, ':', l_partkey, ':', l_returnflag), ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS lines, count(*) AS n FROM lineitem GROUP BY 1")
def q75_one_to_many(spark: SparkSession, sf: str) -> DataFrame:
    lines = review.nested(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), ["l_orderkey"], ["l_linenumber", "l_partkey"])
    listed = F.transform("rows", lambda r: F.concat_ws(":", r["l_linenumber"], r["l_partkey"], r["l_returnflag"]))
    return lines.select("l_orderkey", F.array_join(listed, ",").alias("lines"), F.size("rows").cast("long").alias("n"))


@query("""WITH a AS (SELECT doc_id, quality AS value FROM labels WHERE quality = 1), b AS (SELECT doc_id, 10 + toxic AS value FROM labels), c AS (SELECT doc_id, 100 AS value FROM documents WHERE lang = 'en')
SELECT d.doc_id, coalesce(a.value, b.value, c.value) AS value, CASE WHEN a.doc_id IS NOT NULL THEN 'first' WHEN b.doc_id IS NOT NULL THEN 'second' WHEN c.doc_id IS NOT NULL THEN 'third' END AS source_name
FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)""")
def q76_fallback_sources(spark: SparkSession, sf: str) -> DataFrame:
    labels, docs = load(spark, sf, "labels"), load(spark, sf, "documents")
    sources = [("first", labels.where("quality = 1").select("doc_id", F.col("quality").alias("value"))), ("second", labels.select("doc_id", (F.col("toxic") + 10).alias("value"))), ("third", docs.where("lang = 'en'").select("doc_id", F.lit(100).alias("value")))]
    return review.first_known(docs.select("doc_id"), "doc_id", "value", sources)


@query("""SELECT 'languages' AS section, lang AS name, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'statuses', o_orderstatus, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*) FROM labels GROUP BY 2""")
def q77_combined_report(spark: SparkSession, sf: str) -> DataFrame:
    return review.report({"languages": (load(spark, sf, "documents"), "lang"), "statuses": (load(spark, sf, "orders"), "o_orderstatus"), "events": (load(spark, sf, "events"), "event_type"), "quality": (load(spark, sf, "labels"), "quality")})


@query("SELECT user_id, max(event_id) AS newest FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY newest DESC")
def q78_distinct_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").where("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("newest")).orderBy(F.desc("newest"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(concat(n, ' ', event_type), ', ' ORDER BY event_type) AS label FROM c GROUP BY 1")
def q79_status_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return review.phrase(load(spark, sf, "events"), ["user_id"], "event_type")


@query("""WITH r AS (SELECT *, CAST(event_id // 100 AS BIGINT) AS run FROM events), m AS (SELECT user_id, max(run) AS run FROM r GROUP BY 1)
SELECT user_id, run, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS open, count(*) FILTER (event_type = 'error') AS failed,
 arg_min(props, event_id) FILTER (event_type = 'error') AS first_error FROM r JOIN m USING (user_id, run) GROUP BY ALL""")
def q80_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select("event_id", "user_id", "event_type", "props", F.floor(F.col("event_id") / 100).alias("run"))
    kind = F.col("event_type")
    return review.run_summary(events, ["user_id"], "run", "event_id", kind == "purchase", kind == "error", F.col("props"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber AS s, CASE WHEN l_returnflag <> 'A' THEN l_linenumber + CAST(l_quantity AS INT) % 3 END AS e FROM lineitem),
h AS (SELECT DISTINCT l_orderkey, unnest(generate_series(s, e)) AS page FROM r WHERE e IS NOT NULL), x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN 2 END AS first, 3 + o_orderkey % 4 AS last FROM orders)
SELECT o_orderkey, coalesce(count(page) FILTER (page BETWEEN first AND last) = max(last) - max(first) + 1, false) AS covered FROM x LEFT JOIN h ON l_orderkey = o_orderkey GROUP BY 1""")
def q81_interval_coverage(spark: SparkSession, sf: str) -> DataFrame:
    end = F.when(F.col("l_returnflag") != "A", F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3)
    ranges = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("start"), end.alias("end"))
    expected = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 > 0, 2).alias("first"), (F.col("o_orderkey") % 4 + 3).alias("last"))
    return review.covered(expected, ranges, "o_orderkey")


@query("""WITH g AS (SELECT l_orderkey, bool_and(l_returnflag = 'R') AS approved, count(*) AS parts, count(DISTINCT l_linenumber) = max(l_linenumber) AS whole FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey, l_orderkey, approved, o_totalprice > 250000 AS assigned, CASE WHEN o_orderkey % 3 = 0 THEN whole WHEN o_orderkey % 3 = 1 THEN parts >= 3 ELSE false END AS uploaded FROM orders LEFT JOIN g ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN l_orderkey IS NULL AND assigned THEN 'assigned' WHEN l_orderkey IS NULL THEN 'waiting' WHEN uploaded AND approved THEN 'complete' WHEN uploaded THEN 'captured' ELSE 'in_work' END AS status FROM b""")
def q82_derived_status(spark: SparkSession, sf: str) -> DataFrame:
    parts = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.every(F.col("l_returnflag") == "R").alias("approved"), F.count("*").alias("parts"), (F.size(F.collect_set("l_linenumber")) == F.max("l_linenumber")).alias("whole"))
    both = load(spark, sf, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    # known page coverage decides, else the number of parts, else nothing does
    uploaded = F.when(F.col("o_orderkey") % 3 == 0, F.col("whole")).when(F.col("o_orderkey") % 3 == 1, F.col("parts") >= 3).otherwise(False)
    none = F.col("l_orderkey").isNull()
    status = F.when(none & (F.col("o_totalprice") > 250000), "assigned").when(none, "waiting").when(uploaded & F.col("approved"), "complete").when(uploaded, "captured").otherwise("in_work")
    return both.select("o_orderkey", status.alias("status"))


@query("SELECT lang, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND lang IS NOT NULL GROUP BY 1")
def q83_group_choices(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source").where("lang IS NOT NULL").join(load(spark, sf, "labels"), "doc_id", "left_semi")
    names = F.array_sort(F.collect_set(F.struct(F.lower("source").alias("key"), "source")))
    return docs.groupBy("lang").agg(F.array_join(F.transform(names, lambda s: s["source"]), "|").alias("sources"))


@query("WITH l AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS had, max(l_linenumber) AS most FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_filter(generate_series(1, most + 2), lambda x: NOT list_contains(had, x)), ',') AS missing FROM l")
def q85_holes(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("had"), F.sequence(F.lit(1), F.max("l_linenumber") + 2).alias("named"))
    return lines.select("l_orderkey", F.array_join(review.holes(lines, "named", "had"), ",").alias("missing"))


@query("SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters, count(DISTINCT lang) AS languages, count(*) FILTER (quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def q86_document_totals(spark: SparkSession, sf: str) -> DataFrame:
    both = load(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(load(spark, sf, "labels"), "doc_id", "left")
    return both.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"), F.count_distinct("lang").alias("languages"), F.count_if(F.col("quality") == 1).alias("good"))


@query("WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS label FROM pages) SELECT label, count(*) AS n, count(DISTINCT page_id) AS pages FROM t GROUP BY 1")
def q87_span_labels(spark: SparkSession, sf: str) -> DataFrame:
    tags = load(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)).alias("label"))
    # a page's labels are counted first, so neither the spans nor a set of pages are shuffled
    each = tags.groupBy("page_id", "label").agg(F.count("*").alias("n"))
    return each.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))


_LINES = "l AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'N') AS flagged FROM lineitem GROUP BY ALL)"


def _order_lines(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(F.col("l_returnflag") == "N").alias("flagged"))


@query(f"""WITH {_LINES}, g AS (SELECT l_orderkey, max(l_linenumber) FILTER (NOT flagged) AS last, max(l_linenumber) AS e, min(l_linenumber) AS f FROM l GROUP BY 1)
SELECT l_orderkey, coalesce(last + 1, f) AS "start", e AS "end", e - coalesce(last + 1, f) + 1 AS n FROM g WHERE coalesce(last + 1, f) <= e""")
def q88_trailing_gap(spark: SparkSession, sf: str) -> DataFrame:
    return seq.trailing_gap(_order_lines(spark, sf), ["l_orderkey"], "l_linenumber", ~F.col("flagged"))


_OVERLAP = """b AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS k, min(l_partkey % 100) AS a, min(l_partkey % 100 + l_quantity) AS z FROM lineitem GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, l_partkey) AS r FROM b),
g AS (SELECT l_orderkey, l_partkey, r, z AS reach, 0 AS col FROM o WHERE r = 1
 UNION ALL SELECT o.l_orderkey, o.l_partkey, o.r, CASE WHEN least(o.z, reach) - o.a > (o.z - o.a) * 0.5 THEN greatest(reach, o.z) ELSE o.z END, CASE WHEN least(o.z, reach) - o.a > (o.z - o.a) * 0.5 THEN col ELSE col + 1 END
 FROM g JOIN o ON o.l_orderkey = g.l_orderkey AND o.r = g.r + 1)"""


@query(f'WITH RECURSIVE {_OVERLAP} SELECT l_orderkey, l_partkey, col AS "column" FROM g')
def q89_columns_by_overlap(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("l_partkey") % 100
    boxes = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min(at).alias("x0"), F.min(at + F.col("l_quantity")).alias("x1"))
    return seq.overlap_groups(boxes, ["l_orderkey"], "x0", "x1", "l_partkey")


@query(f"""WITH {_LINES}, f AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM l WHERE flagged)
SELECT l_orderkey, min(l_linenumber) AS "start", max(l_linenumber) AS "end", count(*) AS n FROM f GROUP BY l_orderkey, run""")
def q90_flagged_runs(spark: SparkSession, sf: str) -> DataFrame:
    return seq.flagged_runs(_order_lines(spark, sf), ["l_orderkey"], "l_linenumber", F.col("flagged"))


@query("""WITH n AS (SELECT user_id, event_id, 1 + CAST(floor(value) AS INT) % 9 AS number FROM events), b AS (SELECT *, lag(number) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM n)
SELECT event_id, number, CAST(count(*) FILTER (number <= least(last, 3)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS series FROM b""")
def q91_sequence_restarts(spark: SparkSession, sf: str) -> DataFrame:
    numbers = load(spark, sf, "events").select("user_id", "event_id", (F.floor("value").cast("int") % 9 + 1).alias("number"))
    return seq.restarts(numbers, ["user_id"], ["event_id"], "number").select("event_id", "number", "series")


@query("""WITH RECURSIVE n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey) AS r, l_linenumber AS number FROM lineitem),
s AS (SELECT l_orderkey, 0 AS r, 0 AS last, CAST([] AS INTEGER[]) AS labels FROM n GROUP BY 1
 UNION ALL SELECT n.l_orderkey, CAST(n.r AS INT), CASE WHEN number > last AND number <= last + 3 THEN number ELSE last END, CASE WHEN number > last AND number <= last + 3 THEN list_append(labels, number) ELSE labels END FROM s JOIN n ON n.l_orderkey = s.l_orderkey AND n.r = s.r + 1)
SELECT l_orderkey, array_to_string(arg_max(labels, r), ',') AS labels FROM s GROUP BY 1""")
def q92_plausible_labels(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    return seq.accepted_labels(lines, ["l_orderkey"], ["l_partkey", "l_linenumber", "l_suppkey"], "l_linenumber").select("l_orderkey", F.array_join("labels", ",").alias("labels"))


@query("SELECT event_id, value FROM events WHERE event_type = 'error' AND value >= 20 ORDER BY value DESC, event_id")
def q94_worst_first(spark: SparkSession, sf: str) -> DataFrame:
    return review.worst_first(load(spark, sf, "events").where("event_type = 'error'").select("event_id", "value"), "value", 20.0, "event_id")


@query("""(SELECT 'newest' AS list, o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50) UNION ALL (SELECT 'volume', o_orderkey FROM orders WHERE o_custkey <= 40 ORDER BY o_custkey, o_totalprice, o_orderkey LIMIT 25 OFFSET 25)""")
def q95_pages_of_a_list(spark: SparkSession, sf: str) -> DataFrame:
    orders, out = load(spark, sf, "orders"), None
    for name, params, rows, page in (("newest", {}, orders, 3), ("volume", {"volume": 40}, orders.where("o_custkey <= 40"), 2)):
        order = review.listing_order(params, "o_orderkey", ["o_totalprice"], ["o_custkey"], "o_orderdate")
        one = review.page_of(rows, order, page, 25).select(F.lit(name).alias("list"), "o_orderkey")
        out = one if out is None else out.unionByName(one)
    return out


_HARD = ("error", "refund", "purchase", "signup")


@query("SELECT user_id, CASE min(CASE event_type WHEN 'error' THEN 0 WHEN 'refund' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 END) WHEN 0 THEN 'error' WHEN 1 THEN 'refund' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' END AS hardest FROM events WHERE event_id % 7 < 2 GROUP BY 1")
def q96_hardest_type(spark: SparkSession, sf: str) -> DataFrame:
    kinds = load(spark, sf, "events").where("event_id % 7 < 2").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    return kinds.select("user_id", review.hardest(F.col("types"), _HARD).alias("hardest"))


@query("SELECT doc_id, 'computed' AS maker, n_chars AS value FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'human', quality FROM labels")
def q97_standing_rows(spark: SparkSession, sf: str) -> DataFrame:
    computed = load(spark, sf, "documents").select("doc_id", F.lit("computed").alias("maker"), F.col("n_chars").cast("long").alias("value"))
    return review.standing(computed, load(spark, sf, "labels").select("doc_id", F.lit("human").alias("maker"), F.col("quality").cast("long").alias("value")), ["doc_id"])


@query(r"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS words FROM conversations)
SELECT a.conv_id, a.turn, CAST(len(list_intersect(a.words, b.words)) AS INTEGER) AS shared FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def q98_shared_words(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))
    turns = load(spark, sf, "conversations").select("conv_id", "turn", words.alias("words"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_intersect("words", "next")).alias("shared"))


@query("""WITH a AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A')
SELECT l_suppkey, l_linenumber, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT l_suppkey, l_linenumber, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def q99_set_xor(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag")
    return review.set_xor(lines.where("l_returnflag = 'R'").drop("l_returnflag"), lines.where("l_returnflag = 'A'").drop("l_returnflag"))


@query("""SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS elapsed_ms, count(*) FILTER (ts + INTERVAL 3 DAY < TIMESTAMP '2024-01-20 00:00:00') AS overdue FROM events GROUP BY 1""")
def q100_elapsed_and_overdue(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    elapsed = F.expr("timestampdiff(MILLISECOND, min(ts), max(ts))")
    return load(spark, sf, "events").groupBy("user_id").agg(elapsed.alias("elapsed_ms"), F.count_if(F.col("ts") + F.expr("INTERVAL 3 DAYS") < as_of).alias("overdue"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), '|') AS kinds FROM events GROUP BY 1")
def q101_sorted_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("kinds"))
