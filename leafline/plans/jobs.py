"""Queries of jobs that change state, of claims and ledgers, and their SQL.

A job is a user's events of three days; a type of event is a command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.plans.registry import registry
from leafline.sources.tables import load
from leafline.streaming import jobs, streams

QUERIES, ORACLE_SQL, query = registry()

_COMMANDS = {"signup": "submit", "view": "start", "click": "done", "purchase": "consume", "refund": "decline", "error": "fail"}


def _commands(events: DataFrame) -> DataFrame:
    kind = F.create_map(*(F.lit(v) for pair in _COMMANDS.items() for v in pair))[F.col("event_type")]
    command = F.when(F.col("event_id") % 10 == 0, "lost").when(F.col("event_id") % 10 == 5, "found").otherwise(kind)
    day: Column = F.floor((F.dayofmonth("ts") - 1) / 3)
    return events.select((F.col("user_id") * 100 + day).alias("job"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", command.alias("command"))


_MACHINE = """RECURSIVE c AS (SELECT user_id * 100 + (day(ts) - 1) // 3 AS job, epoch_us(ts) AS tm, event_id, CASE event_id % 10 WHEN 0 THEN 'lost' WHEN 5 THEN 'found' ELSE
 CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'start' WHEN 'click' THEN 'done' WHEN 'purchase' THEN 'consume' WHEN 'refund' THEN 'decline' WHEN 'error' THEN 'fail' END END AS command FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY tm, event_id) AS r FROM c),
s AS (SELECT DISTINCT job, 0::BIGINT AS r, 'pending' AS status, 1 AS attempt, 0 AS deferred, 0::BIGINT AS deadline, 0::BIGINT AS ignored FROM c
 UNION ALL SELECT job, r, CASE WHEN command = 'submit' AND st = 'pending' THEN 'submitted' WHEN command = 'start' AND st = 'submitted' THEN 'in_progress' WHEN command = 'decline' AND st = 'submitted' THEN 'pending'
   WHEN command = 'fail' AND flying THEN CASE WHEN att >= 3 THEN 'failed' ELSE 'pending' END WHEN command IN ('done', 'found') AND flying THEN 'completed' WHEN command = 'lost' AND flying THEN 'expired' WHEN command = 'consume' AND st = 'completed' THEN 'consumed' ELSE st END,
  CASE WHEN command = 'fail' AND flying AND att < 3 THEN att + 1 ELSE att END, CASE WHEN command = 'decline' AND st = 'submitted' THEN deferred + 1 ELSE deferred END,
  CASE WHEN command = 'submit' AND st = 'pending' THEN CASE WHEN dl = 0 THEN tm + 21600000000 ELSE dl END WHEN command = 'start' AND st = 'submitted' THEN tm + 43200000000 WHEN command = 'fail' AND flying AND att < 3 THEN 0 ELSE dl END,
  CASE WHEN (command = 'submit' AND st = 'pending') OR (command IN ('start', 'decline') AND st = 'submitted') OR (command IN ('fail', 'done', 'found', 'lost') AND flying) OR (command = 'consume' AND st = 'completed') THEN ignored ELSE ignored + 1 END
 FROM (SELECT *, st IN ('submitted', 'in_progress') AS flying FROM (SELECT job, r, tm, command, deferred, ignored, CASE WHEN over AND attempt >= 3 THEN 'failed' WHEN over THEN 'pending' ELSE status END AS st, CASE WHEN over AND attempt < 3 THEN attempt + 1 ELSE attempt END AS att, CASE WHEN over AND attempt < 3 THEN 0 ELSE deadline END AS dl
  FROM (SELECT s.job, e.r, e.tm, e.command, status, attempt, deferred, deadline, ignored, deadline > 0 AND deadline < e.tm AND status IN ('pending', 'submitted', 'in_progress') AS over FROM s JOIN e ON e.job = s.job AND e.r = s.r + 1)))),
w AS (SELECT epoch_ms(max(ts)) * 1000 - 3600000000 + 1 AS as_of FROM events),
z AS (SELECT s.*, deadline > 0 AND deadline < as_of AND status IN ('pending', 'submitted', 'in_progress') AS over FROM s, w QUALIFY row_number() OVER (PARTITION BY job ORDER BY r DESC) = 1)"""
_STATES = f"""WITH {_MACHINE} SELECT job, CASE WHEN over AND attempt >= 3 THEN 'failed' WHEN over THEN 'pending' ELSE status END AS status, CASE WHEN over AND attempt < 3 THEN attempt + 1 ELSE attempt END AS attempt,
 deferred, CASE WHEN over AND attempt < 3 THEN 0 ELSE deadline END AS deadline, r AS seen, ignored, 0 AS late FROM z"""


@query(_STATES)
def q112_job_states(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    newest = events.agg(F.unix_millis(F.max("ts").cast("timestamp"))).first()[0] or 0
    return jobs.job_states(_commands(events), newest * 1000 - jobs.HOUR + 1)


@query(_STATES)
def q113_job_stream(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.job_stream(spark, _commands(streams.event_stream(spark, sf)), "1 hour")


@query("SELECT user_id * 7 + event_id % 7 AS result, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 0")
def q114_results_once(spark: SparkSession, sf: str) -> DataFrame:
    # every event comes twice, as a queue that delivers at least once gives them
    stream = streams.event_stream(spark, sf).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    first = streams.run_once(spark, jobs.once(stream, "event_id", "2 hours"), "once", "append")
    return first.groupBy((F.col("user_id") * 7 + F.col("event_id") % 7).alias("result")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'processing' ELSE 'done' END AS status, o_orderdate AS beat, CAST(o_orderkey % 5 AS INTEGER) AS interruptions FROM orders),
s AS (SELECT *, status = 'processing' AND beat < DATE '1997-01-01' AS stale FROM c)
SELECT o_orderkey, CASE WHEN stale AND interruptions >= 3 THEN 'interrupted' WHEN stale THEN 'queued' ELSE status END AS status, interruptions + CAST(stale AS INTEGER) AS interruptions FROM s""")
def q115_stale_claims(spark: SparkSession, sf: str) -> DataFrame:
    claims = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "processing").otherwise("done").alias("status"), "o_orderdate", (F.col("o_orderkey") % 5).cast("int").alias("interruptions"))
    out = jobs.requeued(claims, F.col("status"), F.col("o_orderdate"), F.col("interruptions"), F.lit("1997-01-01").cast("date"), 3)
    return out.select("o_orderkey", F.col("new_status").alias("status"), F.col("new_interruptions").alias("interruptions"))


@query("""SELECT user_id, min(event_id) AS head, count(*) FILTER (event_type = 'error') AS attempts, arg_max(props, row(ts, event_id)) FILTER (event_type = 'error') AS last_error, count(*) FILTER (event_type = 'error') >= 10 AS gives_up FROM events GROUP BY 1""")
def q116_failure_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.failure_ledger(load(spark, sf, "events"), ["user_id"], "event_id", F.col("event_type") == "error", F.col("props"), "ts", 10)


@query("""WITH i AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'checked' ELSE 'ready' END AS status FROM orders),
p AS (SELECT l_orderkey, bool_and(l_returnflag <> 'N') AS done, bool_or(l_returnflag = 'N' AND l_quantity > 40) AS blocks FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN status = 'checked' AND done AND NOT blocks THEN 'ready' WHEN status = 'ready' AND blocks THEN 'checked' ELSE status END AS status FROM i LEFT JOIN p ON l_orderkey = o_orderkey""")
def q117_promoted(spark: SparkSession, sf: str) -> DataFrame:
    items = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "checked").otherwise("ready").alias("status"))
    parts = load(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    open_ = F.col("l_returnflag") == "N"
    out = jobs.promoted(items, parts, ["o_orderkey"], ~open_, open_ & (F.col("l_quantity") > 40), ("checked", "ready"), "status")
    return out.select("o_orderkey", F.col("new_status").alias("status"))
