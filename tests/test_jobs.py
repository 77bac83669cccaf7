"""Jobs as keyed state: single steps, deadlines, and a stream of several files against the batch fold."""

import datetime

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from leafline.streaming import jobs, streams

H = jobs.HOUR


def after(*commands, as_of=0):
    return next(jobs.folded([(1, t, c) for t, c in commands], as_of))[1:7]


def test_a_job_to_its_end():
    assert after((1 * H, "submit"), (2 * H, "start"), (3 * H, "done"), (4 * H, "consume")) == ("consumed", 1, 0, 14 * H, 4, 0)
    assert after((1 * H, "submit"), (2 * H, "lost")) == ("expired", 1, 0, 7 * H, 2, 0)
    assert after((1 * H, "submit"), (2 * H, "found"), (3 * H, "fail")) == ("completed", 1, 0, 7 * H, 3, 1)


def test_a_decline_spends_no_attempt_and_keeps_the_clock():
    assert after((1 * H, "submit"), (2 * H, "decline"), (3 * H, "submit")) == ("submitted", 1, 1, 7 * H, 3, 0)
    assert after((1 * H, "submit"), (2 * H, "decline"), as_of=7 * H) == ("pending", 1, 1, 7 * H, 2, 0)
    assert after((1 * H, "submit"), (2 * H, "decline"), as_of=7 * H + 1) == ("pending", 2, 1, 0, 2, 0)


def test_attempts_run_out():
    fails = [(t * H, c) for k in range(3) for t, c in ((2 * k + 1, "submit"), (2 * k + 2, "fail"))]
    assert after(*fails)[:2] == ("failed", 3)
    assert after(*fails, (9 * H, "submit"))[:2] == ("failed", 3)
    assert after((1 * H, "submit"), (8 * H, "start")) == ("pending", 2, 0, 0, 2, 1)  # the attempt was written off before


def test_tables_without_rows_jobs_or_order(spark):
    made = spark.createDataFrame([(None, 1, 1, "submit"), (1, 5, 2, "start"), (1, 5, 1, "submit"), (2, 9, 3, None)], "job long, at long, event_id long, command string")
    assert sorted(tuple(r)[:2] for r in jobs.job_states(made, 0).collect()) == [(1, "in_progress"), (2, "pending")]
    assert jobs.job_states(made.limit(0), 0).count() == 0


def test_stream_of_files_gives_the_batch_states(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    kinds = ["submit", "start", "done", "decline", "fail", "consume", "submit", "start", "lost"]
    made = [(k % 7, start + datetime.timedelta(minutes=13 * k, microseconds=k), k, kinds[k * k % 9]) for k in range(600)]
    schema = "job long, ts timestamp, event_id long, command string"
    for part in range(3):
        frame = pd.DataFrame(made[part * 200 : part * 200 + 200], columns=["job", "ts", "event_id", "command"])
        frame["ts"] = frame["ts"].astype("datetime64[us]")
        frame.to_parquet(tmp_path / f"{part}.parquet")
    commands = lambda df: df.withColumn("at", F.unix_micros("ts"))
    newest = spark.createDataFrame(made, schema).agg(F.unix_millis(F.max("ts"))).first()[0]
    want = jobs.job_states(commands(spark.createDataFrame(made, schema)), newest * 1000 - H + 1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = jobs.job_stream(spark, commands(stream), "1 hour")
    by_job = lambda df: sorted(tuple(r) for r in df.select("job", "status", "attempt", "deferred", "deadline", "seen", "ignored").collect())
    assert by_job(got) == by_job(want)
    assert {r[2] for r in by_job(want)} != {1}


def test_a_stream_keeps_its_jobs_by_the_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 8, raising=False)
    start, runs, begin = datetime.datetime(2024, 1, 1), [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **b: runs.append(begin(self, *a, **b)) or runs[-1])
    kinds = ["submit", "start", "done", "decline", "fail", "consume", "submit", "start", "lost", None]
    made = [((None, 2**62 + 1, 2**62 + 2)[k % 200] if k % 200 < 3 else k % 200, start + datetime.timedelta(minutes=k), k if k % 3 else None, kinds[k * k % 7 + k % 3]) for k in range(3000)]
    schema = "job long, ts timestamp, event_id long, command string"
    for part in range(3):
        spark.createDataFrame(made[part * 1000 : part * 1000 + 1000], schema).coalesce(1).write.parquet(str(tmp_path / f"{part}"))
    commands = lambda df: df.withColumn("at", F.unix_micros("ts"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = {r["job"]: tuple(r) for r in jobs.job_stream(spark, commands(stream), "2 days").collect()}
    newest = max(r[1] for r in made)
    as_of = round((newest - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000 - 48 * H + 1
    want = {r["job"]: tuple(r) for r in jobs.job_states(commands(spark.createDataFrame(made, schema)), as_of).collect()}
    nobody = got.pop(None)
    assert got == want
    assert nobody[5] == sum(r[0] is None for r in made)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in runs[0].recentProgress) <= 9


def test_repeats_count_once(spark, tmp_path):
    spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "k long, v long").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v long, ts timestamp").parquet(str(tmp_path / "in"))
    assert sorted(tuple(r) for r in streams.run_once(spark, jobs.once(stream, "k", "1 hour"), "t", "append").select("k", "v").collect()) == [(1, 5), (2, 6)]


def test_stale_claims_and_promotion(spark):
    claims = spark.createDataFrame([(1, "processing", 5, 0), (2, "processing", 5, 3), (3, "processing", 9, 3), (4, "done", 1, 0), (5, None, 1, 0), (6, "processing", None, 0)], "i int, s string, beat int, n int")
    out = jobs.requeued(claims, F.col("s"), F.col("beat"), F.col("n"), F.lit(9), 3)
    assert [tuple(r) for r in out.select("i", "new_status", "new_interruptions").orderBy("i").collect()] == [(1, "queued", 1), (2, "interrupted", 4), (3, "processing", 3), (4, "done", 0), (5, None, 0), (6, "processing", 0)]
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "a"), (6, "x")], "i int, s string")
    parts = spark.createDataFrame([(1, True, False), (2, True, False), (2, None, False), (3, True, True), (4, False, None), (6, True, True)], "i int, done boolean, blocks boolean")
    out = jobs.promoted(items, parts, ["i"], F.col("done"), F.col("blocks"), ("a", "b"), "s")
    assert [tuple(r) for r in out.select("i", "new_status").orderBy("i").collect()] == [(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, "a"), (6, "x")]
