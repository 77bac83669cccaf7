"""Jobs as keyed state: their commands folded in order, in batch or as a stream with deadlines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafline.streaming.streams import run_once, with_rocksdb

HOUR = 3_600_000_000  # times are whole microseconds
QUEUE_WAIT, RUN_TIME, MOST_ATTEMPTS = 6 * HOUR, 12 * HOUR, 3
IN_FLIGHT = ("submitted", "in_progress")
BUCKETS = 2048  # of a stream's jobs; state in a checkpoint is keyed by it
STATE = "jobs array<struct<job long, status string, attempt int, deferred int, deadline long, last long, seen long, ignored long, late long>>"
RESULT = "job long, status string, attempt int, deferred int, deadline long, seen long, ignored long, late long, version long"
_NAMES = [f.split()[0] for f in RESULT.split(", ")]
_SHOWN = attrgetter(*_NAMES[1:-1])
_FIELDS = attrgetter("status", "attempt", "deferred", "deadline", "last", "seen", "ignored", "late")


@dataclass
class Job:
    """One job; ``deadline`` is 0 while no clock runs, ``last`` the time of its newest command."""

    status: str = "pending"
    attempt: int = 1
    deferred: int = 0
    deadline: int = 0
    last: int = 0
    seen: int = 0
    ignored: int = 0
    late: int = 0

    def retry(self) -> None:
        """Another attempt, with a clock of its own, or the end of the job."""
        if self.attempt >= MOST_ATTEMPTS:
            self.status = "failed"
        else:
            self.status, self.attempt, self.deadline = "pending", self.attempt + 1, 0

    def wait(self, now: int) -> bool:
        """Writes an attempt off whose deadline lies before ``now``."""
        over = 0 < self.deadline < now and self.status in ("pending", *IN_FLIGHT)
        if over:
            self.retry()
        return over

    def apply(self, now: int, command: str) -> None:
        """One command.  Those that do not fit the status are counted and change nothing.

        The first submit of an attempt starts its clock and a decline lets it run on, as only
        the answer of a full queue; the start of the work replaces it."""
        self.seen += 1
        self.late += now < self.last
        self.last = max(self.last, now)
        self.wait(now)
        flying = self.status in IN_FLIGHT
        if command == "submit" and self.status == "pending":
            self.status, self.deadline = "submitted", self.deadline or now + QUEUE_WAIT
        elif command == "start" and self.status == "submitted":
            self.status, self.deadline = "in_progress", now + RUN_TIME
        elif command == "decline" and self.status == "submitted":
            self.status, self.deferred = "pending", self.deferred + 1
        elif command == "fail" and flying:
            self.retry()
        elif command in ("done", "found") and flying:
            self.status = "completed"
        elif command == "lost" and flying:
            self.status = "expired"
        elif command == "consume" and self.status == "completed":
            self.status = "consumed"
        else:
            self.ignored += 1


def folded(rows: Iterable[tuple[int, int, str]], as_of: int) -> Iterator[tuple]:
    """``(job, at, command)`` in the order of jobs and times; one result a job, holding one at a time."""
    job, state = None, Job()
    for key, at, command in rows:
        if job is not None and key != job:
            yield _row(job, state, as_of)
        if key != job:
            job, state = key, Job()
        state.apply(at, command)
    if job is not None:
        yield _row(job, state, as_of)


def _row(job: int, state: Job, as_of: int) -> tuple:
    state.wait(as_of)
    return job, state.status, state.attempt, state.deferred, state.deadline, state.seen, state.ignored, state.late, 0


def job_states(commands: DataFrame, as_of: int) -> DataFrame:
    """The state of each ``job`` at ``as_of``, from columns ``job``, ``at``, ``event_id`` and ``command``.

    One shuffle by job and a sort; a task reads its rows in Arrow batches and holds one job's
    state, so a job with many commands needs no more memory than another.  Ties in time go by
    ``event_id``; rows without a job are left out, an empty table has no states."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in zip(b["job"], b["at"], b["command"], strict=True))
        part: list[tuple] = []
        for row in folded(rows, as_of):
            part.append(row)
            if len(part) == 10_000:
                yield pd.DataFrame(part, columns=_NAMES)
                part = []
        yield pd.DataFrame(part, columns=_NAMES)

    ordered = commands.where("job IS NOT NULL").repartition("job").sortWithinPartitions("job", "at", "event_id")
    return ordered.select("job", "at", "command").mapInPandas(fold, RESULT).drop("version")


def folded_batch(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    """The same fold over a stream, one call for all jobs of a bucket.  A micro-batch's commands
    are put in order; a job's commands that are older than those of batches before count as late.
    A timeout at a bucket's first deadline writes off jobs of which nothing more is heard."""
    jobs = {job: Job(*fields) for job, *fields in held.get[0]} if held.exists else {}
    changed = set()
    if not held.hasTimedOut:
        parts = [tuple(f[c].to_numpy() for c in ("job", "at", "event_id", "command")) for f in frames]
        names, at, ids, commands = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((ids, at))
        for job, now, command in zip(names[order].tolist(), at[order].tolist(), commands[order], strict=True):
            if job not in jobs:
                jobs[job] = Job()
            jobs[job].apply(int(now), command)
            changed.add(job)
    as_of = held.getCurrentWatermarkMs() * 1000 + 1
    changed.update([job for job, state in jobs.items() if state.wait(as_of)])
    held.update(([(job, *_FIELDS(state)) for job, state in jobs.items()],))
    clocks = [state.deadline for state in jobs.values() if state.deadline and state.status in ("pending", *IN_FLIGHT)]
    if clocks:
        # a timeout comes once the watermark is past it, a deadline is over once the watermark reaches it
        held.setTimeoutTimestamp(max(-(-min(clocks) // 1000) - 1, 1))
    # a write-off after the newest command ranks above that command
    rows = [(None if key[0] < 0 else job, *_SHOWN(s), s.seen * 10 + s.attempt + 5 * (s.status == "failed")) for job in changed for s in (jobs[job],)]
    yield pd.DataFrame(rows, columns=_NAMES)


def job_stream(spark: SparkSession, commands: DataFrame, late: str) -> DataFrame:
    """``job_states`` of a stream, as of its watermark: ``late`` behind the newest ``ts``.

    Commands older than the watermark are dropped, as no one waits for them any more.  The state
    is keyed by ``BUCKETS`` buckets of jobs, as a call of Python and its exchange with the state
    store cost far more than a job's fold; a bucket's states are read and written as one.
    Commands without a job are one job, in a bucket of its own."""
    bucket = F.when(F.col("job").isNull(), -1).otherwise(F.pmod(F.xxhash64("job"), F.lit(BUCKETS))).alias("bucket")
    with with_rocksdb(spark):
        read = commands.withWatermark("ts", late).select(bucket, F.coalesce("job", F.lit(0)).alias("job"), "ts", "at", F.coalesce("event_id", F.lit(2**63 - 1)).alias("event_id"), "command")
        stream = read.groupBy("bucket").applyInPandasWithState(folded_batch, RESULT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
        rows = run_once(spark, stream, "jobs", "update")
    fields = [c for c in rows.columns if c not in ("job", "version", "epoch")]
    newest = rows.groupBy("job").agg(F.max_by(F.struct(*fields), "version").alias("s"))
    return newest.select("job", *(F.col(f"s.{c}") for c in fields))


def once(events: DataFrame, key: str, late: str) -> DataFrame:
    """A stream in which every key counts once: repeats within ``late`` of the first are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def requeued(claims: DataFrame, status: Column, heartbeat: Column, interruptions: Column, stale_before: Column, most: int) -> DataFrame:
    """Claims whose heartbeat is older than ``stale_before`` go back to the queue; the ones that
    were interrupted ``most`` times before are flagged.  Adds ``new_status``, ``new_interruptions``."""
    stale = F.coalesce((status == "processing") & (heartbeat < stale_before), F.lit(False))
    after = F.when(stale & (interruptions >= most), "interrupted").when(stale, "queued").otherwise(status)
    return claims.select("*", after.alias("new_status"), (interruptions + stale.cast("int")).alias("new_interruptions"))


def failure_ledger(rows: DataFrame, run: list[str], shard: str, failed: Column, error: Column, at: str, most: int) -> DataFrame:
    """Failures of each run, kept on its first shard: ``attempts``, ``last_error`` and whether to give up."""
    last = F.max_by(F.when(failed, error), F.when(failed, F.struct(at, shard)))
    ledger = rows.groupBy(*run).agg(F.min(shard).alias("head"), F.count_if(failed).alias("attempts"), last.alias("last_error"))
    return ledger.withColumn("gives_up", F.col("attempts") >= most)


def promoted(items: DataFrame, parts: DataFrame, on: list[str], done: Column, blocks: Column, states: tuple[str, str], status: str) -> DataFrame:
    """Items in the first of two ``states`` move to the second once they have parts and all are done;
    items in the second go back while a part of theirs blocks.  Adds ``new_status``."""
    waiting, ready = states
    seen = parts.groupBy(*on).agg(F.bool_and(F.coalesce(done, F.lit(False))).alias("_done"), F.bool_or(F.coalesce(blocks, F.lit(False))).alias("_blocks"))
    moved = F.when((F.col(status) == waiting) & F.col("_done") & ~F.col("_blocks"), ready).when((F.col(status) == ready) & F.col("_blocks"), waiting).otherwise(F.col(status))
    return items.join(seen, on, "left").withColumn("new_status", moved).drop("_done", "_blocks")
