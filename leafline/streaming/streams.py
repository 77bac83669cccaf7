"""Event streams: windows with a watermark, and the latest state of each job."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from leafline.sources import shared
from leafline.sources.tables import load

STATE = "user_id long, ts timestamp, event_id long, status string, seen long"


def event_stream(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """The events table as a file stream, with an event time that watermarks accept.

    ``files`` bounds what one micro-batch takes: the back-pressure of a file source."""
    schema: StructType = load(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    raw = (reader.option("maxFilesPerTrigger", files) if files else reader).format("parquet").load(f"{sf_dir}/events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def day_windows(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Count and sum of each day and type; events later than ``late`` are not waited for."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def run_once(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there; the rows of its last result.

    ``complete`` keeps the last epoch; ``append`` gives each window once, when the watermark has passed
    it, so windows that may still change are not there and late events change nothing.  The
    checkpoint goes when the run is over, the rows when the driver ends."""
    folder = _shared(spark)
    table = f"{name}_{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        # the same epoch writes the same folder, so a repeated batch changes nothing
        batch.write.mode("overwrite").parquet(f"{folder}/{table}/epoch={epoch if mode != 'complete' else 0}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/{table}-checkpoint").foreachBatch(write).start()
    query.awaitTermination()
    shared.remove(spark, f"{folder}/{table}-checkpoint")
    shared.removed_at_exit(spark, f"{folder}/{table}")
    return spark.read.schema(stream.schema).parquet(f"{folder}/{table}/epoch=*")


def _shared(spark: SparkSession) -> str:
    return f"{shared.folder(spark)}/streams"


@contextlib.contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs; the session's own setting comes back after."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class LatestStatus(StatefulProcessor):
    """Keeps each job's newest event and how many were seen; late events only count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "ts timestamp, event_id long, status string, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        have = self.state.get() if self.state.exists() else None
        best, seen = (tuple(have[:3]), have[3]) if have else ((pd.Timestamp.min, -1, ""), 0)
        for batch in rows:
            seen += len(batch)
            top = batch.sort_values(["ts", "event_id"]).iloc[-1]
            if (top["ts"], top["event_id"]) > best[:2]:
                best = (top["ts"], int(top["event_id"]), top["event_type"])
        self.state.update((*best, seen))
        yield pd.DataFrame({"user_id": [key[0]], "ts": [best[0]], "event_id": [best[1]], "status": [best[2]], "seen": [seen]})

    def close(self) -> None:
        pass


def latest_state(spark: SparkSession, events: DataFrame) -> DataFrame:
    """``user_id``, ``status`` and ``seen``: a keyed state machine over the stream."""
    with with_rocksdb(spark):
        stream = events.groupBy("user_id").transformWithStateInPandas(LatestStatus(), STATE, "Update", "None")
        rows = run_once(spark, stream, "latest", "update")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("status", "seen"), "seen").alias("s"))
    return last.select("user_id", "s.status", "s.seen")
