"""Shared parts of the streaming jobs.

Event time is `recv_ns`. Rows later than the watermark are dropped by Spark and counted
in the query's progress (`numRowsDroppedByWatermark`). Logic always uses the long
nanoseconds; the timestamp column only drives the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom import NS_PER_MS, NS_PER_SECOND
from tickloom.functions.text import ns_to_timestamp
from tickloom.session import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEFAULT_WATERMARK = "2 seconds"
DEFAULT_IDLE_NS = 3600 * NS_PER_SECOND


def prepare_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def with_event_time(df: DataFrame, watermark: str = DEFAULT_WATERMARK, ahead_ns: int = 0) -> DataFrame:
    """`df` with a watermark on its event time.

    A watermark starts at the epoch and rows at it are late; where only timers follow the watermark, times are
    put ahead by `ahead_ns`, so that clocks which start at zero lose no rows.
    """
    return df.withColumn("event_time", ns_to_timestamp(F.col("recv_ns") + F.lit(ahead_ns))).withWatermark("event_time", watermark)


class EndingProcessor(StatefulProcessor):
    """A processor whose state of a key ends when the watermark is `idle_ns` behind the key's newest row.

    One event-time timer per key moves on with its rows; when it fires, all states named by `ending`
    are cleared, and the key's next row starts anew. Without `idle_ns` (batch tables) there are no timers.
    """

    idle_ns: int | None = None

    def ending(self, handle: StatefulProcessorHandle, *states) -> None:
        """To be called in `init` with the states that end."""
        self.handle, self.states = handle, states
        self.ends = handle.getValueState("ends", "at_ms long") if self.idle_ns is not None else None

    def lives_on(self, newest_ns: int) -> None:
        if self.ends is None:
            return
        at = (int(newest_ns) + self.idle_ns) // NS_PER_MS + 1
        before = self.ends.get()[0] if self.ends.exists() else None
        if before is not None and at <= before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.ends.update((at,))

    def ends_at(self, expired_ms: int) -> bool:
        """Clear all states if the timer that fired is the key's end."""
        if self.ends is None or not self.ends.exists() or expired_ms < self.ends.get()[0]:
            return False
        for state in (*self.states, self.ends):
            state.clear()
        return True

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.ends_at(expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def close(self) -> None:
        pass


def with_state(grouped, processor: StatefulProcessor, schema: str) -> DataFrame:
    mode = "EventTime" if getattr(processor, "idle_ns", None) is not None else "None"
    return grouped.transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)


def in_order(rows: Iterator, columns: list[str]):
    """All rows of a key in this micro-batch as one ordered frame."""
    import pandas as pd

    parts = [r for r in rows if len(r)]
    if not parts:
        return None
    frame = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
    return frame.sort_values(columns, kind="stable").reset_index(drop=True)


def run_to_table(stream: DataFrame, purpose: str, partition_by: list[str] | None = None, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Run all available input once into a parquet table in the shared folder and read it back.

    The progress of every micro-batch is added to `progress`.
    """
    spark = stream.sparkSession
    path, state = shared_folder(spark, purpose), shared_folder(spark, f"{purpose}-checkpoint")
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    run = writer.start(path)
    run.awaitTermination()
    if progress is not None:
        progress += run.recentProgress
    return spark.read.schema(stream.schema).parquet(path)


def read_table_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = 64) -> DataFrame:
    """A parquet table as a stream with its batch schema; `name` may be a glob.

    Files of one job are in no order of time, and a watermark drops what later micro-batches hold of earlier times:
    without `max_files`, all that are there make one micro-batch.
    """
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)
