"""Landing and normalising raw messages as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.text import utc_date
from tickloom.plans import normalize
from tickloom.session import cut_lineage, drop_written
from tickloom.sources.raw import envelope, flatten_payload


def raw_stream(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """New files of a raw-log folder as messages."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).select("value")
    return flatten_payload(envelope(lines))


def normalise_stream(
    messages: DataFrame, folder: str, checkpoint: str, source: str = "venue", feed: str = "feed", once: bool = False
) -> StreamingQuery:
    """Messages of the market feed, the reference feed and own events into one table each kind (`normalize.ALL_TABLES`).

    A micro-batch is parsed once and written while its tables are made from it. (A cache would set aside room for
    thousands of the widest messages in every task.) Each table is
    partitioned by UTC date and micro-batch, so a replayed batch overwrites itself, and a
    batch counts (`committed`) once all its tables are there. `seq` is the row's place in
    its batch: rows are ordered by (recv_ns, batch, seq).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, folder, source, feed)

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def write_batch(batch: DataFrame, batch_id: int, folder: str, source: str = "venue", feed: str = "feed") -> None:
    """All tables of one batch, then the mark that they are whole."""
    parsed = cut_lineage(normalize.parse_all_messages(batch.withColumn("seq", F.monotonically_increasing_id())), "parsed")
    try:
        for name, table in normalize.ALL_TABLES.items():
            (
                table(parsed, source, feed)
                .withColumn("date", utc_date(F.col("recv_ns")))
                .withColumn("batch", F.lit(batch_id).cast("long"))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("date", "batch")
                .parquet(f"{folder}/{name}")
            )
    finally:
        drop_written(parsed)
    mark = batch.sparkSession.range(1).select(F.lit(True).alias("whole"))
    mark.write.mode("overwrite").parquet(f"{folder}/batches/batch={batch_id}")


def committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of `normalise_stream` without batches that broke off; `date` and `batch` are columns.

    The schema is known without files, so a table that got no rows is empty, not an error.
    """
    empty = normalize.parse_all_messages(spark.createDataFrame([], "recv_ns long, part int, message string, seq long"))
    schema = normalize.ALL_TABLES[name](empty, "", "").schema.add("date", "string").add("batch", "long")
    whole = spark.read.schema("whole boolean, batch long").parquet(f"{folder}/batches")
    return spark.read.schema(schema).parquet(f"{folder}/{name}").join(whole, "batch", "left_semi")


def land_raw(messages: DataFrame, folder: str, checkpoint: str, seconds: int = 5) -> StreamingQuery:
    """Append messages to the date-partitioned raw log every few seconds."""
    dated = messages.withColumn("date", utc_date(F.col("recv_ns")))
    return (
        dated.writeStream.format("json").option("compression", "gzip").partitionBy("date")
        .option("path", folder).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
    )
