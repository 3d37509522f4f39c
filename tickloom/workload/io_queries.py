"""Queries that write tables, logs or raw files to the shared folder and read them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.text import utc_date
from tickloom.operators.sampling import time_bucket_sample
from tickloom.plans import features, normalize
from tickloom.plans.canonical import first_non_empty
from tickloom.session import shared_folder
from tickloom.sources import raw, sinks, tables
from tickloom.streaming.ingest import committed, normalise_stream, raw_stream
from tickloom.workload import mapping as m
from tickloom.workload.base_sql import BOOK, HOUR, TICKS, with_ctes
from tickloom.workload.registry import query
from tickloom.workload.stream_queries import _Streamed
from tickloom.workload.table_queries import feed_messages, messages, own_messages, raw_lines

DATE = "strftime(to_timestamp(recv_ns // 1000000000) AT TIME ZONE 'UTC', '%Y%m%d')"


@query(
    "dated_table_range",
    with_ctes(TICKS, f"SELECT {DATE} AS date, asset_id, seq, mid FROM ticks WHERE {DATE} BETWEEN '20240105' AND '20240110'"),
)
def range_query(spark, sf):
    root = shared_folder(spark, "dated")
    sinks.write_dated(m.ticks(spark, sf).select("recv_ns", "asset_id", "seq", "mid"), f"{root}/normalized/book")
    book = tables.load_tables(spark, root)["book"].frame
    return book.where(F.col("date").between("20240105", "20240110")).select("date", "asset_id", "seq", "mid")


@query(
    "schema_report",
    with_ctes(TICKS, f"SELECT {DATE} AS date, 'trades' AS \"table\", count(*) AS rows, CAST(NULL AS VARCHAR) AS error FROM ticks GROUP BY 1 UNION ALL SELECT NULL, 'quotes', 0, 'missing'"),
)
def report_query(spark, sf):
    root = shared_folder(spark, "report")
    sinks.write_dated(m.ticks(spark, sf).select("recv_ns", "seq"), f"{root}/normalized/trades")
    report = tables.schema_report(spark, tables.load_tables(spark, root))
    return report.where("`table` in ('trades', 'quotes')").select("date", "table", "rows", "error")


@query(
    "market_parts",
    with_ctes(TICKS, "SELECT '202401' AS date, CASE WHEN k % 10 < 2 THEN repeat('a', 200) || (k % 10) WHEN k % 10 = 2 THEN 'm_3' ELSE 'm/' || (k % 10) END AS market_id, count(*) AS rows FROM ticks GROUP BY ALL"),
)
def parts_query(spark, sf):
    path = shared_folder(spark, "parts")
    digit = (F.col("k") % 10).cast("string")
    market = F.when(F.col("k") % 10 < 2, F.concat(F.lit("a" * 200), digit)).when(F.col("k") % 10 == 2, "m_3").otherwise(F.concat(F.lit("m/"), digit))
    t = m.ticks(spark, sf).select("recv_ns", "seq", market.alias("market_id"), utc_date(F.col("recv_ns"), "yyyyMM").alias("date"))
    sinks.write_parts(t, path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("date").cast("string").alias("date"), "market_id").agg(F.count(F.lit(1)).alias("rows"))


@query("recovered_gzip_lines", with_ctes(TICKS, "SELECT seq, recv_ns FROM ticks WHERE event_type = 'purchase'"))
def gzip_query(spark, sf):
    """The raw log as gzip files, read member by member, parsed like the plain log."""
    path = shared_folder(spark, "gzip")
    raw_lines(spark, sf).select(F.concat(F.col("value"), F.lit("\t"), F.col("seq").cast("string"))).write.option("compression", "gzip").text(path)
    files = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "path string")
    lines = raw.recover_gzip(spark, files).where("value is not null")
    parts = F.split("value", "\t")
    split = lines.select(F.get(parts, 0).alias("value"), F.get(parts, 1).cast("long").alias("seq"))
    parsed = normalize.parse_market_messages(raw.flatten_payload(raw.envelope(split)))
    return normalize.trades(parsed, "venue").select("seq", "recv_ns")


@query("stream_normalisation", with_ctes(TICKS, "SELECT recv_ns, asset_id, mid AS price, CAST(k AS DOUBLE) AS size FROM ticks WHERE event_type = 'purchase'"))
def normalise_query(spark, sf):
    """The raw log streamed into the three normalised tables."""
    source, out = shared_folder(spark, "raw"), shared_folder(spark, "normalised")
    raw_lines(spark, sf).select("value").write.text(source)
    normalise_stream(raw_stream(spark, source), out, shared_folder(spark, "normalise-checkpoint"), once=True).awaitTermination()
    return spark.read.parquet(f"{out}/trades").select("recv_ns", "asset_id", "price", "size")


FEED_TABLES = {
    "trades": ["purchase"], "quotes": ["view"], "book_updates": ["click", "click", "signup"], "feed_quotes": ["view"], "feed_trades": ["purchase"],
    "feed_book": ["click", "signup"], "own_orders": ["error"], "own_trades": ["purchase"],
}


MOST_FILES = 64  # of a micro-batch, so that it doesn't grow with the log


def write_raw(lines: DataFrame, folder: str, lines_per_file: int = 50_000) -> None:
    """Add a raw log to a folder, in files of bounded length, as many as there are lines for."""
    lines.write.mode("append").option("maxRecordsPerFile", lines_per_file).text(folder)


@query(
    "stream_all_feeds",
    with_ctes(
        TICKS,
        " UNION ALL ".join(
            f"SELECT '{name}' AS \"table\", strftime(make_timestamp(recv_ns // 1000), '%Y%m%d') AS date, count(*) AS rows, CAST(sum(recv_ns // 1000000 % 1000003) AS BIGINT) AS place FROM ("
            + " UNION ALL ".join(f"SELECT recv_ns FROM ticks WHERE event_type = '{kind}'" for kind in kinds)
            + ") GROUP BY 2"
            for name, kinds in FEED_TABLES.items()
        ),
    ),
)
def all_feeds_query(spark, sf):
    """Raw logs of the market feed, the reference feed and own events in one stream of several batches, one table each kind."""
    source, out, checkpoint = (shared_folder(spark, p) for p in ("all-raw", "all-tables", "all-checkpoint"))
    write_raw(raw_lines(spark, sf).select("value"), source)
    for other in (feed_messages(spark, sf), own_messages(spark, sf)):
        lines = other.select(F.to_json(F.struct("recv_ns", F.col("message").alias("raw"))).alias("value"))
        write_raw(lines, source)
    half = (len(spark.read.text(source).inputFiles()) + 1) // 2
    normalise_stream(raw_stream(spark, source, max_files=min(half, MOST_FILES)), out, checkpoint, once=True).awaitTermination()
    rows = [committed(spark, out, name).select(F.lit(name).alias("table"), "date", "recv_ns") for name in FEED_TABLES]
    place = F.expr("recv_ns div 1000000") % 1_000_003
    return reduce(DataFrame.unionByName, rows).groupBy("table", "date").agg(F.count(F.lit(1)).alias("rows"), F.sum(place).alias("place"))


@query("event_log_round_trip", with_ctes(TICKS, "SELECT seq, CASE WHEN k % 4 <> 0 THEN CAST(k AS DOUBLE) END AS p FROM ticks WHERE event_type = 'click'"))
def log_query(spark, sf):
    """A stream of samples with non-finite numbers as JSON lines and back."""
    path = shared_folder(spark, "log")
    value = F.when(F.col("k") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("k").cast("double"))
    samples = m.ticks(_Streamed(spark), sf).select(F.col("event_type").alias("event"), "seq", F.struct(value.alias("p")).alias("prediction"))
    sinks.write_event_log(samples, path, shared_folder(spark, "log-checkpoint")).awaitTermination()
    rows = raw.read_event_log(spark.read.text(path), "event string, seq long, prediction struct<p:double>", "click")
    return rows.select("seq", F.col("prediction.p").alias("p"))


@query("source_tags", with_ctes(TICKS, "SELECT seq, CASE WHEN k % 3 = 0 THEN 'venue:s-' || k ELSE 'venue' END AS source FROM ticks WHERE event_type = 'purchase'"))
def tag_query(spark, sf):
    t = normalize.trades(messages(spark, sf), "venue")
    slug = F.when(F.col("size") % 3 == 0, F.concat(F.lit("s-"), F.col("size").cast("long").cast("string")))
    return normalize.tag_source(t.withColumn("slug", slug), "venue").select("seq", "source")


@query(
    "research_bucket_lookup",
    with_ctes(
        BOOK + ", r AS (SELECT asset_id, recv_ns, 'q' || (seq % 10) AS price_bucket FROM book WHERE seq % 4 = 0)",
        f"""SELECT s.seq, (SELECT arg_max(r.price_bucket, r.recv_ns) FROM r WHERE r.asset_id = s.asset_id AND r.recv_ns <= s.recv_ns AND r.recv_ns >= s.recv_ns - {6 * HOUR}) AS price_bucket,
            CASE WHEN top1_imbalance < -0.3 THEN 0 WHEN top1_imbalance < 0 THEN 1 WHEN top1_imbalance < 0.3 THEN 2 ELSE 3 END AS imbalance_bucket FROM book s""",
    ),
)
def research_query(spark, sf):
    book = m.book(spark, sf).withColumn("realized_vol_short", F.lit(0.0))
    research = book.where("seq % 4 = 0").select("market_id", "asset_id", "recv_ns", "seq", F.concat(F.lit("q"), (F.col("seq") % 10).cast("string")).alias("price_bucket"))
    return features.add_buckets(book, research, 6 * HOUR).select("seq", "price_bucket", "imbalance_bucket")


@query("late_columns", with_ctes(BOOK, "SELECT seq, best_ask, current_spread FROM book WHERE top1_imbalance > 0.8"))
def late_query(spark, sf):
    book = m.book(spark, sf)
    chosen = book.where("top1_imbalance > 0.8").select("seq")
    return tables.late_columns(chosen, book, ["seq"], ["best_ask", "current_spread"])


@query(
    "preferred_book",
    with_ctes(BOOK, f"SELECT seq FROM book QUALIFY row_number() OVER (PARTITION BY asset_id, recv_ns // {HOUR} ORDER BY recv_ns DESC, seq DESC) = 1"),
)
def preferred_query(spark, sf):
    book = m.book(spark, sf)
    sampled = time_bucket_sample(book, ["asset_id"], ["recv_ns", "seq"], HOUR)
    return first_non_empty(None, book.where("seq < 0"), sampled, book).select("seq")

