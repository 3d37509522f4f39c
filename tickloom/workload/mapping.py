"""The driver's tables seen as ticks, trades, books and instruments.

Durations are stretched by `SCALE`: the tables hold a few events per key and day, so a
"second" of the feature definitions is an hour here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import prepare

SCALE = 3600
HOUR = 3600 * 1_000_000_000
DAY = 24 * HOUR
CLOCK = dict(scale=SCALE, slice_width=2 * DAY)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Events as price ticks: two users form a market, the value's cents give the price."""
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("recv_ns"),
        F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("asset_id"),
        F.concat(F.lit("m"), F.floor(F.col("user_id") / 2).cast("string")).alias("market_id"),
        F.when(F.col("user_id") % 2 == 0, "Up").otherwise("Down").alias("outcome"),
        "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        ((2 + cents % 97).cast("double") / F.lit(100.0)).alias("mid"),
    )


def book(spark: SparkSession, sf: str) -> DataFrame:
    """Every tick as a canonical book row."""
    t = ticks(spark, sf)
    return t.select(
        "recv_ns",
        "seq",
        "market_id",
        "asset_id",
        "outcome",
        F.lit("BTC").alias("symbol"),
        (F.col("mid") - 0.01).alias("best_bid"),
        (F.col("mid") + 0.01).alias("best_ask"),
        F.col("mid").alias("current_mid"),
        (0.01 + (F.col("k") % 5).cast("double") / 100.0).alias("current_spread"),
        (((F.col("k") % 21) - 10).cast("double") / 10.0).alias("top1_imbalance"),
        (F.col("k") % 7).cast("int").alias("total_bid_levels"),
        (F.col("k") % 11).cast("int").alias("total_ask_levels"),
        F.when(F.col("k") % 4 != 0, (F.col("k") - 50).cast("double") / 50.0).alias("depth_top10_imbalance"),
        F.lit(0.01).alias("tick_size"),
    )


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases as buys and errors as sells."""
    t = ticks(spark, sf).where(F.col("event_type").isin("purchase", "error"))
    buy = F.col("event_type") == "purchase"
    return t.select(
        "recv_ns",
        "seq",
        "market_id",
        "asset_id",
        F.col("mid").alias("price"),
        (F.col("k") + 1).cast("double").alias("size"),
        F.when(buy, "BUY").otherwise("SELL").alias("side"),
        F.when(buy, 1.0).otherwise(-1.0).alias("signed_side"),
    )


def reference_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Views as the reference feed of a single symbol."""
    return ticks(spark, sf).where(F.col("event_type") == "view").select(
        "recv_ns", "seq", F.lit("BTC").alias("symbol"), F.col("mid").alias("ref_mid")
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks with stand-ins for model scores and realised profits."""
    b = book(spark, sf)
    x = F.pmod(F.col("seq") * 7919, F.lit(1000)).cast("double") / 1000.0
    y = F.pmod(F.col("seq") * 104729, F.lit(1000)).cast("double") / 1000.0
    return b.select(
        "recv_ns",
        "seq",
        "market_id",
        "asset_id",
        "outcome",
        F.concat(F.lit("A"), F.substring("asset_id", 2, 9).cast("long").bitwiseXOR(F.lit(1)).cast("string")).alias("opposite_asset_id"),
        "best_bid",
        "best_ask",
        F.col("current_spread"),
        F.lit(None).cast("string").alias("slug"),
        F.pmod("seq", F.lit(400)).cast("double").alias("time_to_expiry_seconds"),
        x.alias("p_fill"),
        (y / 10.0 - 0.05).alias("pred_unwind_profit"),
        F.pmod(F.col("seq") * 31, F.lit(100)).cast("double").alias("profit_ticks"),
        (F.pmod(F.col("seq") * 31, F.lit(100)).cast("double") / 1000.0 - 0.04).alias("profit"),
        F.when(F.pmod(F.col("seq") * 17, F.lit(3)) != 0, "enter").otherwise("skip").alias("fill_cls"),
    )


def deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as price-level deltas of one book per supplier.

    A line's place in (order, line) is its time of day; size 0 removes the level.
    """
    line = table(spark, sf, "lineitem")
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 0)
    gone = (F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 3 == 0)
    return line.select(
        F.col("l_suppkey").cast("string").alias("asset_id"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("recv_ns"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.lit(0).alias("part2"),
        F.lit("delta").alias("kind"),
        F.when(F.col("l_returnflag") == "A", "buy").otherwise("sell").alias("side"),
        price.cast("decimal(18,2)").cast("string").alias("price"),
        F.when(gone, "0").otherwise(F.col("l_quantity").cast("string")).alias("size"),
        F.lit(None).cast("array<struct<price:string,size:string>>").alias("bids"),
        F.lit(None).cast("array<struct<price:string,size:string>>").alias("asks"),
    )
