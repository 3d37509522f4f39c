"""Raw messages to typed tables. All routing is filters over one parsed frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.depth import DEPTH_COLUMNS, depth_features, parse_levels
from tickloom.functions.prices import microprice, mid
from tickloom.functions.text import blank_to_null, safe_double, safe_long

LEVELS = "array<struct<price:string,size:string>>"
MARKET_MESSAGE = (
    "event_type string, asset_id string, market string, timestamp string, price string, size string, side string, "
    f"fee_rate_bps string, best_bid string, best_ask string, spread string, bids {LEVELS}, asks {LEVELS}, "
    "price_changes array<struct<asset_id:string,price:string,size:string,side:string,best_bid:string,best_ask:string>>"
)
FEED_LEVELS = "array<array<string>>"
COMPACT = ", ".join(f"{c}:double" for c in DEPTH_COLUMNS)
FEED_MESSAGE = (
    "stream string, data struct<s:string,u:bigint,b:string,a:string,p:string,q:string,m:boolean,T:bigint,"
    f"lastUpdateId:bigint,bids:{FEED_LEVELS},asks:{FEED_LEVELS},compact_depth_features:boolean,asset_id:string,"
    "market:string,exchange_ts:bigint,best_bid:double,best_ask:double,spread:double,midpoint:double,microprice:double,"
    f"imbalance:double,total_bid_levels:int,total_ask_levels:int,{COMPACT}>"
)
OWN_MESSAGE = (
    "event_type string, id string, order_id string, market string, asset_id string, side string, price string, "
    "original_size string, size_matched string, size string, status string, type string, order_type string, timestamp string"
)

# fields of all three feeds; those that market messages and own events share have one type
EVERY_MESSAGE = ", ".join([MARKET_MESSAGE, *[f for f in OWN_MESSAGE.split(", ") if f not in MARKET_MESSAGE.split(", ")], FEED_MESSAGE])


def zero_if_missing(col: Column) -> Column:
    return F.coalesce(safe_double(col), F.lit(0.0))


def parse_market_messages(messages: DataFrame, column: str = "message") -> DataFrame:
    """The market feed's messages as one typed struct `m`; messages without a type are dropped."""
    carried = [c for c in messages.columns if c != column]
    return messages.select(*carried, F.from_json(column, MARKET_MESSAGE).alias("m")).where(
        blank_to_null(F.col("m.event_type")).isNotNull()
    )


def _exchange_ts() -> Column:
    return F.coalesce(safe_long(F.col("m.timestamp")), F.lit(0).cast("long"))


def trades(parsed: DataFrame, source: str) -> DataFrame:
    return parsed.where(F.col("m.event_type") == "last_trade_price").select(
        F.lit(source).alias("source"),
        F.coalesce("m.asset_id", F.lit("")).alias("asset_id"),
        F.coalesce("m.market", F.lit("")).alias("market"),
        "recv_ns",
        _exchange_ts().alias("exchange_ts"),
        zero_if_missing(F.col("m.price")).alias("price"),
        zero_if_missing(F.col("m.size")).alias("size"),
        F.coalesce("m.side", F.lit("")).alias("side"),
        zero_if_missing(F.col("m.fee_rate_bps")).alias("fee_rate_bps"),
        "seq",
    )


def quotes(parsed: DataFrame, source: str) -> DataFrame:
    return parsed.where(F.col("m.event_type") == "best_bid_ask").select(
        F.lit(source).alias("source"),
        F.coalesce("m.asset_id", F.lit("")).alias("asset_id"),
        F.coalesce("m.market", F.lit("")).alias("market"),
        "recv_ns",
        _exchange_ts().alias("exchange_ts"),
        *[zero_if_missing(F.col(f"m.{c}")).alias(c) for c in ("best_bid", "best_ask", "spread")],
        "seq",
    )


def book_updates(parsed: DataFrame) -> DataFrame:
    """Book messages as update rows for the order-book operators.

    `kind` is `snapshot` (with whole `bids` / `asks`) or `delta` (one price level). One
    price-change message gives one delta per change, numbered by `part2`.
    """
    snapshots = parsed.where(F.col("m.event_type") == "book").select(
        F.coalesce("m.asset_id", F.lit("")).alias("asset_id"),
        F.coalesce("m.market", F.lit("")).alias("market"),
        "recv_ns",
        "seq",
        F.lit(0).alias("part2"),
        _exchange_ts().alias("exchange_ts"),
        F.lit("snapshot").alias("kind"),
        F.lit(None).cast("string").alias("side"),
        F.lit(None).cast("string").alias("price"),
        F.lit(None).cast("string").alias("size"),
        F.col("m.bids").alias("bids"),
        F.col("m.asks").alias("asks"),
    )
    change = F.posexplode("m.price_changes").alias("part2", "c")
    deltas = (
        parsed.where(F.col("m.event_type") == "price_change")
        .select("recv_ns", "seq", F.col("m.market").alias("market"), _exchange_ts().alias("exchange_ts"), change)
        .select(
            F.coalesce("c.asset_id", F.lit("")).alias("asset_id"),
            F.coalesce("market", F.lit("")).alias("market"),
            "recv_ns",
            "seq",
            "part2",
            "exchange_ts",
            F.lit("delta").alias("kind"),
            F.lower(F.coalesce("c.side", F.lit("BUY"))).alias("side"),
            F.coalesce("c.price", F.lit("0")).alias("price"),
            F.coalesce("c.size", F.lit("0")).alias("size"),
            F.lit(None).cast(LEVELS).alias("bids"),
            F.lit(None).cast(LEVELS).alias("asks"),
        )
    )
    return snapshots.unionByName(deltas)


def tag_source(df: DataFrame, source: str) -> DataFrame:
    """`source` becomes `source:slug` where the slug is known."""
    slug = blank_to_null(F.col("slug"))
    tagged = F.when((F.col("source") == source) & slug.isNotNull(), F.concat_ws(":", F.lit(source), slug))
    return df.withColumn("source", tagged.otherwise(F.col("source")))


def parse_feed_messages(messages: DataFrame, column: str = "message") -> DataFrame:
    """The reference feed's messages: `stream` and the typed `data` struct."""
    carried = [c for c in messages.columns if c != column]
    return (
        messages.select(*carried, F.from_json(column, FEED_MESSAGE).alias("f"))
        .select(*carried, F.coalesce("f.stream", F.lit("")).alias("stream"), F.col("f.data").alias("data"))
        .where(F.col("data").isNotNull())
    )


def feed_quotes(parsed: DataFrame, source: str) -> DataFrame:
    """Best prices; the feed's update id has its own column and is not a time."""
    bid, ask = zero_if_missing(F.col("data.b")), zero_if_missing(F.col("data.a"))
    return parsed.where(F.endswith("stream", F.lit("@bookTicker"))).select(
        F.lit(source).alias("source"),
        F.lower(F.coalesce("data.s", F.lit(""))).alias("asset_id"),
        "recv_ns",
        F.coalesce("data.u", F.lit(0).cast("long")).alias("update_id"),
        bid.alias("best_bid"),
        ask.alias("best_ask"),
        (ask - bid).alias("spread"),
        "seq",
    )


def feed_trades(parsed: DataFrame, source: str) -> DataFrame:
    """Aggregated trades; a buyer that was the maker means an aggressive seller."""
    return parsed.where(F.endswith("stream", F.lit("@aggTrade"))).select(
        F.lit(source).alias("source"),
        F.lower(F.coalesce("data.s", F.lit(""))).alias("asset_id"),
        F.lit("").alias("market"),
        "recv_ns",
        (F.coalesce("data.T", F.lit(0).cast("long")) * 1_000_000).alias("exchange_ts"),
        zero_if_missing(F.col("data.p")).alias("price"),
        zero_if_missing(F.col("data.q")).alias("size"),
        F.when(F.col("data.m"), "SELL").otherwise("BUY").alias("side"),
        F.lit(0.0).alias("fee_rate_bps"),
        "seq",
    )


def stream_depth(stream: Column) -> Column:
    """Number of levels named by the stream, 20 if it names none."""
    return F.coalesce(blank_to_null(F.regexp_extract(stream, r"@depth(\d+)", 1)).try_cast("int"), F.lit(20))


def feed_book(parsed: DataFrame, source: str) -> DataFrame:
    """Depth snapshots: features of the level arrays, or the ready-made compact columns.

    Features deeper than the subscription are null.
    """
    depth = parsed.where(F.contains("stream", F.lit("@depth"))).withColumn("__max", stream_depth(F.col("stream")))
    has_levels = (F.size(F.coalesce("data.bids", F.array().cast(FEED_LEVELS))) > 0) & (
        F.size(F.coalesce("data.asks", F.array().cast(FEED_LEVELS))) > 0
    )
    levels = (
        depth.where(has_levels)
        .withColumn("__b", parse_levels(F.col("data.bids"), F.col("__max")))
        .withColumn("__a", parse_levels(F.col("data.asks"), F.col("__max")))
    )
    bid = F.try_element_at(F.get("data.bids", 0), F.lit(1)).try_cast("double")
    ask = F.try_element_at(F.get("data.asks", 0), F.lit(1)).try_cast("double")
    usable = (F.size("__b") > 0) & (F.size("__a") > 0)
    b0, a0 = F.get("__b", 0), F.get("__a", 0)

    def needed(name: str) -> int:
        return int("".join(ch for ch in name.removesuffix("_imbalance") if ch.isdigit()))

    features = depth_features(F.col("__b"), F.col("__a"))
    from_levels = levels.select(
        F.lit(source).alias("source"),
        F.get(F.split("stream", "@"), 0).alias("asset_id"),
        F.lit("").alias("market"),
        "recv_ns",
        F.coalesce("data.lastUpdateId", F.lit(0).cast("long")).alias("update_id"),
        bid.alias("best_bid"),
        ask.alias("best_ask"),
        (ask - bid).alias("spread"),
        mid(bid, ask).alias("midpoint"),
        F.when(usable, microprice(b0["price"], b0["size"], a0["price"], a0["size"])).alias("microprice"),
        F.when(usable, features["depth_top1_imbalance"]).alias("imbalance"),
        F.when(usable, F.size("__b")).otherwise(F.size("data.bids")).alias("total_bid_levels"),
        F.when(usable, F.size("__a")).otherwise(F.size("data.asks")).alias("total_ask_levels"),
        *[F.when(usable & (F.col("__max") >= needed(n)), c).alias(n) for n, c in features.items()],
        "seq",
    )
    compact = depth.where(~has_levels & F.coalesce("data.compact_depth_features", F.lit(False))).select(
        F.lit(source).alias("source"),
        F.lower(F.coalesce(blank_to_null(F.col("data.asset_id")), F.get(F.split("stream", "@"), 0))).alias("asset_id"),
        F.coalesce("data.market", F.lit("")).alias("market"),
        "recv_ns",
        F.coalesce("data.exchange_ts", F.lit(0).cast("long")).alias("update_id"),
        *[
            F.col(f"data.{c}").alias(c)
            for c in (
                "best_bid", "best_ask", "spread", "midpoint", "microprice", "imbalance", "total_bid_levels", "total_ask_levels"
            )
        ],
        *[F.col(f"data.{c}").alias(c) for c in features],
        "seq",
    )
    return from_levels.unionByName(compact)


def parse_own_messages(messages: DataFrame, column: str = "message") -> DataFrame:
    """Own order and trade events as one typed struct `m`."""
    return messages.select("recv_ns", "seq", F.from_json(column, OWN_MESSAGE).alias("m"))


def own_orders(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("m.event_type") == "order").select(
        F.coalesce("m.id", "m.order_id", F.lit("")).alias("order_id"),
        *[F.coalesce(f"m.{c}", F.lit("")).alias(c) for c in ("market", "asset_id", "side")],
        *[zero_if_missing(F.col(f"m.{c}")).alias(c) for c in ("price", "original_size", "size_matched")],
        F.coalesce("m.type", "m.order_type", F.lit("")).alias("order_type"),
        "recv_ns",
        _exchange_ts().alias("exchange_ts"),
        "seq",
    )


def own_trades(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("m.event_type") == "trade").select(
        F.coalesce("m.id", F.lit("")).alias("trade_id"),
        *[F.coalesce(f"m.{c}", F.lit("")).alias(c) for c in ("market", "asset_id", "side")],
        *[zero_if_missing(F.col(f"m.{c}")).alias(c) for c in ("price", "size")],
        F.coalesce("m.status", F.lit("")).alias("status"),
        "recv_ns",
        _exchange_ts().alias("exchange_ts"),
        "seq",
    )


def parse_all_messages(messages: DataFrame, column: str = "message") -> DataFrame:
    """Messages of any feed, parsed once: `m` for the market feed and own events, `stream` and `data` for the reference feed."""
    carried = [c for c in messages.columns if c != column]
    return messages.select(*carried, F.from_json(column, EVERY_MESSAGE).alias("m")).select(
        *carried, "m", F.coalesce("m.stream", F.lit("")).alias("stream"), F.col("m.data").alias("data")
    )


# what `parse_all_messages` gives, a table each: (parsed, source, feed) to rows; a message that fits none is in none
ALL_TABLES: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {
    "trades": lambda parsed, source, feed: trades(parsed, source),
    "quotes": lambda parsed, source, feed: quotes(parsed, source),
    "book_updates": lambda parsed, source, feed: book_updates(parsed),
    "feed_quotes": lambda parsed, source, feed: feed_quotes(_reference(parsed), feed),
    "feed_trades": lambda parsed, source, feed: feed_trades(_reference(parsed), feed),
    "feed_book": lambda parsed, source, feed: feed_book(_reference(parsed), feed),
    "own_orders": lambda parsed, source, feed: own_orders(parsed),
    "own_trades": lambda parsed, source, feed: own_trades(parsed),
}


def _reference(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("data").isNotNull())
