"""Instrument dimension: payloads to rows, lookups, slices per date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import NS_PER_SECOND
from tickloom.functions.text import blank_to_null, contains_any, iso_to_ns, json_list, safe_double, slug_fields, slugs_between
from tickloom.operators.combine import fill_unknown, union_distinct
from tickloom.operators.sampling import keep_last

LISTING = (
    "id string, question string, slug string, conditionId string, outcomes string, clobTokenIds string, active boolean, "
    "closed boolean, acceptingOrders boolean, startDate string, endDate string, orderPriceMinTickSize string, "
    "minimumTickSize string, orderMinSize string, minimumOrderSize string, makerBaseFee string, takerBaseFee string, "
    "volumeNum string, volume string, volume24hr string, volume24hrClob string, liquidityNum string, liquidity string, "
    "bestBid string, bestAsk string, spread string, updatedAt string"
)
VENUE = (
    "condition_id string, market_slug string, question string, active boolean, closed boolean, accepting_orders boolean, "
    "accepting_order_timestamp string, end_date_iso string, minimum_tick_size string, minimum_order_size string, "
    "maker_base_fee string, taker_base_fee string, tokens array<struct<token_id:string,outcome:string,price:string>>"
)


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _flag(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(False))


def _number(*cols: str) -> Column:
    """The first value that is present and not zero, else the last one."""
    values = [safe_double(F.col(c)) for c in cols]
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values[:-1]], values[-1])


def _slug_columns(slug: Column, end_date: Column) -> list[Column]:
    fields = slug_fields(slug)
    return [
        F.coalesce(fields["symbol"], F.lit("")).alias("symbol"),
        F.coalesce(fields["period"], F.lit("")).alias("period"),
        fields["start_ns"].alias("start_ns"),
        F.coalesce(fields["expiry_ns"], iso_to_ns(end_date)).alias("expiry_ns"),
    ]


def from_listings(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Instrument rows of listing payloads, one per token; outcomes pair up by place."""
    p = payloads.select(F.from_json(column, LISTING).alias("p")).select("p.*")
    p = p.withColumn("__tokens", json_list(F.col("clobTokenIds"))).withColumn("__outcomes", json_list(F.col("outcomes")))
    rows = p.select("*", F.posexplode("__tokens").alias("outcome_index", "__token"))
    return rows.select(
        F.col("__token").alias("asset_id"),
        F.coalesce(F.get("__outcomes", F.col("outcome_index")), F.lit("")).alias("outcome"),
        "outcome_index",
        _text("id").alias("market_id"),
        _text("conditionId").alias("condition_id"),
        _text("slug").alias("slug"),
        *_slug_columns(_text("slug"), F.col("endDate")),
        _text("question").alias("question"),
        F.to_json("__outcomes").alias("outcomes"),
        F.to_json("__tokens").alias("clob_token_ids"),
        _flag("active").alias("active"),
        _flag("closed").alias("closed"),
        _flag("acceptingOrders").alias("accepting_orders"),
        F.col("startDate").alias("start_date"),
        F.col("endDate").alias("end_date"),
        _number("orderPriceMinTickSize", "minimumTickSize").alias("tick_size"),
        _number("orderMinSize", "minimumOrderSize").alias("min_order_size"),
        _number("makerBaseFee").alias("maker_base_fee"),
        _number("takerBaseFee").alias("taker_base_fee"),
        _number("volumeNum", "volume").alias("volume"),
        _number("volume24hr", "volume24hrClob").alias("volume_24h"),
        _number("liquidityNum", "liquidity").alias("liquidity"),
        _number("bestBid").alias("best_bid_snapshot"),
        _number("bestAsk").alias("best_ask_snapshot"),
        _number("spread").alias("spread_snapshot"),
        F.col("updatedAt").alias("updated_at"),
    )


def from_venue(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Instrument rows of venue payloads; tokens without an id are dropped."""
    p = payloads.select(F.from_json(column, VENUE).alias("p")).select("p.*")
    rows = p.select("*", F.posexplode("tokens").alias("outcome_index", "__t"))
    none = F.lit(None)
    return rows.where(blank_to_null(F.col("__t.token_id")).isNotNull()).select(
        F.col("__t.token_id").alias("asset_id"),
        F.coalesce("__t.outcome", F.lit("")).alias("outcome"),
        "outcome_index",
        _text("condition_id").alias("market_id"),
        _text("condition_id").alias("condition_id"),
        _text("market_slug").alias("slug"),
        *_slug_columns(_text("market_slug"), F.col("end_date_iso")),
        _text("question").alias("question"),
        F.to_json(F.transform("tokens", lambda t: F.coalesce(t["outcome"], F.lit("")))).alias("outcomes"),
        F.to_json(F.transform("tokens", lambda t: F.coalesce(t["token_id"], F.lit("")))).alias("clob_token_ids"),
        _flag("active").alias("active"),
        _flag("closed").alias("closed"),
        _flag("accepting_orders").alias("accepting_orders"),
        F.col("accepting_order_timestamp").alias("start_date"),
        F.col("end_date_iso").alias("end_date"),
        _number("minimum_tick_size").alias("tick_size"),
        _number("minimum_order_size").alias("min_order_size"),
        _number("maker_base_fee").alias("maker_base_fee"),
        _number("taker_base_fee").alias("taker_base_fee"),
        none.cast("double").alias("volume"),
        none.cast("double").alias("volume_24h"),
        none.cast("double").alias("liquidity"),
        safe_double(F.col("__t.price")).alias("best_bid_snapshot"),
        none.cast("double").alias("best_ask_snapshot"),
        none.cast("double").alias("spread_snapshot"),
        none.cast("string").alias("updated_at"),
    )


def instrument_table(venue: DataFrame, listings: DataFrame) -> DataFrame:
    """Venue rows first, listings for assets the venue does not know, last row per asset."""
    rows = fill_unknown(venue, listings, "asset_id")
    return keep_last(rows, ["asset_id"], ["expiry_ns", "outcome_index"])


def known_slugs(tables: Sequence[DataFrame], source: str, buffer_seconds: int = 3600) -> DataFrame:
    """Slugs named by source tags plus all slugs of the tables' common time range.

    Rows without a receive time (0 or null) have no part in the range.
    """
    tagged, bounds = [], []
    prefix = f"{source}:"
    for t in tables:
        if "source" in t.columns:
            name = F.substring(F.col("source"), len(prefix) + 1, 1 << 20)
            tagged.append(t.where(F.startswith("source", F.lit(prefix))).select(name.alias("slug")).where("slug <> ''"))
        if "recv_ns" in t.columns:
            bounds.append(t.where("recv_ns > 0").agg(F.min("recv_ns").alias("lo"), F.max("recv_ns").alias("hi")))
    ranges = bounds[0]
    for b in bounds[1:]:
        ranges = ranges.unionByName(b)
    span = ranges.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("lo").isNotNull())
    generated = span.select(F.explode(slugs_between(F.col("lo"), F.col("hi"), buffer_seconds)).alias("slug"))
    return union_distinct([*tagged, generated])


def known_conditions(tables: Sequence[DataFrame]) -> DataFrame:
    """Distinct condition ids (`0x...`) of the market columns."""
    return union_distinct([t.where(F.startswith("market", F.lit("0x"))).select(F.col("market").alias("condition_id")) for t in tables])


def with_trading_dates(instruments: DataFrame, dates: DataFrame) -> DataFrame:
    """Instruments per date: no expiry, or expiry between the day's start and its end + 900 s."""
    day = F.unix_timestamp(F.to_timestamp("date", "yyyyMMdd")) * NS_PER_SECOND
    spans = dates.select("date", day.alias("__start"))
    end = F.col("__start") + F.lit(86_400 * NS_PER_SECOND + 900 * NS_PER_SECOND)
    first_day = F.date_sub(F.timestamp_seconds((F.col("expiry_ns") - F.lit(900 * NS_PER_SECOND)) / NS_PER_SECOND), 0)
    days = F.array_distinct(
        F.array(
            F.date_format(F.date_sub(first_day, 1), "yyyyMMdd"),
            F.date_format(first_day, "yyyyMMdd"),
            F.date_format(F.date_add(first_day, 1), "yyyyMMdd"),
        )
    )
    dated = (
        instruments.where(F.col("expiry_ns").isNotNull())
        .withColumn("date", F.explode(days))
        .join(spans, "date")
        .where((F.col("expiry_ns") >= F.col("__start")) & (F.col("expiry_ns") <= end))
    )
    # every instrument without an expiry is an instrument of every date
    pairs = dates.select(F.lit(1).alias("__one"), "date").distinct()
    undated = instruments.where(F.col("expiry_ns").isNull()).withColumn("__one", F.lit(1)).join(pairs, "__one").drop("__one")
    return dated.drop("__start").unionByName(undated)


def tagged_markets(markets: DataFrame, texts: Sequence[str], tags: Sequence[str]) -> DataFrame:
    """Markets in whose texts any of the tags occurs, compared without case."""
    words = F.array(*[F.lit(t) for t in tags])
    return markets.where(contains_any([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts], words))


def active_markets(markets: DataFrame, tags: Sequence[str] = ()) -> DataFrame:
    """Active, not closed, and (where tags are given) with a tag among `tags`."""
    live = markets.where(F.col("active") & ~F.col("closed"))
    if not tags:
        return live
    hit = F.lit(False)
    for t in tags:
        hit = hit | F.contains(F.lower("tags"), F.lit(t.lower()))
    return live.where(hit)


def subscription_assets(markets: DataFrame, tags: Sequence[str] = ()) -> DataFrame:
    """Asset ids of the active markets."""
    return active_markets(markets, tags).select(F.explode(json_list(F.col("clob_token_ids"))).alias("asset_id"))


def markets_of_assets(assets: DataFrame, asset_market: DataFrame, markets: DataFrame) -> DataFrame:
    """The market rows of the given assets."""
    return assets.join(asset_market, "asset_id").join(markets, "market_id")
