"""Canonical book, trade and reference-feed tables from whatever columns a source has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import NS_PER_MS, NS_PER_SECOND
from tickloom.functions import text
from tickloom.functions.buckets import expiry_bucket, market_phase
from tickloom.functions.depth import DEPTH_COLUMNS
from tickloom.functions.prices import mid, ratio
from tickloom.operators.asof import Lookup, asof_adaptive
from tickloom.operators.combine import union_relaxed

BOOK_DEFAULTS = {
    **{c: "string" for c in ("asset_id", "market", "source", "market_id", "condition_id", "slug", "outcome", "symbol", "period")},
    **{c: "long" for c in ("start_ns", "expiry_ns", "seq")},
    **{c: "double" for c in ("best_bid", "best_ask", "midpoint", "spread", "microprice", "imbalance")},
    **{c: "int" for c in ("total_bid_levels", "total_ask_levels")},
    **{c: "double" for c in DEPTH_COLUMNS},
}
TRADE_DEFAULTS = {
    **{c: "string" for c in ("asset_id", "market", "source", "side", "market_id", "condition_id", "slug", "outcome", "symbol", "period")},
    **{c: "double" for c in ("price", "size")},
    "seq": "long",
}
# Columns of the canonical book beyond the ones every source has.
BOOK_OPTIONAL = [
    "exchange_ts",
    "imbalance_bucket",
    "spread_bucket",
    "price_bucket",
    "vol_bucket",
    "vol_60s",
    "tick_size",
    "min_order_size",
    "maker_base_fee",
    "taker_base_fee",
    "volume_24h",
    "liquidity",
]


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Typed columns for every default; strings default to '', the rest to null."""
    typed = []
    for name, kind in defaults.items():
        if name in df.columns:
            typed.append(F.col(name).cast(kind).alias(name))
        else:
            typed.append((F.lit("") if kind == "string" else F.lit(None)).cast(kind).alias(name))
    return df.select(*typed, *[c for c in df.columns if c not in defaults])


def _hint() -> Column:
    return F.concat_ws(" ", "source", "market", "asset_id")


def market_key() -> Column:
    """Given id, else the id in the text columns, else the condition id, else the asset."""
    return text.first_text(
        F.col("market_id"), text.hint_market_id(_hint()), F.col("condition_id"), F.concat(F.lit("asset:"), F.col("asset_id"))
    )


def canonical_book(book: DataFrame) -> DataFrame:
    """One projection from any book-like table to the canonical columns."""
    df = with_defaults(book, BOOK_DEFAULTS)
    middle = F.coalesce(F.col("midpoint"), mid(F.col("best_bid"), F.col("best_ask")))
    spread = F.coalesce(F.col("spread"), F.col("best_ask") - F.col("best_bid"))
    start = F.coalesce(text.hint_start_ns(_hint()), F.col("start_ns"))
    expiry = F.coalesce(text.hint_expiry_ns(_hint()), F.col("expiry_ns"))
    remaining = (expiry - F.col("recv_ns")) / F.lit(NS_PER_SECOND)
    return (
        df.select(
            F.col("recv_ns").cast("long").alias("recv_ns"),
            "seq",
            market_key().alias("market_id"),
            "asset_id",
            text.first_text(F.col("symbol"), text.hint_symbol(_hint()), text.asset_symbol(F.col("asset_id"))).alias("symbol"),
            "market",
            "source",
            "condition_id",
            "slug",
            "outcome",
            "period",
            start.alias("start_ns"),
            expiry.alias("expiry_ns"),
            remaining.alias("time_to_expiry_seconds"),
            expiry_bucket(remaining).alias("expiry_bucket"),
            market_phase(remaining).alias("market_phase"),
            "best_bid",
            "best_ask",
            middle.alias("current_mid"),
            spread.alias("current_spread"),
            F.when(middle > 0, ratio(spread, middle)).alias("relative_spread"),
            F.col("microprice").alias("current_microprice"),
            F.col("imbalance").alias("top1_imbalance"),
            "total_bid_levels",
            "total_ask_levels",
            *DEPTH_COLUMNS,
            *[c for c in BOOK_OPTIONAL if c in df.columns],
        )
        .where(F.col("recv_ns").isNotNull() & F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull())
        .where(F.col("current_mid") > 0)
    )


def canonical_trades(trades: DataFrame) -> DataFrame:
    df = with_defaults(trades, TRADE_DEFAULTS)
    side = F.upper("side")
    sign = F.when(side.isin("BUY", "BID"), 1.0).when(side.isin("SELL", "ASK"), -1.0).otherwise(0.0)
    rest = [c for c in df.columns if c not in ("recv_ns", "side", "market_id", "symbol")]
    return df.select(
        F.col("recv_ns").cast("long").alias("recv_ns"),
        market_key().alias("market_id"),
        text.first_text(F.col("symbol"), text.hint_symbol(_hint())).alias("symbol"),
        side.alias("side"),
        sign.alias("signed_side"),
        *rest,
    )


def canonical_instruments(instruments: DataFrame) -> DataFrame:
    keys = ["asset_id", "market_id", "condition_id", "slug", "outcome", "symbol", "period"]
    return instruments.select(*[F.col(c).cast("string").alias(c) if c in keys else F.col(c) for c in instruments.columns])


def scope(book: DataFrame, symbols: Sequence[str] = (), periods: Sequence[str] = ()) -> DataFrame:
    """Keep the given symbols and periods, compared without case; no filter where empty."""
    out = book
    if symbols and "symbol" in book.columns:
        out = out.where(F.upper("symbol").isin([s.upper() for s in symbols]))
    if periods and "period" in book.columns:
        out = out.where(F.lower("period").isin([p.lower() for p in periods]))
    return out


def quality_filter(book: DataFrame, min_mid: float = 0.02, max_mid: float = 0.98, max_spread: float = 0.25) -> DataFrame:
    """Positive, uncrossed, with mid and spread inside their bounds."""
    middle = F.coalesce(F.col("midpoint"), mid(F.col("best_bid"), F.col("best_ask")))
    spread = F.coalesce(F.col("spread"), F.col("best_ask") - F.col("best_bid"))
    return (
        book.where(F.col("recv_ns").isNotNull() & F.col("asset_id").isNotNull())
        .where((F.col("best_bid") > 0) & (F.col("best_ask") > 0) & (F.col("best_bid") < F.col("best_ask")))
        .withColumn("midpoint", middle)
        .withColumn("spread", spread)
        .where(F.col("midpoint").between(min_mid, max_mid) & F.col("spread").between(0.0, max_spread))
    )


def lifecycle_filter(book: DataFrame, warmup_ns: int = 2 * NS_PER_SECOND, horizon_ns: int = 10 * NS_PER_SECOND) -> DataFrame:
    """Rows after the warm-up whose label horizon ends before the market does."""
    return book.where(
        (F.col("recv_ns") >= F.col("start_ns") + F.lit(warmup_ns))
        & (F.col("recv_ns") + F.lit(horizon_ns) <= F.col("expiry_ns"))
    )


def first_non_empty(*frames: DataFrame | None) -> DataFrame | None:
    """The first frame that has a row: sampled before enriched before raw book."""
    last = None
    for frame in frames:
        if frame is not None:
            last = frame
            if not frame.isEmpty():
                return frame
    return last


def reference_book(depth_book: DataFrame | None, quotes: DataFrame | None, prefix: str = "ref_", keyed: bool = True) -> DataFrame:
    """Reference prices from depth and quote rows, with the depth state of up to 2 s ago (of the symbol, if `keyed`)."""
    rows = canonical_book(union_relaxed([depth_book, quotes]))
    base = rows.select(
        "recv_ns",
        "seq",
        F.col("asset_id").alias(f"{prefix}asset_id"),
        F.col("symbol").alias(f"{prefix}symbol"),
        F.col("current_mid").alias(f"{prefix}mid"),
        F.col("current_spread").alias(f"{prefix}spread"),
        F.col("top1_imbalance").alias(f"{prefix}book_imbalance"),
    )
    names = {f"{prefix}{c}": c for c in DEPTH_COLUMNS}
    if depth_book is None:
        return base.select("*", *[F.lit(None).cast("double").alias(n) for n in names])
    depth = canonical_book(depth_book)
    lookup = Lookup(depth, "recv_ns", names, 2_000 * NS_PER_MS, seq="seq")
    return asof_adaptive(base, "recv_ns", [lookup], f"{prefix}symbol", "symbol", keyed)
