"""Order-book depth features from level arrays (best level first)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.prices import imbalance, microprice, mid

LEVEL = "struct<price:double,size:double>"
IMBALANCE_LEVELS = [1, 3, 5, 10, 20]
SLOPE_LEVELS = [10, 20]
NOTIONAL_LEVELS = [5, 10, 20]

DEPTH_COLUMNS = (
    [f"depth_top{n}_imbalance" for n in IMBALANCE_LEVELS]
    + [f"cum_{side}_depth_top{n}" for n in IMBALANCE_LEVELS for side in ("bid", "ask")]
    + [f"{side}_depth_slope_top{n}" for n in SLOPE_LEVELS for side in ("bid", "ask")]
    + [f"near_touch_{side}_notional_{n}" for n in NOTIONAL_LEVELS for side in ("bid", "ask")]
)


def parse_levels(raw: Column, max_depth: int | Column = 20) -> Column:
    """`[[price, size], ...]` strings to levels; malformed entries are skipped."""
    parsed = F.transform(
        F.slice(raw, F.lit(1), F.lit(max_depth) if isinstance(max_depth, int) else max_depth),
        lambda x: F.struct(
            F.try_element_at(x, F.lit(1)).try_cast("double").alias("price"),
            F.try_element_at(x, F.lit(2)).try_cast("double").alias("size"),
        ),
    )
    return F.filter(parsed, lambda x: x["price"].isNotNull() & x["size"].isNotNull())


def top_levels(levels: Column, k: int, side: str) -> Column:
    """The k best levels of a side out of an unordered level array."""
    ordered = F.array_sort(levels)
    return F.slice(F.reverse(ordered) if side == "bid" else ordered, 1, k)


def size_sum(levels: Column, n: int) -> Column:
    return F.aggregate(F.slice(levels, 1, n), F.lit(0.0), lambda acc, x: acc + x["size"])


def notional_sum(levels: Column, n: int) -> Column:
    return F.aggregate(F.slice(levels, 1, n), F.lit(0.0), lambda acc, x: acc + x["price"] * x["size"])


def slope(levels: Column, n: int) -> Column:
    """Mean size step per level from the first to the last of the top n levels."""
    k = F.least(F.size(levels), F.lit(n))
    step = F.element_at(levels, k)["size"] - F.element_at(levels, F.lit(1))["size"]
    return F.when(k >= 2, step / (k - 1).cast("double"))


def depth_features(bids: Column, asks: Column, max_depth: int = 20) -> dict[str, Column]:
    """All depth features for levels known down to `max_depth`; deeper ones are left out."""
    out: dict[str, Column] = {}
    for n in IMBALANCE_LEVELS:
        if n <= max_depth:
            b, a = size_sum(bids, n), size_sum(asks, n)
            out[f"depth_top{n}_imbalance"] = imbalance(b, a)
            out[f"cum_bid_depth_top{n}"] = b
            out[f"cum_ask_depth_top{n}"] = a
    for n in SLOPE_LEVELS:
        if n <= max_depth:
            out[f"bid_depth_slope_top{n}"] = slope(bids, n)
            out[f"ask_depth_slope_top{n}"] = slope(asks, n)
    for n in NOTIONAL_LEVELS:
        if n <= max_depth:
            out[f"near_touch_bid_notional_{n}"] = notional_sum(bids, n)
            out[f"near_touch_ask_notional_{n}"] = notional_sum(asks, n)
    return out


def top_of_book(bids: Column, asks: Column) -> dict[str, Column]:
    """Best prices, spread, mid, microprice and imbalance; null when a side is empty."""
    both = (F.size(bids) > 0) & (F.size(asks) > 0)
    b, a = F.get(bids, 0), F.get(asks, 0)
    bid, ask = F.when(both, b["price"]), F.when(both, a["price"])
    return {
        "best_bid": bid,
        "best_ask": ask,
        "best_bid_size": F.when(both, b["size"]),
        "best_ask_size": F.when(both, a["size"]),
        "spread": ask - bid,
        "midpoint": mid(bid, ask),
        "microprice": F.when(both, microprice(b["price"], b["size"], a["price"], a["size"])),
        "imbalance": F.when(both, imbalance(b["size"], a["size"])),
    }


def level_fallbacks() -> dict[str, Column]:
    """Top-N features of rows that may lack depth: top-1 or level counts stand in."""
    bid_levels = F.col("total_bid_levels").cast("double")
    ask_levels = F.col("total_ask_levels").cast("double")
    return {
        "top3_imbalance": F.coalesce("depth_top3_imbalance", "top1_imbalance"),
        "top5_imbalance": F.coalesce("depth_top5_imbalance", "top1_imbalance"),
        "top10_imbalance": F.coalesce("depth_top10_imbalance", "top1_imbalance"),
        "cum_bid_depth_topN_proxy": F.coalesce(F.col("cum_bid_depth_top10"), bid_levels),
        "cum_ask_depth_topN_proxy": F.coalesce(F.col("cum_ask_depth_top10"), ask_levels),
        "depth_level_imbalance_proxy": F.coalesce(F.col("depth_top10_imbalance"), bid_levels - ask_levels),
        "bid_depth_slope": F.col("bid_depth_slope_top10"),
        "ask_depth_slope": F.col("ask_depth_slope_top10"),
        "queue_depletion_proxy": F.lit(None).cast("double"),
    }
