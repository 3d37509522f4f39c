"""Forward-looking labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import NS_PER_MS, NS_PER_SECOND
from tickloom.functions import prices
from tickloom.operators.combine import with_opposite
from tickloom.operators.intervals import forward_interval_min
from tickloom.operators.slices import DEFAULT_SLICE_NS, Frame, int_div, previous_values, range_frames


def alpha_labels(samples: DataFrame, h: int = 10, theta_bps: float = 5.0, entry_bps: float = 8.0) -> DataFrame:
    """Markout as target, its direction, whether it pays an entry, and the mid change."""
    markout = f"markout_{h}s_bps"
    if markout not in samples.columns:
        raise ValueError(f"missing required markout column: {markout}")
    m = F.col(markout)
    return samples.select(
        "*",
        m.alias(f"y_reg_{h}s"),
        F.when(m > theta_bps, "up").when(m < -theta_bps, "down").otherwise("neutral").alias(f"y_cls_{h}s"),
        (m > entry_bps).cast("tinyint").alias("y_entry"),
        (F.col(f"future_mid_{h}s") - F.col("current_mid")).alias(f"future_mid_delta_{h}s"),
    )


def net_edge(
    samples: DataFrame, h: int = 10, taker_bps: float = 0.0, slippage_bps: float = 2.0, safety_bps: float = 1.0
) -> DataFrame:
    """What is left of the target after the cost of an entry."""
    cost = taker_bps + slippage_bps + safety_bps
    y = F.col(f"y_reg_{h}s")
    return samples.select(
        "*",
        (y - F.lit(cost)).alias("realized_edge_after_entry_cost_bps"),
        (y > cost).cast("tinyint").alias("y_entry_after_cost"),
    )


def strategy_entry(samples: DataFrame, h: int = 10, threshold: float = 0.04) -> DataFrame:
    """Entry at the ask judged by the absolute price edge."""
    edge = F.col(f"future_mid_{h}s") - F.col("best_ask")
    good = edge >= F.lit(threshold)
    return samples.select(
        "*",
        edge.alias(f"strategy_entry_edge_{h}s"),
        (edge - F.lit(threshold)).alias(f"strategy_entry_edge_after_threshold_{h}s"),
        F.when(edge.isNotNull(), F.when(good, "enter").otherwise("skip")).alias(f"y_strategy_entry_{h}s"),
        good.cast("tinyint").alias(f"y_strategy_entry_binary_{h}s"),
    )


def two_leg_fill(
    samples: DataFrame,
    trades: DataFrame | None,
    h: int = 10,
    max_total: float = prices.MAX_TOTAL_PRICE,
    no_fill_edge: float = -1.0,
    side: str = "SELL",
    latency_ms: int = 250,
    through_ticks: float = 1.0,
    validation_ms: int = 0,
    buffer: float = prices.PRICE_BUFFER,
    scale: int = 1,
    pick: str = "min",
) -> DataFrame:
    """Whether a taker first leg is completed by a maker fill on the opposite asset.

    The second leg is a maker quote at `max_total - best_ask`. Evidence for a fill is a
    trade of `side` on the opposite asset between latency and horizon at or below the
    quote less `through_ticks` ticks. `pick="min"` reports the lowest such price,
    `pick="first"` the first one (the rule of the online monitor); both decide alike.
    """
    paired = with_opposite(samples)
    tick = prices.tick_or_default(F.col("tick_size")) if "tick_size" in samples.columns else F.lit(prices.TICK_FALLBACK)
    threshold = (F.lit(max_total) - F.col("best_ask")) - F.lit(through_ticks) * tick + F.lit(prices.FILL_EPSILON)
    lo = max(0, latency_ms) * NS_PER_MS * scale
    hi = max(lo, h * NS_PER_SECOND * scale)
    ids = ["market_id", "asset_id", "recv_ns", "seq"]
    if trades is None:
        found = paired.withColumn("__price", F.lit(None).cast("double")).withColumn("__time", F.lit(None).cast("long"))
    else:
        evidence = trades.where((F.upper("side") == side.upper()) & F.col("price").isNotNull())
        if pick == "min":
            found = forward_interval_min(
                paired, evidence, "opposite_asset_id", "asset_id", "recv_ns", "recv_ns", ids, "price", lo, hi, "__price", "__time"
            )
        else:
            found = _first_fill(paired.withColumn("__limit", threshold), evidence, lo, hi, ids)
    fills = F.col("__price") <= threshold
    price = F.when(fills, F.col("__price"))
    total = F.col("best_ask") + price
    edge = F.lit(max_total) - total
    enter = F.coalesce(edge >= 0, F.lit(False))
    out = found.select(
        *[c for c in found.columns if not c.startswith("__")],
        price.alias(f"future_opposite_maker_fill_price_{h}s"),
        F.when(fills, F.col("__time")).alias(f"future_opposite_maker_fill_recv_ns_{h}s"),
        total.alias(f"two_leg_total_price_{h}s"),
        edge.alias(f"two_leg_edge_{h}s"),
        F.coalesce(edge, F.lit(no_fill_edge)).alias(f"two_leg_realized_edge_{h}s"),
        F.when(enter, "enter").otherwise("skip").alias(f"y_two_leg_entry_{h}s"),
        enter.cast("tinyint").alias(f"y_two_leg_entry_binary_{h}s"),
    )
    return next_row_validation(out, h, validation_ms, buffer, scale) if validation_ms > 0 else out


def _first_fill(paired: DataFrame, evidence: DataFrame, lo: int, hi: int, ids: list[str]) -> DataFrame:
    """Earliest qualifying trade: an equi-join on asset and time block, then the minimum."""
    width = hi - lo + 1
    start = F.col("recv_ns") + F.lit(lo)
    queries = paired.where(F.col("opposite_asset_id").isNotNull()).select(
        *ids, "__limit", F.col("opposite_asset_id").alias("__asset"), start.alias("__start"),
        F.explode(F.array(int_div(start, width), int_div(start, width) + 1)).alias("__block"),
    )
    events = evidence.select(
        F.col("asset_id").alias("__asset"), F.col("recv_ns").alias("__time"), F.col("price").alias("__price"),
        int_div(F.col("recv_ns"), width).alias("__block"),
    )
    hits = (
        queries.join(events, ["__asset", "__block"])
        .where((F.col("__time") >= F.col("__start")) & (F.col("__time") < F.col("__start") + F.lit(width)))
        .where(F.col("__price") <= F.col("__limit"))
        .groupBy(*ids)
        .agg(F.min(F.struct("__time", "__price")).alias("__hit"))
        .select(*ids, F.col("__hit.__price").alias("__price"), F.col("__hit.__time").alias("__time"))
    )
    return paired.join(hits, ids, "left")


def next_row_validation(
    samples: DataFrame,
    h: int = 10,
    validation_ms: int = 350,
    buffer: float = prices.PRICE_BUFFER,
    scale: int = 1,
    slice_width: int = DEFAULT_SLICE_NS,
) -> DataFrame:
    """Turn an entry into a skip when the asset's next row, if soon enough, asks too much."""
    # the next row is the previous one of the reversed order
    mirrored = samples.withColumn("__neg_ns", -F.col("recv_ns")).withColumn("__neg_seq", -F.col("seq"))
    ahead = previous_values(
        mirrored, ["asset_id"], ["__neg_ns", "__neg_seq"], {"__next_ns": "recv_ns", "__next_ask": "best_ask"}, slice_width
    )
    soon = F.col("__next_ns") - F.col("recv_ns") <= F.lit(validation_ms * NS_PER_MS * scale)
    worse = F.coalesce(soon & (F.col("__next_ask") > F.col("best_ask") + F.lit(buffer)), F.lit(False))
    cls, binary = f"y_two_leg_entry_{h}s", f"y_two_leg_entry_binary_{h}s"
    return (
        ahead.withColumn(cls, F.when(worse, "skip").otherwise(F.col(cls)))
        .withColumn(binary, F.when(worse, F.lit(0).cast("tinyint")).otherwise(F.col(binary)))
        .drop("__neg_ns", "__neg_seq", "__next_ns", "__next_ask")
    )


def first_leg_fill(
    samples: DataFrame, validation_ms: int = 350, buffer: float = prices.PRICE_BUFFER, scale: int = 1
) -> DataFrame:
    """0 if the asset's ask rises above entry ask + buffer inside the window, else 1.

    Rows of the same instant are part of the window; a null ask gives null.
    """
    frame = Frame("__worst", F.max("best_ask"), 0, validation_ms * NS_PER_MS * scale)
    framed = range_frames(samples, ["asset_id"], "recv_ns", [frame])
    label = F.when(F.col("__worst") > F.col("best_ask") + F.lit(buffer), 0).otherwise(1)
    return framed.withColumn("y_first_leg_fill", F.when(F.col("best_ask").isNotNull(), label).cast("tinyint")).drop("__worst")


def final_profit(
    samples: DataFrame,
    h: int = 10,
    fee_rate: float = prices.FEE_RATE,
    buffer: float = prices.PRICE_BUFFER,
    max_total: float = prices.MAX_TOTAL_PRICE,
) -> DataFrame:
    """Profit of the completed pair where it fills, else of selling the first leg again."""
    exit_col = f"future_best_bid_{h}s" if f"future_best_bid_{h}s" in samples.columns else f"future_mid_{h}s"
    ask = F.col("best_ask")
    unwind: Column = prices.unwind_profit(ask, F.col(exit_col), fee_rate, buffer)
    profit = F.when(
        F.col(f"y_two_leg_entry_{h}s") == "enter", prices.success_profit(ask, fee_rate, buffer, max_total)
    ).otherwise(unwind)
    name = f"final_profit_{h}s"
    return samples.select(
        "*",
        (-unwind).alias(f"first_unwind_loss_proxy_{h}s"),
        unwind.alias(f"first_unwind_profit_proxy_{h}s"),
        profit.alias(name),
    ).select(
        "*",
        F.when(F.col(name) > 0, "enter").otherwise("skip").alias(f"y_final_profit_entry_{h}s"),
        (F.col(name) > 0).cast("tinyint").alias(f"y_final_profit_entry_binary_{h}s"),
        F.greatest(F.abs(F.col(name)), F.when(F.col(name).isNotNull(), F.lit(1e-6))).alias(f"final_profit_weight_{h}s"),
    )
