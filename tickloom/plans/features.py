"""Feature groups of the training table, each as few shuffles as its keys allow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import NS_PER_MS, NS_PER_SECOND
from tickloom.functions import buckets
from tickloom.functions.depth import DEPTH_COLUMNS, level_fallbacks
from tickloom.functions.prices import GUARD, ratio, simple_return
from tickloom.operators.asof import Lookup, asof_adaptive, asof_lookups, shifted_lookups
from tickloom.operators.ewma import ewma
from tickloom.operators.slices import DEFAULT_BLOCK_ROWS, DEFAULT_SLICE_NS, Frame, RowFrame, previous_values, range_frames, row_frames
from tickloom.operators.sliding import RowRank, Trailing, row_frames_and_ranks, trailing_frames

ASSET = ["market_id", "asset_id"]
ORDER = ["recv_ns", "seq"]

# Window lengths, return offsets and smoothing spans of the features.
REFERENCE_OFFSETS_MS = [100, 250, 500, 1000, 3000, 5000]
OWN_OFFSETS = {"500ms": 500, "1s": 1000, "3s": 3000}
LEAD_LAG = {
    "lead_lag_ref_minus_own_500ms": ("500ms", "500ms"),
    "lead_lag_ref_minus_own_1s": ("1000ms", "1s"),
    "lead_lag_3s": ("3000ms", "3s"),
}
EWMA_SPANS = {"fast": 5, "slow": 20}
EVENT_TOLERANCE_MS = 1000
TRADE_RUN = 10
SWEEP_ROWS = 100
REFERENCE_TRADE_ROWS = 20

BOOK_EVENT_FEATURES = [
    "book_update_count_100ms", "book_update_count_500ms", "book_update_count_1s",
    "spread_widen_count_recent", "spread_narrow_count_recent", "realized_vol_short",
]


def add_level_features(samples: DataFrame) -> DataFrame:
    return samples.select("*", *[c.alias(n) for n, c in level_fallbacks().items()])


def book_event_features(
    book: DataFrame, scale: int = 1, slice_width: int = DEFAULT_SLICE_NS
) -> DataFrame:
    """Trailing update counts, spread moves and volatility per book event.

    `scale` multiplies every window length (for data with a coarser clock).
    """
    moves = previous_values(
        book.select(*ASSET, *ORDER, "current_spread", "current_mid"), ASSET, ORDER,
        {"__spread": "current_spread", "__mid": "current_mid"}, slice_width,
    )
    delta = F.col("current_spread") - F.col("__spread")
    moves = moves.select(
        *ASSET, *ORDER, (delta > 0).alias("__wider"), (delta < 0).alias("__narrower"),
        simple_return(F.col("current_mid"), F.col("__mid")).alias("__ret"),
    )
    ms, second = NS_PER_MS * scale, NS_PER_SECOND * scale
    return trailing_frames(
        moves, ASSET, "recv_ns",
        [
            Trailing("book_update_count_100ms", "count", 100 * ms),
            Trailing("book_update_count_500ms", "count", 500 * ms),
            Trailing("book_update_count_1s", "count", second),
            Trailing("spread_widen_count_recent", "count", second, "__wider"),
            Trailing("spread_narrow_count_recent", "count", second, "__narrower"),
            Trailing("realized_vol_short", "stddev", 3 * second, "__ret"),
        ],
    ).drop("__wider", "__narrower", "__ret")


def fast_update_flag(book: DataFrame, gap_ns: int = 100 * NS_PER_MS, slice_width: int = DEFAULT_SLICE_NS) -> DataFrame:
    """1 where the row follows the asset's previous row within `gap_ns`, else 0."""
    prev = previous_values(book, ASSET, ORDER, {"__t": "recv_ns"}, slice_width)
    fast = F.coalesce(F.col("recv_ns") - F.col("__t") <= F.lit(gap_ns), F.lit(False))
    return prev.withColumn("fast_update", fast.cast("tinyint")).drop("__t")


def trade_features(
    trades: DataFrame,
    prefix: str = "",
    scale: int = 1,
    slice_width: int = DEFAULT_SLICE_NS,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Trailing trade activity per trade: counts, signed volume, VWAP, runs and sweeps."""
    ms, second = NS_PER_MS * scale, NS_PER_SECOND * scale
    buy, sell = F.col("signed_side") > 0, F.col("signed_side") < 0
    size = F.col("size")
    base = trades.select(
        *ASSET, *ORDER, "size", "signed_side",
        (size * buy.cast("double")).alias("__buys"), (size * sell.cast("double")).alias("__sells"),
        (size * F.col("signed_side")).alias("__signed"), (F.col("price") * size).alias("__worth"),
    )
    timed = trailing_frames(
        base, ASSET, "recv_ns",
        [
            Trailing(f"{prefix}trade_count_100ms", "count", 100 * ms),
            Trailing(f"{prefix}trade_count_500ms", "count", 500 * ms),
            Trailing(f"{prefix}trade_count_1s", "count", second),
            Trailing(f"{prefix}aggressive_buy_volume_1s", "sum", second, "__buys"),
            Trailing(f"{prefix}aggressive_sell_volume_1s", "sum", second, "__sells"),
            Trailing(f"{prefix}signed_volume_1s", "sum", second, "__signed"),
            Trailing("__notional", "sum", second, "__worth"),
            Trailing("__size", "sum", second, "size"),
        ],
    )
    counted = row_frames_and_ranks(
        timed, ASSET, ORDER,
        [
            RowFrame(f"{prefix}consecutive_buy_trade_run_proxy", F.count_if(buy), TRADE_RUN),
            RowFrame(f"{prefix}consecutive_sell_trade_run_proxy", F.count_if(sell), TRADE_RUN),
        ],
        [RowRank("__smaller", "__known", "size", SWEEP_ROWS)],
        slice_width, block_rows,
    )
    # above the 95 % quantile of 100 values by the nearest-rank rule (index round(0.95 * 99) = 94): 95 are smaller
    place = round(0.95 * (SWEEP_ROWS - 1)) + 1
    sweep = F.when(F.col("__known") >= place, F.col("__smaller") >= place)
    buys, sells = F.col(f"{prefix}aggressive_buy_volume_1s"), F.col(f"{prefix}aggressive_sell_volume_1s")
    signed = F.col(f"{prefix}signed_volume_1s")
    return counted.select(
        *ASSET, *ORDER,
        *[F.col(f"{prefix}trade_count_{w}").cast("double").alias(f"{prefix}trade_count_{w}") for w in ("100ms", "500ms", "1s")],
        F.col(f"{prefix}trade_count_1s").cast("double").alias(f"{prefix}trade_count_recent"),
        buys, sells, signed,
        buys.alias(f"{prefix}aggressive_buy_volume_recent"),
        sells.alias(f"{prefix}aggressive_sell_volume_recent"),
        signed.alias(f"{prefix}signed_volume_recent"),
        (signed / (buys + sells + F.lit(GUARD))).alias(f"{prefix}signed_volume_imbalance_recent"),
        (F.col("__notional") / (F.col("__size") + F.lit(GUARD))).alias(f"{prefix}recent_vwap"),
        sweep.cast("tinyint").alias(f"{prefix}sweep_indicator_proxy"),
        f"{prefix}consecutive_buy_trade_run_proxy",
        f"{prefix}consecutive_sell_trade_run_proxy",
    )


def add_event_and_trade_features(
    samples: DataFrame,
    events: DataFrame,
    trades: DataFrame | None,
    prefix: str = "",
    tolerance_ns: int = EVENT_TOLERANCE_MS * NS_PER_MS,
) -> DataFrame:
    """Attach both feature tables in one as-of pass over the samples."""
    lookups = [Lookup(events, "recv_ns", {c: c for c in BOOK_EVENT_FEATURES}, tolerance_ns, seq="seq")]
    if trades is not None:
        names = [c for c in trades.columns if c not in (*ASSET, *ORDER)]
        lookups.append(Lookup(trades, "recv_ns", {c: c for c in names}, tolerance_ns, seq="seq"))
    out = asof_lookups(samples, "recv_ns", lookups, ASSET)
    if trades is None:
        return out
    return out.withColumn(f"{prefix}recent_vwap_deviation", F.col(f"{prefix}recent_vwap") - F.col("current_mid"))


def empty_trade_features(samples: DataFrame, prefix: str = "") -> DataFrame:
    """What the trade features are on a day without trades: zero activity, no VWAP."""
    zero = [
        "trade_count_100ms", "trade_count_500ms", "trade_count_1s", "trade_count_recent",
        "aggressive_buy_volume_1s", "aggressive_sell_volume_1s", "signed_volume_1s",
        "aggressive_buy_volume_recent", "aggressive_sell_volume_recent", "signed_volume_recent",
        "signed_volume_imbalance_recent",
    ]
    flags = ["sweep_indicator_proxy", "consecutive_buy_trade_run_proxy", "consecutive_sell_trade_run_proxy"]
    return samples.select(
        "*",
        *[F.lit(0.0).alias(prefix + c) for c in zero],
        *[F.lit(None).cast("double").alias(prefix + c) for c in ("recent_vwap", "recent_vwap_deviation")],
        *[F.lit(0).alias(prefix + c) for c in flags],
    )


def reference_trade_imbalance(
    trades: DataFrame, name: str = "ref_recent_trade_imbalance", slice_width: int = DEFAULT_SLICE_NS
) -> DataFrame:
    """Signed share of volume over the last 20 reference trades of each symbol."""
    framed = row_frames(
        trades.select("symbol", *ORDER, "size", "signed_side"), ["symbol"], ORDER,
        [
            RowFrame("__signed", F.sum(F.col("size") * F.col("signed_side")), REFERENCE_TRADE_ROWS),
            RowFrame("__volume", F.sum("size"), REFERENCE_TRADE_ROWS),
        ],
        slice_width,
    )
    return framed.select("symbol", *ORDER, (F.col("__signed") / (F.col("__volume") + F.lit(GUARD))).alias(name))


def add_reference_features(
    samples: DataFrame,
    book: DataFrame | None,
    trades: DataFrame | None,
    prefix: str = "ref_",
    tolerance_ns: int = 500 * NS_PER_MS,
    scale: int = 1,
    slice_width: int = DEFAULT_SLICE_NS,
    keyed: bool = True,
) -> DataFrame:
    """State, age and past returns of the reference feed at each sample.

    The current state and the six past mids are seven lookups of one as-of pass, by symbol
    unless `keyed` is false.
    """
    state = [f"{prefix}mid", f"{prefix}spread", f"{prefix}book_imbalance", *[f"{prefix}{c}" for c in DEPTH_COLUMNS]]
    labels = {f"{ms}ms": ms * NS_PER_MS * scale for ms in REFERENCE_OFFSETS_MS}
    if book is None:
        names = [*state, f"{prefix}asset_id", f"{prefix}age_ms", *[f"{prefix}return_{k}" for k in labels]]
        out = samples.select("*", *[F.lit(None).cast("double").alias(n) for n in names if n != f"{prefix}asset_id"])
    else:
        feed = book.withColumnRenamed(f"{prefix}symbol", "__symbol")
        columns = {c: c for c in [f"{prefix}asset_id", *state] if c in feed.columns}
        lookups = [Lookup(feed, "recv_ns", columns, tolerance_ns, seq="seq", matched_at="__ref_ns")]
        lookups += shifted_lookups(
            feed, "recv_ns", f"{prefix}mid", {f"__past_{k}": v for k, v in labels.items()},
            {f"__past_{k}": min(v // 2, 500 * NS_PER_MS * scale) for k, v in labels.items()}, seq="seq",
        )
        out = asof_adaptive(samples, "recv_ns", lookups, "symbol", "__symbol", keyed)
        out = out.select(
            *[c for c in out.columns if not c.startswith("__")],
            ((F.col("recv_ns") - F.col("__ref_ns")) / F.lit(NS_PER_MS)).alias(f"{prefix}age_ms"),
            *[simple_return(F.col(f"{prefix}mid"), F.col(f"__past_{k}")).alias(f"{prefix}return_{k}") for k in labels],
        )
    imbalance = f"{prefix}recent_trade_imbalance"
    if trades is None:
        return out.withColumn(imbalance, F.lit(None).cast("double"))
    table = reference_trade_imbalance(trades, imbalance, min(slice_width, max(1, tolerance_ns)))
    lookup = Lookup(table, "recv_ns", {imbalance: imbalance}, tolerance_ns, seq="seq")
    return asof_adaptive(out, "recv_ns", [lookup], "symbol", "symbol", keyed)


def own_returns(samples: DataFrame, prefix: str = "", ref_prefix: str = "ref_", scale: int = 1) -> DataFrame:
    """Own-mid returns over fixed offsets and their lag behind the reference feed.

    The past mid is the last one between two and one offsets ago: a RANGE frame over the
    samples themselves, without a join.
    """
    place = F.struct(*[F.col(c) for c in ORDER])
    frames = [
        Frame(f"__own_{k}", F.max_by("current_mid", place), -2 * ms * NS_PER_MS * scale, -ms * NS_PER_MS * scale)
        for k, ms in OWN_OFFSETS.items()
    ]
    out = range_frames(samples, ASSET, "recv_ns", frames)
    for k in OWN_OFFSETS:
        out = out.withColumn(f"{prefix}return_{k}", simple_return(F.col("current_mid"), F.col(f"__own_{k}"))).drop(f"__own_{k}")
    for name, (ref, own) in LEAD_LAG.items():
        if f"{ref_prefix}return_{ref}" in out.columns:
            out = out.withColumn(name, F.col(f"{ref_prefix}return_{ref}") - F.col(f"{prefix}return_{own}"))
    return out


def add_smoothed(samples: DataFrame, ref_prefix: str = "ref_", slice_width: int = DEFAULT_SLICE_NS, written: list | None = None) -> DataFrame:
    """Fast and slow EWMA, and their difference, of the noisy features present."""
    sources = ["realized_vol_short", "depth_top10_imbalance", f"{ref_prefix}return_1000ms", f"{ref_prefix}return_3000ms"]
    present = [c for c in sources if c in samples.columns]
    return ewma(samples, ASSET, ORDER, present, EWMA_SPANS, slice_width, written) if present else samples


def add_buckets(
    samples: DataFrame, research: DataFrame | None = None, tolerance_ns: int = 500 * NS_PER_MS
) -> DataFrame:
    """Research buckets by as-of where given, threshold codes for those still missing."""
    out = samples
    if research is not None:
        names = [c for c in ("imbalance_bucket", "spread_bucket", "price_bucket", "vol_bucket", "vol_60s") if c in research.columns]
        if names:
            lookup = Lookup(research, "recv_ns", {c: c for c in names}, tolerance_ns, seq="seq" if "seq" in research.columns else None)
            out = asof_lookups(samples.drop(*names), "recv_ns", [lookup], ASSET)
    codes = {
        "imbalance_bucket": buckets.imbalance_code(F.col("top1_imbalance")),
        "spread_bucket": buckets.spread_code(F.col("current_spread"), F.col("current_mid")),
        "price_bucket": buckets.price_code(F.col("current_mid")),
        "vol_bucket": buckets.volatility_code(F.col("realized_vol_short")),
    }
    return out.select("*", *[c.alias(n) for n, c in codes.items() if n not in out.columns])


def future_book(
    samples: DataFrame, book: DataFrame, horizons_s: list[int], tolerance_ns: int, scale: int = 1
) -> DataFrame:
    """Mid, bid and ask at the first book row in `[t + h, t + h + tolerance]`, with markouts.

    All horizons are lookups of one forward as-of pass.
    """
    lookups = [
        Lookup(
            book, "recv_ns",
            {f"future_mid_{h}s": "current_mid", f"future_best_bid_{h}s": "best_bid", f"future_best_ask_{h}s": "best_ask"},
            tolerance_ns, shift=-h * NS_PER_SECOND * scale, seq="seq",
        )
        for h in horizons_s
    ]
    out = asof_lookups(samples, "recv_ns", lookups, ASSET, direction="forward")
    markouts = []
    for h in horizons_s:
        m = ratio(F.col(f"future_mid_{h}s") - F.col("current_mid"), F.col("current_mid"))
        markouts += [m.alias(f"markout_{h}s"), (m * 10000).alias(f"markout_{h}s_bps")]
    return out.select("*", *markouts)
