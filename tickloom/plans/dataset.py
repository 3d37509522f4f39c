"""The training table: configuration, assembly, row and feature filters, metadata."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import NS_PER_MS, NS_PER_SECOND
from tickloom.operators.sampling import time_bucket_sample
from tickloom.operators.slices import DEFAULT_SLICE_NS, null_safe_join
from tickloom.plans import features, labels
from tickloom.session import cut_lineage, drop_written


# The defaults of all parameters below.
@dataclass(frozen=True)
class Sampling:
    """Last row of every `every_ms`, or all rows of a book that is cut down to its events already."""

    every_ms: int = 100
    by_events: bool = False
    features_from_samples: bool = False


@dataclass(frozen=True)
class Targets:
    """Label horizons in seconds, the one that models learn, and where its classes begin."""

    horizons: tuple[int, ...] = (1, 3, 5, 10)
    main: int = 10
    move_bps: float = 5.0
    entry_bps: float = 8.0
    entry_price: float = 0.04


@dataclass(frozen=True)
class SecondLeg:
    """The maker quote on the other side: price of both legs, and which trades prove it filled."""

    both_legs: float = 0.96
    edge_if_unfilled: float = -1.0
    proving_side: str = "SELL"
    delay_ms: int = 250
    ticks_through: float = 1.0
    first_leg_ms: int = 0


@dataclass(frozen=True)
class Costs:
    fee: float = 0.072
    buffer: float = 0.01
    taker_bps: float = 0.0
    slippage_bps: float = 2.0
    margin_bps: float = 1.0


@dataclass(frozen=True)
class TablePlan:
    """Parameters of the training table. `scale` stretches every duration, `reach_ms` is how far lookups see."""

    sampling: Sampling = field(default_factory=Sampling)
    targets: Targets = field(default_factory=Targets)
    second_leg: SecondLeg = field(default_factory=SecondLeg)
    costs: Costs = field(default_factory=Costs)
    reach_ms: int = 500
    own_prefix: str = ""
    ref_prefix: str = "ref_"
    scale: int = 1
    slice_ns: int = DEFAULT_SLICE_NS


# Names that are never model features. Anything that looks ahead must be
# caught by one of these.
LABEL_PREFIXES = (
    "y_",
    "future_mid_",
    "future_best_bid_",
    "future_best_ask_",
    "markout_",
    "strategy_entry_edge_",
    "future_opposite_maker_fill_",
    "two_leg_",
    "first_unwind_loss_proxy_",
    "first_unwind_profit_proxy_",
    "final_profit_",
)
NOT_FEATURES = {
    "recv_ns",
    "seq",
    "exchange_ts",
    "market_id",
    "asset_id",
    "symbol",
    "market",
    "source",
    "condition_id",
    "slug",
    "outcome",
    "period",
    "start_ns",
    "question",
    "expiry_ns",
    "opposite_asset_id",
    "realized_edge_after_entry_cost_bps",
}
BUCKET_FEATURES = ["imbalance_bucket", "spread_bucket", "price_bucket", "vol_bucket"]


def column_role(column: T.StructField) -> str:
    """What a column of the training table is: bucket, key, label, number or other."""
    if column.name in BUCKET_FEATURES:
        return "bucket"
    if column.name in NOT_FEATURES or column.name.startswith("date"):
        return "key"
    if column.name.startswith(LABEL_PREFIXES):
        return "label"
    fractional_or_whole = isinstance(column.dataType, (T.FractionalType, T.IntegralType)) and not isinstance(column.dataType, T.DecimalType)
    return "number" if fractional_or_whole else "other"


def feature_columns(schema: T.StructType) -> list[str]:
    """The numbers of a training table in their order, then its buckets."""
    by_role: dict[str, list[str]] = {}
    for column in schema:
        by_role.setdefault(column_role(column), []).append(column.name)
    buckets = by_role.get("bucket", [])
    return by_role.get("number", []) + [c for c in BUCKET_FEATURES if c in buckets]


def label_columns(schema: T.StructType) -> list[str]:
    return [c for c in schema.names if c.startswith(LABEL_PREFIXES)]


def build_feature_table(
    book: DataFrame,
    trades: DataFrame | None = None,
    ref_book: DataFrame | None = None,
    ref_trades: DataFrame | None = None,
    research: DataFrame | None = None,
    plan: TablePlan | None = None,
) -> DataFrame:
    """Canonical inputs to the labelled feature table, all markets and dates in one plan.

    The sampled book and the table after each step that shuffles whole rows are written to the
    shared folder on the way: no step is repeated, and only one holds its shuffle files at a time.
    A table goes when the next one is written. What looks ahead is computed on the few columns it needs and joined by row.
    """
    c = plan or TablePlan()
    tolerance = c.reach_ms * NS_PER_MS * c.scale
    if c.sampling.by_events:
        samples = book
    else:
        samples = time_bucket_sample(book, features.ASSET, features.ORDER, c.sampling.every_ms * NS_PER_MS * c.scale)
        samples = cut_lineage(samples, "samples")

    def step(df: DataFrame, purpose: str, *before: DataFrame) -> DataFrame:
        table = cut_lineage(df, purpose)
        drop_written(*before)
        return table

    source = samples if c.sampling.features_from_samples else book
    events = features.book_event_features(source, c.scale, c.slice_ns)
    own_trades = features.trade_features(trades, c.own_prefix, c.scale, c.slice_ns) if trades is not None else None

    df = features.add_level_features(samples)
    df = features.add_event_and_trade_features(
        df, events, own_trades, c.own_prefix, features.EVENT_TOLERANCE_MS * NS_PER_MS * c.scale
    )
    if trades is None:
        df = features.empty_trade_features(df, c.own_prefix)
    df = step(df, "own-features")
    df = step(features.add_reference_features(df, ref_book, ref_trades, c.ref_prefix, tolerance, c.scale, c.slice_ns), "reference", df)
    df = step(features.own_returns(df, c.own_prefix, c.ref_prefix, c.scale), "features", df)
    means: list[DataFrame] = []
    smoothed = features.add_smoothed(df, c.ref_prefix, c.slice_ns, means)
    df = step(smoothed, "smoothed", df, *means)
    df = features.add_buckets(df, research, tolerance)

    target, leg, costs = c.targets, c.second_leg, c.costs
    h = target.main
    ids = [*features.ASSET, *features.ORDER]
    narrow = samples.select(*ids, "outcome", "best_ask", "current_mid", *[x for x in ("tick_size",) if x in samples.columns])
    ahead = step(features.future_book(narrow, book, list(target.horizons), tolerance, c.scale), "future")
    fills = labels.two_leg_fill(
        ahead, trades, h, leg.both_legs, leg.edge_if_unfilled, leg.proving_side, leg.delay_ms, leg.ticks_through, leg.first_leg_ms, costs.buffer, c.scale
    )
    fills = labels.first_leg_fill(fills, leg.first_leg_ms or 350, costs.buffer, c.scale)
    fills = step(fills.drop("outcome", "best_ask", "current_mid", "tick_size"), "fills", ahead, *([] if c.sampling.by_events else [samples]))
    df = null_safe_join(df, fills, ids)
    df = labels.alpha_labels(df, h, target.move_bps, target.entry_bps)
    df = labels.net_edge(df, h, costs.taker_bps, costs.slippage_bps, costs.margin_bps)
    df = labels.strategy_entry(df, h, target.entry_price)

    last = [x for x in fills.columns if x not in ahead.columns]
    df = df.select(*[x for x in df.columns if x not in last], *last)
    return labels.final_profit(df, h, costs.fee, costs.buffer, leg.both_legs)


def training_rows(df: DataFrame, h: int = 10, scale: int = 1) -> DataFrame:
    """Rows with all required labels whose horizon ends before the market does."""
    required = ["current_mid", f"future_mid_{h}s", f"markout_{h}s_bps", f"y_reg_{h}s", f"y_cls_{h}s"]
    out = df.dropna(subset=[c for c in required if c in df.columns])
    if "expiry_ns" in df.columns:
        ends = F.col("recv_ns") + F.lit(h * NS_PER_SECOND * scale)
        out = out.where(F.col("expiry_ns").isNull() | (ends <= F.col("expiry_ns")))
    return out


def null_fractions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, null_fraction) of every column from one aggregate over the table."""
    fractions = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).isNull().cast("double")).alias("null_fraction")) for c in columns]
    )
    return df.agg(fractions.alias("rs")).select(F.explode("rs").alias("r")).select("r.*")


def prune_features(df: DataFrame, max_null_fraction: float = 0.35) -> DataFrame:
    """Without the features that are null too often."""
    names = feature_columns(df.schema)
    sparse = {r["feature"] for r in null_fractions(df, names).where(F.col("null_fraction") > max_null_fraction).collect()}
    return df.drop(*sparse)


def dataset_quality(df: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Rows per date with status `ok`, or `empty` for requested dates without rows."""
    counts = df.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))
    dates = counts.select("date") if requested is None else requested.select("date").unionByName(counts.select("date")).distinct()
    rows = F.coalesce("rows", F.lit(0).cast("long"))
    return dates.join(counts, "date", "left").select("date", rows.alias("rows"), F.when(rows > 0, "ok").otherwise("empty").alias("status"))


def dataset_metadata(
    df: DataFrame, plan: TablePlan, tables: DataFrame | None = None, quality: DataFrame | None = None
) -> DataFrame:
    """One row describing the data set; config, table report and quality as JSON."""
    extent = df.agg(F.count(F.lit(1)).alias("rows"), F.min("recv_ns").alias("start_ns"), F.max("recv_ns").alias("end_ns"))

    def report(table: DataFrame | None):
        return F.lit("[]" if table is None else json.dumps([r.asDict() for r in table.collect()], default=str))

    return extent.select(
        "*",
        F.lit(json.dumps(asdict(plan), sort_keys=True)).alias("config"),
        F.array(*[F.lit(c) for c in feature_columns(df.schema)]).alias("feature_columns"),
        F.array(*[F.lit(c) for c in label_columns(df.schema)]).alias("label_columns"),
        F.lit(plan.sampling.every_ms).alias("sampling_interval_ms"),
        report(tables).alias("input_tables"),
        report(quality).alias("data_quality"),
    )


def label_export(df: DataFrame) -> DataFrame:
    """Ids, time, current mid and the labels a model is trained on."""
    ids = ["date", "market_id", "asset_id", "recv_ns", "seq", "symbol", "current_mid"]
    kept = [c for c in df.columns if c.startswith(("future_mid_", "markout_", "y_"))]
    return df.select(*[c for c in ids if c in df.columns], *kept)
