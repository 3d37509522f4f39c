"""Canonical table schemas and the helper that makes a frame conform to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.depth import DEPTH_COLUMNS

_INSTRUMENT = (
    "source string, asset_id string, market string, market_id string, condition_id string, slug string, "
    "outcome string, symbol string, period string, expiry_ns long, tick_size double, min_order_size double, "
    "maker_base_fee double, taker_base_fee double"
)
_DEPTH = ", ".join(f"{c} double" for c in DEPTH_COLUMNS)


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


# Column names and types of the canonical tables. `seq` is the ingest
# order and breaks ties between rows of one receive time.
DDL = {
    "book": f"{_INSTRUMENT}, recv_ns long, exchange_ts long, best_bid double, best_ask double, spread double, "
    f"midpoint double, microprice double, imbalance double, total_bid_levels int, total_ask_levels int, {_DEPTH}, seq long",
    "trades": f"{_INSTRUMENT}, recv_ns long, exchange_ts long, price double, size double, side string, "
    "fee_rate_bps double, seq long",
    "quotes": f"{_INSTRUMENT}, recv_ns long, exchange_ts long, best_bid double, best_ask double, spread double, seq long",
    "own_orders": "order_id string, market string, asset_id string, side string, price double, original_size double, "
    "size_matched double, order_type string, recv_ns long, exchange_ts long, seq long",
    "own_trades": "trade_id string, market string, asset_id string, side string, price double, size double, "
    "status string, recv_ns long, exchange_ts long, seq long",
    "instruments": "asset_id string, outcome string, outcome_index int, market_id string, condition_id string, "
    "slug string, symbol string, period string, question string, outcomes string, clob_token_ids string, "
    "active boolean, closed boolean, accepting_orders boolean, start_date string, end_date string, start_ns long, "
    "expiry_ns long, tick_size double, min_order_size double, maker_base_fee double, taker_base_fee double, "
    "volume double, volume_24h double, liquidity double, best_bid_snapshot double, best_ask_snapshot double, "
    "spread_snapshot double, updated_at string",
}


def schema_of(table: str) -> T.StructType:
    return _schema(DDL[table])


def conform(df: DataFrame, table: str, keep_extra: bool = True) -> DataFrame:
    """Add missing columns as typed nulls and cast the others; extra columns stay."""
    schema = schema_of(table)
    wanted = [
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema
    ]
    names = {f.name for f in schema}
    extra = [F.col(c) for c in df.columns if c not in names] if keep_extra else []
    return df.select(*wanted, *extra)
