"""Research tables: trade markouts and rank buckets of the book."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import NS_PER_SECOND
from tickloom.functions.prices import ratio, simple_return
from tickloom.operators.asof import Lookup, asof_lookups
from tickloom.operators.ranks import rank_bucket
from tickloom.session import cut_lineage
from tickloom.operators.slices import DEFAULT_SLICE_NS, RowFrame, previous_values, row_frames

# Markout horizons and the row window of the book volatility.
HORIZONS_S = [1, 3, 5, 10]
VOL_ROWS = 100


def trade_markouts(
    trades: DataFrame, book: DataFrame, horizons_s: Sequence[int] = HORIZONS_S, scale: int = 1, by: Sequence[str] = ("asset_id",)
) -> DataFrame:
    """Move of the asset's mid from the trade price, `h` seconds after the trade.

    The future mid is the first book row in `[t + h, t + 2h]`.
    """
    lookups = [
        Lookup(book, "recv_ns", {f"future_mid_{h}s": "midpoint"}, h * NS_PER_SECOND * scale, shift=-h * NS_PER_SECOND * scale, seq="seq")
        for h in horizons_s
    ]
    out = asof_lookups(trades, "recv_ns", lookups, by, direction="forward")
    cols = []
    for h in horizons_s:
        m = ratio(F.col(f"future_mid_{h}s") - F.col("price"), F.col("price"))
        cols += [m.alias(f"markout_{h}s"), (m * 10000).alias(f"markout_{h}s_bps")]
    return out.select("*", *cols)


def book_rank_buckets(book: DataFrame, n: int = 10) -> DataFrame:
    """Rank deciles of imbalance, spread and mid."""
    out = book
    for column, name in (("imbalance", "imbalance_bucket"), ("spread", "spread_bucket"), ("midpoint", "price_bucket")):
        if column in book.columns:
            out = rank_bucket(out, column, name, "q", n)
    return out


def row_volatility(
    book: DataFrame, rows: int = VOL_ROWS, name: str = "vol_100rows", slice_width: int = DEFAULT_SLICE_NS
) -> DataFrame:
    """Sample deviation of the last `rows` mid changes of each asset."""
    moved = previous_values(book, ["asset_id"], ["recv_ns", "seq"], {"__mid": "midpoint"}, slice_width)
    returns = moved.withColumn("__ret", simple_return(F.col("midpoint"), F.col("__mid"))).drop("__mid")
    framed = row_frames(
        returns, ["asset_id"], ["recv_ns", "seq"],
        [RowFrame(name, F.stddev_samp("__ret"), rows), RowFrame("__n", F.count("__ret"), rows)], slice_width,
    )
    return framed.withColumn(name, F.when(F.col("__n") >= rows, F.col(name))).drop("__ret", "__n")


def volatility_bucket(book: DataFrame, rows: int = VOL_ROWS, slice_width: int = DEFAULT_SLICE_NS) -> DataFrame:
    """Row volatility with its rank decile `v0..v9`.

    The volatility is checkpointed: finding the boundaries scans it several times.
    """
    vol = cut_lineage(row_volatility(book, rows, slice_width=slice_width))
    return rank_bucket(vol, "vol_100rows", "vol_bucket", "v", 10)
