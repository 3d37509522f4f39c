"""Price, return, fee and profit expressions shared by batch and streaming code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strategy defaults that decide labels and profits.
FEE_RATE = 0.072
PRICE_BUFFER = 0.01
MAX_TOTAL_PRICE = 0.96
CONSTANT_SUCCESS = 0.04
TICK_FALLBACK = 0.01
FILL_EPSILON = 1e-12
GUARD = 1e-12


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / F.lit(2.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a, b)


def microprice(bid: Column, bid_size: Column, ask: Column, ask_size: Column) -> Column:
    total = bid_size + ask_size
    return F.when(total > 0, ratio(bid * ask_size + ask * bid_size, total))


def imbalance(bid_size: Column, ask_size: Column) -> Column:
    total = bid_size + ask_size
    return F.when(total > 0, ratio(bid_size - ask_size, total))


def simple_return(now: Column, before: Column) -> Column:
    return ratio(now, before) - F.lit(1.0)


def tick_or_default(tick: Column, fallback: float = TICK_FALLBACK) -> Column:
    return F.when(tick > 0, tick).otherwise(F.lit(fallback))


def leg_size(ask: Column, fee_rate: float = FEE_RATE, buffer: float = PRICE_BUFFER) -> Column:
    """Shares left after the fee of one first-leg share, which is charged in shares."""
    paid = ask + F.lit(buffer)
    return F.lit(1.0) - F.lit(fee_rate) * paid * (F.lit(1.0) - paid)


def success_profit(
    ask: Column,
    fee_rate: float = FEE_RATE,
    buffer: float = PRICE_BUFFER,
    max_total: float = MAX_TOTAL_PRICE,
) -> Column:
    """Profit per share when the second leg fills at its quote."""
    size = leg_size(ask, fee_rate, buffer)
    return size - ((ask + F.lit(buffer)) + size * (F.lit(max_total) - ask))


def unwind_profit(
    ask: Column, exit_price: Column, fee_rate: float = FEE_RATE, buffer: float = PRICE_BUFFER
) -> Column:
    """Profit per share when the first leg is sold again at `exit_price`."""
    return leg_size(ask, fee_rate, buffer) * exit_price - (ask + F.lit(buffer))


def expected_profit(p_fill: Column, success: Column, unwind: Column) -> Column:
    return p_fill * success + (F.lit(1.0) - p_fill) * unwind


def finite_or_null(col: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), col)
