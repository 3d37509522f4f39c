"""Fill and profit rules on two-row frames with known answers."""

import math

import pytest

from tickloom import NS_PER_MS, NS_PER_SECOND
from tickloom.plans import labels

T0 = NS_PER_SECOND
SAMPLE = "recv_ns long, seq long, market_id string, asset_id string, outcome string, best_ask double, future_best_bid_10s double, future_mid_10s double, tick_size double"
TRADE = "asset_id string, recv_ns long, seq long, side string, price double"


def samples(spark):
    rows = [(T0, i, "m1", a, o, 0.50, 0.48, 0.49, 0.01) for i, (a, o) in enumerate([("A", "Up"), ("B", "Down")])]
    return spark.createDataFrame(rows, SAMPLE)


def label(spark, trades, **kw):
    out = labels.two_leg_fill(samples(spark), spark.createDataFrame(trades, TRADE), **kw)
    return out.where("asset_id = 'A'").first()


@pytest.mark.parametrize("pick", ["min", "first"])
@pytest.mark.parametrize(
    ("price", "delay_ms", "filled"),
    [(0.46, 300, False), (0.45, 300, True), (0.45, 100, False), (0.45, 250, True), (0.45, 10_000, True), (0.45, 10_001, False)],
)
def test_maker_fill_rule(spark, price, delay_ms, filled, pick):
    row = label(spark, [("B", T0 + delay_ms * NS_PER_MS, 1, "SELL", price)], pick=pick)
    assert (row["future_opposite_maker_fill_price_10s"] is not None) == filled
    assert row["y_two_leg_entry_10s"] == ("enter" if filled else "skip")
    if filled:
        assert math.isclose(row["future_opposite_maker_fill_price_10s"], 0.45)
        assert row["future_opposite_maker_fill_recv_ns_10s"] == T0 + delay_ms * NS_PER_MS


def test_equal_prices_take_the_latest_time(spark):
    row = label(spark, [("B", T0 + 400 * NS_PER_MS, 1, "SELL", 0.40), ("B", T0 + 900 * NS_PER_MS, 2, "SELL", 0.40)])
    assert row["future_opposite_maker_fill_recv_ns_10s"] == T0 + 900 * NS_PER_MS


def test_no_fill_uses_unwind_profit(spark):
    out = labels.final_profit(labels.two_leg_fill(samples(spark), spark.createDataFrame([], TRADE)))
    row = out.where("asset_id = 'A'").first()
    assert row["y_two_leg_entry_10s"] == "skip"
    assert math.isclose(row["final_profit_10s"], (1 - 0.072 * 0.51 * 0.49) * 0.48 - 0.51)


def test_market_with_three_assets_has_no_opposite(spark):
    three = samples(spark).unionByName(spark.createDataFrame([(T0, 9, "m1", "C", "Draw", 0.5, 0.4, 0.4, 0.01)], SAMPLE))
    out = labels.two_leg_fill(three, spark.createDataFrame([("B", T0 + 300 * NS_PER_MS, 1, "SELL", 0.1)], TRADE))
    assert out.where("opposite_asset_id is not null").count() == 0


def test_first_leg_fill_window(spark):
    ddl = "asset_id string, recv_ns long, seq long, best_ask double"
    rows = [("A", T0, 0, 0.50), ("A", T0 + 350 * NS_PER_MS, 1, 0.52), ("A", T0 + 701 * NS_PER_MS, 2, 0.60), ("A", T0 + 800 * NS_PER_MS, 3, None)]
    got = {r["seq"]: r["y_first_leg_fill"] for r in labels.first_leg_fill(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: None}


def test_alpha_labels_need_the_markout(spark):
    with pytest.raises(ValueError):
        labels.alpha_labels(samples(spark))
