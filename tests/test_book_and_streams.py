"""Order book in batch and as a stream, and the stateful stream rules."""

import gzip
import math

import pytest

from tickloom import NS_PER_MS, NS_PER_SECOND
from tickloom.operators.book import book_states
from tickloom.sources.raw import recover_gzip, recovery_report
from tickloom.streaming.book import stream_book_states
from tickloom.streaming.common import read_table_stream, run_to_table
from tickloom.streaming.outcomes import EVENT_DDL, Open, OutcomeConfig, resolve_outcomes
from tickloom.streaming.signals import GateConfig, gate_signals

UPDATE = (
    "asset_id string, recv_ns long, seq long, part2 int, kind string, side string, price string, size string, "
    "bids array<struct<price:string,size:string>>, asks array<struct<price:string,size:string>>"
)


def updates():
    def delta(t, side, price, size):
        return ("A", t, t, 0, "delta", side, price, size, None, None)

    snap = lambda t, b, a: ("A", t, t, 0, "snapshot", None, None, None, b, a)
    return [
        delta(1, "buy", "0.40", "10"),
        delta(2, "sell", "0.60", "5"),
        delta(3, "sell", "0.55", "7"),
        delta(4, "sell", "0.55", "0"),
        delta(5, "buy", "bad", "3"),
        snap(6, [("0.30", "1"), ("0.31", "0")], [("0.70", "2"), ("0.69", "4")]),
        delta(7, "buy", "0.35", "9"),
        delta(8, "buy", "0.30", "0"),
        delta(9, "buy", "0.35", "0"),
    ]


EXPECTED = [
    (None, None, 1, 0), (0.40, 0.60, 1, 1), (0.40, 0.55, 1, 2), (0.40, 0.60, 1, 1), (0.40, 0.60, 1, 1),
    (0.30, 0.69, 1, 2), (0.35, 0.69, 2, 2), (0.35, 0.69, 1, 2), (None, None, 0, 2),
]


def summary(df):
    return [(r["best_bid"], r["best_ask"], r["total_bid_levels"], r["total_ask_levels"]) for r in df.orderBy("recv_ns").collect()]


@pytest.mark.parametrize("width", [1, 2, 4, 100])
def test_batch_book_for_any_slice_width(spark, width):
    states = book_states(spark.createDataFrame(updates(), UPDATE), width)
    assert summary(states) == EXPECTED
    row = states.where("recv_ns = 3").first()
    assert math.isclose(row["microprice"], (0.40 * 7 + 0.55 * 10) / 17)
    assert math.isclose(row["depth_top3_imbalance"], (10 - 12) / 22)
    assert math.isclose(row["ask_depth_slope_top10"], (5 - 7) / 1)
    assert math.isclose(row["near_touch_ask_notional_5"], 0.55 * 7 + 0.60 * 5)


def test_stream_book_equals_batch_book(spark, tmp_path):
    rows = updates()
    for i in range(0, len(rows), 2):
        spark.createDataFrame(rows[i : i + 2], UPDATE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_table_stream(spark, str(tmp_path / "in"), "*.parquet", max_files=1)
    assert summary(run_to_table(stream_book_states(stream), "test-book")) == EXPECTED


def test_gated_depth_repeats_until_the_mid_moves(spark, tmp_path):
    rows = [
        ("A", 1, 1, 0, "snapshot", None, None, None, [("0.40", "10")], [("0.60", "10")]),
        ("A", 2, 2, 0, "delta", "buy", "0.40", "30", None, None),
        ("A", 3, 3, 0, "delta", "buy", "0.45", "30", None, None),
    ]
    spark.createDataFrame(rows, UPDATE).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = read_table_stream(spark, str(tmp_path / "in"), "*.parquet")
    got = run_to_table(stream_book_states(stream, 0.005), "test-gate").orderBy("recv_ns").collect()
    assert [r["refreshed"] for r in got] == [True, False, True]
    assert [r["cum_bid_depth_top1"] for r in got] == [10.0, 10.0, 30.0]
    assert [r["best_bid_size"] for r in got] == [10.0, 30.0, 30.0]


def test_open_signal_uses_the_offline_fill_rule():
    c, at = OutcomeConfig(), NS_PER_SECOND
    o = Open("S1", at, "A", "B", 0.50, 0.01, True)
    o.observe_trade(c, "B", "SELL", 0.46, at + 300 * NS_PER_MS)
    o.observe_trade(c, "B", "SELL", 0.45, at + 100 * NS_PER_MS)
    assert o.fill_price is None
    o.observe_trade(c, "B", "SELL", 0.45, at + 300 * NS_PER_MS)
    assert o.fill_price == 0.45
    o.observe_ask(c, 0.50)
    assert o.outcome(c, (0.48, 0.50, 0.49))["result"] == "success"


def test_shadow_signal_unwinds_and_untouched_ask_is_missed():
    c = OutcomeConfig()
    shadow = Open("C1", 1, "A", "B", 0.50, 0.01, False)
    out = shadow.outcome(c, (0.48, 0.50, 0.49))
    assert out["result"] == "unwind"
    assert math.isclose(out["profit"], (1 - 0.072 * 0.51 * 0.49) * 0.48 - 0.51)
    assert Open("S2", 1, "A", "B", 0.50, 0.01, True).outcome(c, None)["result"] == "missed"
    assert Open("C2", 1, "A", None, 0.50, 0.01, False).outcome(c, None)["result"] == "no_opposite"


def test_outcome_stream_over_several_batches(spark, tmp_path):
    s = NS_PER_SECOND

    def row(kind, t, asset, **kw):
        base = dict(kind=kind, recv_ns=t, seq=t, market_id="m", asset_id=asset, opposite_asset_id=None, signal_id=None, best_bid=None,
                    best_ask=None, mid=None, side=None, price=None, tick_size=None, tracked=None)
        return tuple({**base, **kw}.values())

    book = dict(best_bid=0.49, best_ask=0.50, mid=0.495)
    batches = [
        [row("book", 1 * s, "A", **book), row("signal", 1 * s + 1, "A", signal_id="S1", opposite_asset_id="B", best_ask=0.50, tick_size=0.01, tracked=True)],
        [row("book", 2 * s, "A", **book), row("trade", 3 * s, "B", side="sell", price=0.44),
         row("signal", 4 * s, "A", signal_id="S2", opposite_asset_id="B", best_ask=0.50, tick_size=0.01, tracked=True)],
        [row("book", 12 * s, "A", **{**book, "best_bid": 0.47})],
        [row("book", 40 * s, "B", **book)],
    ]
    for b in batches:
        spark.createDataFrame(b, EVENT_DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_table_stream(spark, str(tmp_path / "in"), "*.parquet", max_files=1)
    got = {r["signal_id"]: r for r in run_to_table(resolve_outcomes(stream), "test-outcomes").collect()}
    assert got["S1"]["result"] == "success" and got["S1"]["fill_price"] == 0.44 and got["S1"]["resolve_ns"] == 12 * s
    assert got["S2"]["result"] == "unwind" and got["S2"]["future_bid"] == 0.47


def test_gates_on_a_batch(spark):
    ddl = ("recv_ns long, seq long, market_id string, asset_id string, opposite_asset_id string, outcome string, slug string, best_bid double, "
           "best_ask double, current_spread double, time_to_expiry_seconds double, p_fill double, decision_score double")
    s = NS_PER_SECOND
    rows = [(t * s, i, "m", "A", "B", "Up", None, 0.4, 0.5, 0.01, 60.0, p, p) for i, (t, p) in enumerate([(1, 0.6), (2, 0.7), (3, 0.1), (4, 0.9), (12, 0.2), (13, 0.8)])]
    df = spark.createDataFrame(rows, ddl)
    hits = lambda c: [r["seq"] for r in gate_signals(df, c).where("signal").orderBy("seq").collect()]
    assert hits(GateConfig(0.5, crossing=True, max_entries=0)) == [0, 5]
    assert hits(GateConfig(0.5, crossing=True, cooldown_seconds=0, max_entries=0)) == [0, 3, 5]
    assert hits(GateConfig(0.5, cooldown_seconds=0, max_entries=2)) == [0, 1]
    assert hits(GateConfig(0.5, min_tte=100.0)) == []


def test_gzip_recovery_continues_after_a_damaged_member(spark, tmp_path):
    def member(a, b):
        return gzip.compress("".join(f'{{"recv_ns": {i}, "raw": {{}}}}\n' for i in range(a, b)).encode())

    broken = bytearray(member(200, 300))
    broken[40:60] = b"\x00" * 20
    path = tmp_path / "feed.jsonl.gz"
    path.write_bytes(member(0, 100) + member(100, 200) + bytes(broken) + member(300, 400))
    paths = spark.createDataFrame([(str(path),)], "path string")
    lines = recover_gzip(spark, paths)
    ids = {int(v.split(":")[1].split(",")[0]) for v in (r["value"] for r in lines.where("value is not null").collect()) if "recv_ns" in v and "," in v and v.split(":")[1].split(",")[0].strip().isdigit()}
    assert set(range(200)) <= ids and set(range(300, 400)) <= ids
    report = recovery_report(lines).first()
    assert report["recovered_members"] == 3 and report["skipped_members"] >= 1
