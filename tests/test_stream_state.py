"""State of the stream processors ends, late rows are left out and counted."""

from tests.test_book_and_streams import UPDATE

from tickloom import NS_PER_SECOND
from tickloom.streaming.book import stream_book_states
from tickloom.streaming.common import read_table_stream, run_to_table
from tickloom.streaming.features import EVENT_DDL as FEATURE_DDL
from tickloom.streaming.features import online_features
from tickloom.streaming.outcomes import EVENT_DDL as OUTCOME_DDL
from tickloom.streaming.outcomes import resolve_outcomes
from tickloom.streaming.signals import GateConfig, gate_signals

S = NS_PER_SECOND
SCORED = (
    "recv_ns long, seq long, market_id string, asset_id string, opposite_asset_id string, outcome string, slug string, best_bid double, "
    "best_ask double, current_spread double, time_to_expiry_seconds double, p_fill double, decision_score double"
)


def streamed(spark, folder, ddl, batches):
    for b in batches:
        spark.createDataFrame(b, ddl).coalesce(1).write.mode("append").parquet(str(folder))
    return read_table_stream(spark, str(folder), "*.parquet", max_files=1)


def state_of(progress):
    """State rows after every micro-batch, and rows dropped as late."""
    parts = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    return [p["numRowsTotal"] for p in parts], sum(p["numRowsDroppedByWatermark"] for p in parts)


def test_books_end_and_late_rows_are_left_out(spark, tmp_path):
    def snapshot(asset, t):
        return (asset, t * S, t, 0, "snapshot", None, None, None, [("0.40", "10"), ("0.39", "5")], [("0.60", "10")])

    def delta(asset, t, size):
        return (asset, t * S, t, 0, "delta", "buy", "0.40", size, None, None)

    batches = [
        [snapshot(f"A{i}", 1) for i in range(20)],
        [delta("A1", 4, "30")],
        [delta("A1", 3, "99"), delta("A2", 4, "40")],  # behind the newer row, ahead of the watermark
        [delta("A1", 1, "77"), delta("A2", 6, "50")],  # behind the watermark
        [snapshot("Z", 500)],
        [snapshot("Z", 1000)],
    ]
    progress = []
    out = run_to_table(stream_book_states(streamed(spark, tmp_path / "in", UPDATE, batches), idle_ns=60 * S), "ends-book", progress=progress).collect()
    rows, dropped = state_of(progress)
    assert max(rows) >= 20 * 3 and rows[-1] < 10 and dropped == 1
    got = {(r.asset_id, r.recv_ns // S): r.best_bid_size for r in out}
    assert got["A1", 4] == 30.0 and got["A2", 6] == 50.0 and got["A1", 1] == 10.0 and ("A1", 3) not in got and len(out) == 20 + 3 + 2


def test_gates_forget_keys_and_keep_live_ones(spark, tmp_path):
    def row(t, market, p):
        return (t * S, t, market, "A", "B", "Up", None, 0.4, 0.5, 0.01, 60.0, p, p)

    batches = [[row(1, f"m{i}", 0.9) for i in range(30)], [row(5, "m0", 0.9)], [row(50, "m0", 0.9)], [row(90, "m0", 0.9)], [row(400, "z", 0.1)], [row(800, "z", 0.1)]]
    config, progress = GateConfig(0.5, cooldown_seconds=10, max_entries=2), []
    out = run_to_table(gate_signals(streamed(spark, tmp_path / "in", SCORED, batches), config, idle_ns=60 * S), "ends-gates", progress=progress)
    rows, _ = state_of(progress)
    assert max(rows) >= 60 and rows[-1] < 8
    assert sorted(r.recv_ns // S for r in out.where("signal and market_id = 'm0'").collect()) == [1, 50]


def test_feature_history_ends_and_late_rows_take_their_place(spark, tmp_path):
    def row(kind, t, asset, mid):
        return (kind, int(t * S), int(t * 1000), asset, mid - 0.01, mid + 0.01, mid, 0.02, 0.1, mid, 1.0, 1.0)

    batches = [[row("book", 1, f"A{i}", 0.5) for i in range(10)] + [row("book", 2, "A0", 0.52)], [row("book", 1.5, "A0", 0.51)], [row("book", 2.4, "A0", 0.53)], [row("book", 300, "Z", 0.5)], [row("book", 600, "Z", 0.5)]]
    progress = []
    out = run_to_table(online_features(streamed(spark, tmp_path / "in", FEATURE_DDL, batches), idle_ns=60 * S), "ends-features", progress=progress).collect()
    rows, _ = state_of(progress)
    assert max(rows) >= 30 and rows[-1] < 10
    counts = {(r.asset_id, r.seq): r.book_update_count_1s for r in out}
    assert counts["A0", 1500] == 2.0 and counts["A0", 2400] == 3.0  # 1.5, 2.0 and 2.4 s


def test_books_of_markets_end_after_their_signals(spark, tmp_path):
    def row(kind, t, market, **kw):
        base = dict(kind=kind, recv_ns=t * S, seq=t, market_id=market, asset_id="A", opposite_asset_id=None, signal_id=None, best_bid=0.49,
                    best_ask=0.50, mid=0.495, side=None, price=None, tick_size=None, tracked=None)
        return tuple({**base, **kw}.values())

    batches = [
        [row("book", 1, f"m{i}") for i in range(10)] + [row("signal", 2, "m0", signal_id="S", opposite_asset_id="B", tracked=True, tick_size=0.01)],
        [row("book", 300, "z")],
        [row("book", 600, "z")],
    ]
    progress = []
    out = run_to_table(resolve_outcomes(streamed(spark, tmp_path / "in", OUTCOME_DDL, batches), idle_ns=60 * S), "ends-outcomes", progress=progress).collect()
    rows, _ = state_of(progress)
    assert [(r.signal_id, r.result) for r in out] == [("S", "missed")]
    assert max(rows) >= 20 and rows[-1] < 6
