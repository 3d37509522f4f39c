"""What the stream processors ask of the state store, counted with states in memory."""

import pandas as pd
from pyspark.sql import functions as F

from tickloom import NS_PER_MS, NS_PER_SECOND
from tickloom.streaming.outcomes import EVENT_DDL, OutcomeConfig, OutcomeProcessor

S = NS_PER_SECOND


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Map:
    def __init__(self):
        self.d, self.calls = {}, 0

    def exists(self):
        return bool(self.d)

    def iterator(self):
        return iter(list(self.d.items()))

    def updateValue(self, k, v):
        self.calls += 1
        self.d[k] = v

    def removeKey(self, k):
        self.calls += 1
        self.d.pop(k, None)

    def clear(self):
        self.d = {}


class Handle:
    """Stands in for a StatefulProcessorHandle."""

    def __init__(self):
        self.timers, self.registered, self.states = set(), 0, {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Map())

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Value())

    def registerTimer(self, at):
        self.registered += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Timer:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at

    getCurrentWatermarkInMs = getExpiryTimeInMs


def test_a_market_has_one_timer_for_all_open_signals():
    names = [x.split()[0] for x in EVENT_DDL.split(", ")] + ["rank"]
    rows = []
    for i in range(200):
        base = dict.fromkeys(names) | dict(recv_ns=i * S, seq=i, market_id="m", asset_id="A", opposite_asset_id="B", best_bid=0.4, best_ask=0.5)
        rows.append(base | dict(kind="book", mid=0.45, rank=0))
        rows.append(base | dict(kind="signal", signal_id=str(i), tracked=True, tick_size=0.01, rank=2))
    handle, processor = Handle(), OutcomeProcessor(OutcomeConfig(), 60 * S)
    processor.init(handle)
    closed = pd.concat(processor.handleInputRows(("m",), iter([pd.DataFrame(rows)[names]]), None))
    assert len(closed) == 190 and len(handle.timers) == 2 and handle.registered == 2  # the signals' and the books'
    # the watermark passes some horizons, then all
    first = min(handle.timers)
    assert first == 200 * 1000 + 1
    passed = Timer(first)
    passed.getCurrentWatermarkInMs = lambda: 204 * 1000 + 2
    handle.timers.discard(first)
    some = pd.concat(processor.handleExpiredTimer(("m",), passed, passed))
    assert some["resolve_ns"].tolist() == [(t * 1000 + 1) * NS_PER_MS for t in range(200, 205)]
    late = Timer(min(handle.timers))
    late.getCurrentWatermarkInMs = lambda: 10**9
    handle.timers.discard(late.at)
    assert len(pd.concat(processor.handleExpiredTimer(("m",), late, late))) == 5
    assert len(handle.timers) == 1 and not handle.states["due"].exists()


def test_files_of_one_job_are_counted_in_one_batch(spark, monkeypatch):
    """More files of the first stream than two micro-batches of the second used to take, later times first (rows are late from the third on)."""
    from tickloom.workload import stream_queries as q

    day = 86_400 * S
    flags = "raw_signal boolean, p_fill_ok boolean, unwind_ok boolean, crossed boolean, cooldown_ok boolean, max_entries_ok boolean, has_opposite boolean, entry_ok boolean, signal boolean"
    rows = [(int((199 - i) / 200 * 5 * day) + day, *[True] * 9) for i in range(200)]
    table = spark.createDataFrame(rows, f"recv_ns long, {flags}").repartitionByRange(200, F.col("recv_ns").desc())
    from tickloom.session import cut_lineage

    written = cut_lineage(table, "flagged-files")
    assert len(written.inputFiles()) > 2 * 64
    monkeypatch.setattr(q, "gate_signals", lambda *_: None)
    monkeypatch.setattr(q, "scored_stream", lambda *_: None)
    counting = q.run_to_table
    monkeypatch.setattr(q, "run_to_table", lambda stream, purpose: written if stream is None else counting(stream, purpose))
    got = {r["day"]: r["samples"] for r in q.gate_count_stream(spark, "").collect()}
    assert got == {d: 40 for d in range(1, 5)}


def test_a_book_is_stored_at_once():
    from tickloom.streaming.book import BookProcessor

    levels = 500
    changes = pd.DataFrame({
        "asset_id": "A", "recv_ns": [i * S for i in range(levels)], "seq": range(levels), "part2": 0, "kind": "delta",
        "side": [1 if i % 2 else -1 for i in range(levels)], "price": [i * 10_000 for i in range(levels)], "size": 5.0, "rank": 1,
    })
    handle, processor = Handle(), BookProcessor(None, 60 * S)
    processor.init(handle)
    first = pd.concat(processor.handleInputRows(("A",), iter([changes]), None))
    assert len(first) == levels and first["total_bid_levels"].iloc[-1] == levels // 2
    # no state grows by a row a level, and the next batch goes on from all of them
    assert not any(isinstance(s, Map) for s in handle.states.values())
    gone = changes.tail(1).assign(recv_ns=levels * S, seq=levels, size=0.0)
    after = pd.concat(processor.handleInputRows(("A",), iter([gone]), None))
    assert after[["total_bid_levels", "total_ask_levels"]].iloc[0].tolist() == [levels // 2 - 1, levels // 2]


def test_gates_of_a_key_are_one_value():
    from tickloom.streaming.signals import GateConfig, GateProcessor

    flags = dict.fromkeys(["finite", "has_opposite", "entry_ok", "p_fill_ok", "unwind_ok", "first_leg_ok"], True)

    def rows(t, scores):
        return pd.DataFrame([dict(recv_ns=t * S, seq=i, asset_id=f"A{i}", decision_score=x, raw_signal=x >= 0.5, **flags) for i, x in enumerate(scores)])

    handle, processor = Handle(), GateProcessor(GateConfig(threshold=0.5, crossing=True, cooldown_seconds=0, max_entries=0), 60 * S)
    processor.init(handle)
    first = pd.concat(processor.handleInputRows(("k",), iter([rows(1, [0.9, 0.1, 0.9])]), None))
    second = pd.concat(processor.handleInputRows(("k",), iter([rows(2, [0.9, 0.9, 0.1])]), None))
    assert not any(isinstance(s, Map) for s in handle.states.values())
    assert first["signal"].tolist() == [True, False, True] and second["signal"].tolist() == [False, True, False]
    assert second["entry_no"].tolist() == [0, 3, 0]


def test_raw_logs_grow_in_files_not_in_length(spark, tmp_path):
    from tickloom.workload.io_queries import write_raw

    folder = str(tmp_path / "raw")
    for _ in range(2):
        write_raw(spark.range(0, 1000, 1, 4).select(F.col("id").cast("string").alias("value")), folder, 50)
    sizes = [r["count"] for r in spark.read.text(folder).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 40 and max(sizes) == 50
