import pandas as pd

from tickloom.streaming.features import COLUMNS, FeatureConfig, FeatureProcessor


class Held:
    """A state of one key without Spark."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update


class Handle:
    def getValueState(self, *_):
        return Held()

    getListState = getValueState


def rows(*events):
    """Rows of (kind, seconds, mid), out of order as they come."""
    return pd.DataFrame([dict.fromkeys(COLUMNS) | {"kind": k, "recv_ns": t * 10**9, "seq": 2 * t + (k == "book"), "asset_id": "A", "mid": m, "spread": 0.01, "price": m, "size": 1.0, "signed_side": 1.0} for k, t, m in events])


def test_a_call_builds_one_frame_and_late_rows_take_their_place(monkeypatch):
    def run(*batches):
        processor = FeatureProcessor(FeatureConfig(scale=10))
        processor.init(Handle())
        frames = [f for b in batches for f in processor.handleInputRows(("A",), iter([b]), None)]
        return pd.concat(frames, ignore_index=True), processor.recent.get()

    events = [("book", 1, 0.4), ("trade", 3, 0.5), ("ref", 4, 0.6), ("book", 4, 0.5), ("book", 7, 0.45)]
    whole, state = run(rows(*events[::-1]))
    assert whole["recv_ns"].tolist() == [10**9, 4 * 10**9, 7 * 10**9]
    assert whole["book_update_count_1s"].tolist() == [1.0, 2.0, 3.0] and whole["trade_count_1s"].tolist()[1:] == [1.0, 1.0]
    assert whole["ref_mid"].isna().tolist() == [True, False, True]
    parted, again = run(rows(events[4]), rows(*events[:4]), rows(("book", 8, 0.45)))
    assert parted["recv_ns"].tolist() == [7 * 10**9, 10**9, 4 * 10**9, 8 * 10**9]
    assert parted["book_update_count_1s"].tolist() == [1.0, 1.0, 2.0, 4.0]
    assert [r[:3] for r in state] == [r[:3] for r in again[:-1]] and state[0][4] is None

    batch, made, build = rows(*events), [], pd.DataFrame.__init__
    monkeypatch.setattr(pd.DataFrame, "__init__", lambda self, *a, **b: (made.append(1), build(self, *a, **b))[1])
    processor = FeatureProcessor(FeatureConfig(scale=10))
    processor.init(Handle())
    assert len(list(processor.handleInputRows(("A",), iter([batch]), None))) == 1 and len(made) == 1
