"""The sliced order book against a book that is sorted anew for every event."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.depth import DEPTH_COLUMNS
from tickloom.operators.book import TOP_COLUMNS, book_states

UPDATE = (
    "asset_id string, recv_ns long, seq long, part2 int, kind string, side string, price string, size string, "
    "bids array<struct<price:string,size:string>>, asks array<struct<price:string,size:string>>"
)


def drawn(n=1200):
    """Deltas, removals, unreadable rows and snapshots of four assets (one without a name, one rare)."""
    rng, rows = random.Random(7), []
    for t in range(n):
        asset = rng.choice(["A", "A", "A", "B", None]) if t % 100 else "rare"
        if rng.random() < 0.02:
            side = lambda lo: [(f"0.{lo + i}", str(rng.randint(0, 9))) for i in rng.sample(range(40), rng.randint(0, 30))]
            rows.append((asset, t, t, 0, "snapshot", None, None, None, side(10), side(51)))
            continue
        buys = rng.random() < 0.5
        price = rng.choice(["bad", None]) if rng.random() < 0.02 else f"0.{rng.randint(10, 49) if buys else rng.randint(51, 90)}"
        size = rng.choice(["0", "0", "-1", "x"]) if rng.random() < 0.3 else str(rng.randint(1, 50))
        rows.append((asset, t, t, 0, "delta", rng.choice(["buy" if buys else "sell", "buy" if buys else "sell", None]), price, size, None, None))
    return rows


def number(text):
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def expected(rows):
    books, out = {}, {}
    for asset, t, _, _, kind, side, price, size, bids, asks in rows:
        book = books.setdefault(asset, {"buy": {}, "sell": {}})
        if kind == "snapshot":
            for name, levels in (("buy", bids), ("sell", asks)):
                book[name] = {float(p): float(z) for p, z in levels if float(z) > 0}
        elif side and number(price) is not None and number(size) is not None:
            book[side].pop(float(price), None)
            if float(size) > 0:
                book[side][float(price)] = float(size)
        b, a = sorted(book["buy"].items(), reverse=True), sorted(book["sell"].items())
        row = dict.fromkeys([*TOP_COLUMNS, *DEPTH_COLUMNS])
        row |= {"total_bid_levels": len(b), "total_ask_levels": len(a)}
        if b and a:
            (bp, bz), (ap, az) = b[0], a[0]
            row |= dict(best_bid=bp, best_ask=ap, best_bid_size=bz, best_ask_size=az, spread=ap - bp, midpoint=(ap + bp) / 2,
                        microprice=(bp * az + ap * bz) / (bz + az), imbalance=(bz - az) / (bz + az))
        for n in (1, 3, 5, 10, 20):
            x, y = sum(z for _, z in b[:n]), sum(z for _, z in a[:n])
            row |= {f"cum_bid_depth_top{n}": x, f"cum_ask_depth_top{n}": y, f"depth_top{n}_imbalance": (x - y) / (x + y) if x + y else None}
        for name, levels in (("bid", b), ("ask", a)):
            for n in (10, 20):
                top = levels[:n]
                row[f"{name}_depth_slope_top{n}"] = (top[-1][1] - top[0][1]) / (len(top) - 1) if len(top) > 1 else None
            for n in (5, 10, 20):
                row[f"near_touch_{name}_notional_{n}"] = sum(p * z for p, z in levels[:n])
        out[t] = (asset, row)
    return out


def same(x, y):
    return x == y if x is None or y is None else math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize(("width", "batch"), [(17, 10_000), (100, 3), (10_000, 64)])
def test_every_column_for_slices_and_batches_of_any_size(spark, width, batch):
    rows = drawn()
    want = expected(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = book_states(spark.createDataFrame(rows, UPDATE).repartition(5), width).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and {r.recv_ns for r in got} == set(want)
    for r in got:
        asset, row = want[r.recv_ns]
        assert r.asset_id == asset
        wrong = {c: (r[c], v) for c, v in row.items() if not same(r[c], v)}
        assert not wrong, (r.recv_ns, wrong)


def test_no_rows_and_rows_without_a_time(spark):
    assert book_states(spark.createDataFrame([], UPDATE), 10).count() == 0
    delta = lambda t, size: ("A", t, 1 if t is None else t, 0, "delta", "buy", "0.4", size, None, None)
    got = book_states(spark.createDataFrame([delta(None, "3"), delta(50, "5"), delta(70, "0")], UPDATE), 10)
    assert [r.cum_bid_depth_top1 for r in got.orderBy(F.col("recv_ns").asc_nulls_first()).collect()] == [3.0, 5.0, 0.0]


@pytest.mark.parametrize(("width", "least_rows"), [(10, 1), (50, 1), (10, 200)])
def test_joined_slices_give_the_same_books(spark, width, least_rows):
    frame = spark.createDataFrame(drawn(), UPDATE)
    key = lambda r: (r.asset_id is None, r.asset_id or "", r.recv_ns)
    whole = sorted(book_states(frame, 10_000_000).collect(), key=key)
    assert sorted(book_states(frame, width, least_rows).collect(), key=key) == whole


def test_short_slices_of_few_rows_need_no_seeds(spark, monkeypatch):
    from tickloom.operators import book

    def no_seeds(*_):
        raise AssertionError("seeds were looked for")

    monkeypatch.setattr(book, "slice_seeds", no_seeds)
    assert book_states(spark.createDataFrame(drawn(300), UPDATE), 10).count() == 300
