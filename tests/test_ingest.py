"""Three feeds in one stream: one parse, one table each kind, batches that count once."""

import json
from functools import reduce
from pathlib import Path

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans import normalize
from tickloom.streaming.ingest import committed, normalise_stream, raw_stream, write_batch

S = 1_000_000_000
DAY = 86_400 * S
MESSAGES = {
    "trades": {"event_type": "last_trade_price", "asset_id": "A", "market": "M", "price": "0.5", "size": "3", "side": "BUY", "timestamp": "7"},
    "quotes": {"event_type": "best_bid_ask", "asset_id": "A", "market": "M", "best_bid": "0.4", "best_ask": "0.6", "spread": "0.2"},
    "book_updates": {"event_type": "book", "asset_id": "A", "market": "M", "bids": [{"price": "0.4", "size": "1"}], "asks": []},
    "feed_quotes": {"stream": "btcusdt@bookTicker", "data": {"s": "BTCUSDT", "u": 4, "b": "10", "a": "11"}},
    "feed_trades": {"stream": "btcusdt@aggTrade", "data": {"s": "BTCUSDT", "p": "10", "q": "2", "m": True, "T": 5}},
    "feed_book": {"stream": "btcusdt@depth5", "data": {"lastUpdateId": 9, "bids": [["10", "1"]], "asks": [["11", "2"]]}},
    "own_orders": {"event_type": "order", "id": "o1", "market": "M", "asset_id": "A", "price": "0.4", "original_size": "5", "type": "PLACEMENT"},
    "own_trades": {"event_type": "trade", "id": "t1", "market": "M", "asset_id": "A", "price": "0.4", "size": "5", "status": "MATCHED"},
}
NO_TABLE = [{"event_type": "other"}, {"stream": "x"}, {"data": None, "stream": "btcusdt@aggTrade"}, {}]


def line(t, message):
    return json.dumps({"recv_ns": t, "raw": message})


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines))


def counts(spark, out):
    tables = [committed(spark, out, name).select(F.lit(name).alias("name")) for name in MESSAGES]
    found = {r.name: r["count"] for r in reduce(DataFrame.unionByName, tables).groupBy("name").count().collect()}
    return {name: found.get(name, 0) for name in MESSAGES}


def test_one_run_fills_every_table_and_a_restart_adds_only_new_files(spark, tmp_path):
    source, out, checkpoint = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    every = list(MESSAGES.values())
    put(source, "a.jsonl", [line(DAY + i * S, x) for i, x in enumerate(every + NO_TABLE)] + ["{broken", ""])
    put(source, "b.jsonl", [line(2 * DAY, every)])  # one array payload

    def run():
        normalise_stream(raw_stream(spark, str(source), 1), out, checkpoint, once=True).awaitTermination()

    run()
    assert counts(spark, out) == dict.fromkeys(MESSAGES, 2)
    run()
    assert counts(spark, out) == dict.fromkeys(MESSAGES, 2)
    put(source, "c.jsonl", [line(3 * DAY, MESSAGES["own_trades"])])
    run()
    assert counts(spark, out) == dict.fromkeys(MESSAGES, 2) | {"own_trades": 3}
    assert {(r.date, r.trade_id, r.size) for r in committed(spark, out, "own_trades").collect()} == {(f"1970010{d}", "t1", 5.0) for d in (2, 3, 4)}
    assert committed(spark, out, "feed_trades").first().side == "SELL"


def test_a_batch_counts_once_and_only_when_whole(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = spark.createDataFrame([(DAY, 0, json.dumps(x)) for x in MESSAGES.values()], "recv_ns long, part int, message string")
    write_batch(batch, 0, out)
    write_batch(batch, 0, out)
    assert counts(spark, out) == dict.fromkeys(MESSAGES, 1)
    write_batch(batch.limit(0), 1, out)
    assert counts(spark, out) == dict.fromkeys(MESSAGES, 1)
    # a batch that broke off after its first tables
    spark.read.parquet(f"{out}/trades/date=19700102/batch=0").write.parquet(f"{out}/trades/date=19700102/batch=2")
    assert counts(spark, out)["trades"] == 1
    write_batch(batch, 2, out)
    assert counts(spark, out) == dict.fromkeys(MESSAGES, 2)


def test_no_messages_give_empty_tables(spark, tmp_path):
    write_batch(spark.createDataFrame([], "recv_ns long, part int, message string"), 0, str(tmp_path))
    assert set(counts(spark, str(tmp_path)).values()) == {0}


def test_tables_agree_with_those_of_one_feed(spark):
    rows = [(DAY + i, i, json.dumps(x)) for i, x in enumerate([*MESSAGES.values(), *NO_TABLE])]
    messages = spark.createDataFrame(rows, "recv_ns long, seq long, message string")
    market, feed, own = (f(messages) for f in (normalize.parse_market_messages, normalize.parse_feed_messages, normalize.parse_own_messages))
    alone = {
        "trades": normalize.trades(market, "venue"), "quotes": normalize.quotes(market, "venue"), "book_updates": normalize.book_updates(market),
        "feed_quotes": normalize.feed_quotes(feed, "feed"), "feed_trades": normalize.feed_trades(feed, "feed"), "feed_book": normalize.feed_book(feed, "feed"),
        "own_orders": normalize.own_orders(own), "own_trades": normalize.own_trades(own),
    }
    parsed = normalize.parse_all_messages(messages)
    for name, table in normalize.ALL_TABLES.items():
        got = table(parsed, "venue", "feed").collect()
        assert len(got) == 1 and got == alone[name].collect(), name


def test_a_batch_is_written_and_not_cached(spark, tmp_path, monkeypatch):
    seen = []

    def own_trades(parsed, source, feed):
        seen.append((parsed.is_cached, parsed.storageLevel.useMemory, [Path(f.removeprefix("file://")) for f in parsed.inputFiles()]))
        return normalize.own_trades(parsed)

    monkeypatch.setattr(normalize, "ALL_TABLES", {"own_trades": own_trades})
    line = '{"event_type": "trade", "id": "a", "price": "0.5"}'
    batch = spark.createDataFrame([(1, 0, line)], "recv_ns long, part int, message string")
    write_batch(batch, 0, str(tmp_path))
    (cached, in_memory, files), = seen
    assert not cached and not in_memory and files and not any(f.exists() for f in files)
    assert committed(spark, str(tmp_path), "own_trades").count() == 1


def test_files_of_a_batch_are_bounded_however_long_the_log_is(spark, monkeypatch):
    from tickloom.workload import io_queries

    class Seen(Exception):
        pass

    def stream(spark, folder, max_files):
        raise Seen(max_files, len(spark.read.text(folder).inputFiles()))

    write = io_queries.write_raw
    monkeypatch.setattr(io_queries, "write_raw", lambda lines, folder: write(lines, folder, 10))
    monkeypatch.setattr(io_queries, "raw_stream", stream)
    with pytest.raises(Seen) as seen:
        io_queries.all_feeds_query(spark, "/root/testdata/sf0.001")
    most, files = seen.value.args
    assert files > 128 and most == 64
