"""Queries over messages, books, instruments, dimensions and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import depth, text
from tickloom.functions.buckets import expiry_bucket, market_phase
from tickloom.operators.book import book_states
from tickloom.operators.combine import enrich, fill_unknown, overlap, relevant_events, union_distinct, union_relaxed
from tickloom.plans import canonical, instruments, normalize
from tickloom.sources import raw
from tickloom.workload import mapping as m
from tickloom.workload.base_sql import TICKS, with_ctes
from tickloom.workload.mapping import DAY
from tickloom.workload.registry import query

START = 1_704_067_200  # first second of the event tables


# ---- messages -------------------------------------------------------------------------


def raw_lines(spark, sf):
    """Ticks as envelope lines of a raw log.

    Purchases are trades, views quotes, clicks single price changes, sign-ups books (as an
    array payload inside a JSON string), errors are cut off in the middle.
    """
    t = m.ticks(spark, sf)
    money = lambda c: F.format_string("%.2f", c)
    common = [F.col("asset_id"), F.col("market_id").alias("market"), F.lit("1700000000123").alias("timestamp")]
    level = lambda d: F.array(F.struct(money(F.col("mid") + d).alias("price"), F.col("k").cast("string").alias("size")))
    trade = F.to_json(
        F.struct(F.lit("last_trade_price").alias("event_type"), *common, money(F.col("mid")).alias("price"),
                 F.col("k").cast("string").alias("size"), F.lit("BUY").alias("side"), F.lit("").alias("fee_rate_bps"))
    )
    quote = F.to_json(
        F.struct(F.lit("best_bid_ask").alias("event_type"), *common, money(F.col("mid") - 0.01).alias("best_bid"),
                 money(F.col("mid") + 0.01).alias("best_ask"), F.lit("0.02").alias("spread"))
    )
    change = F.struct(F.col("asset_id"), money(F.col("mid")).alias("price"), F.col("k").cast("string").alias("size"), F.lit("SELL").alias("side"))
    changes = F.to_json(
        F.struct(F.lit("price_change").alias("event_type"), F.col("market_id").alias("market"), F.lit("1700000000123").alias("timestamp"),
                 F.array(change, change).alias("price_changes"))
    )
    book = F.to_json(F.struct(F.lit("book").alias("event_type"), *common, level(-0.01).alias("bids"), level(0.01).alias("asks")))
    payload = (
        F.when(F.col("event_type") == "purchase", trade)
        .when(F.col("event_type") == "view", quote)
        .when(F.col("event_type") == "click", changes)
        .when(F.col("event_type") == "signup", F.to_json(F.struct(F.concat(F.lit("["), book, F.lit("]")).alias("raw"))))
    )
    head = F.concat(F.lit('{"recv_ns":'), F.col("recv_ns").cast("string"), F.lit(","))
    line = (
        F.when(F.col("event_type") == "error", F.concat(head, F.lit('"raw":{"event_type":"last_tr')))
        .when(F.col("event_type") == "signup", F.concat(head, F.substring(payload, 2, 1 << 24)))
        .otherwise(F.concat(head, F.lit('"raw":'), payload, F.lit("}")))
    )
    return t.select(line.alias("value"), "seq")


def messages(spark, sf):
    return normalize.parse_market_messages(raw.flatten_payload(raw.envelope(raw_lines(spark, sf))))


@query(
    "message_routing",
    with_ctes(
        TICKS,
        """SELECT CASE event_type WHEN 'purchase' THEN 'last_trade_price' WHEN 'view' THEN 'best_bid_ask' WHEN 'click' THEN 'price_change' ELSE 'book' END
           AS message_type, count(*) AS n, CAST(sum(recv_ns % 1000000007) AS BIGINT) AS check_sum FROM ticks WHERE event_type <> 'error' GROUP BY 1""",
    ),
)
def routing_query(spark, sf):
    parsed = messages(spark, sf)
    return parsed.groupBy(F.col("m.event_type").alias("message_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("recv_ns") % 1000000007).alias("check_sum")
    )


@query(
    "normalized_trades",
    with_ctes(
        TICKS,
        """SELECT seq, recv_ns, 'venue' AS source, asset_id, market_id AS market, 1700000000123 AS exchange_ts, mid AS price, CAST(k AS DOUBLE) AS size,
                  'BUY' AS side, 0.0::DOUBLE AS fee_rate_bps FROM ticks WHERE event_type = 'purchase'""",
    ),
)
def trades_query(spark, sf):
    return normalize.trades(messages(spark, sf), "venue")


@query(
    "normalized_quotes",
    with_ctes(
        TICKS,
        """SELECT seq, recv_ns, 'venue' AS source, asset_id, market_id AS market, 1700000000123 AS exchange_ts, round(mid - 0.01, 2) AS best_bid,
                  round(mid + 0.01, 2) AS best_ask, 0.02::DOUBLE AS spread FROM ticks WHERE event_type = 'view'""",
    ),
)
def quotes_query(spark, sf):
    return normalize.quotes(messages(spark, sf), "venue")


@query(
    "normalized_book_updates",
    with_ctes(
        TICKS,
        """SELECT seq, asset_id, market_id AS market, 'delta' AS kind, CAST(p AS INTEGER) AS part2, 'sell' AS side, mid AS price, 0 AS levels
           FROM ticks, range(2) r(p) WHERE event_type = 'click'
           UNION ALL SELECT seq, asset_id, market_id, 'snapshot', 0, NULL, NULL, 2 FROM ticks WHERE event_type = 'signup'""",
    ),
)
def updates_query(spark, sf):
    u = normalize.book_updates(messages(spark, sf))
    levels = F.coalesce(F.size("bids"), F.lit(0)) + F.coalesce(F.size("asks"), F.lit(0))
    return u.select("seq", "asset_id", "market", "kind", "part2", "side", F.col("price").cast("double").alias("price"), F.greatest(levels, F.lit(0)).alias("levels"))


def feed_messages(spark, sf):
    """Ticks as reference-feed messages: quotes, trades, depth arrays, compact depth."""
    t = m.ticks(spark, sf)
    s = F.lit("BTCUSDT").alias("s")
    price = F.format_string("%.2f", F.col("mid") * 100)
    ask = F.format_string("%.2f", F.col("mid") * 100 + 1)
    size = F.col("k").cast("string")
    quote = F.struct(s, F.col("seq").alias("u"), price.alias("b"), ask.alias("a"))
    trade = F.struct(s, price.alias("p"), size.alias("q"), (F.col("k") % 2 == 0).alias("m"), F.col("seq").alias("T"))
    side = lambda p: F.array(F.array(p, size), F.array(F.lit("bad")), F.array(p, F.lit("7")))
    levels = F.struct(F.col("seq").alias("lastUpdateId"), side(price).alias("bids"), side(ask).alias("asks"))
    compact = F.struct(
        F.lit(True).alias("compact_depth_features"), F.lit("BTCUSDT").alias("asset_id"), F.col("mid").alias("best_bid"),
        F.col("k").cast("double").alias("cum_bid_depth_top5"),
    )
    line = (
        F.when(F.col("event_type") == "view", F.to_json(F.struct(F.lit("btcusdt@bookTicker").alias("stream"), quote.alias("data"))))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct(F.lit("btcusdt@aggTrade").alias("stream"), trade.alias("data"))))
        .when(F.col("event_type") == "click", F.to_json(F.struct(F.lit("btcusdt@depth5@100ms").alias("stream"), levels.alias("data"))))
        .when(F.col("event_type") == "signup", F.to_json(F.struct(F.lit("btcusdt@depth").alias("stream"), compact.alias("data"))))
        .otherwise(F.lit('{"stream":"x"}'))
    )
    return t.select("recv_ns", "seq", line.alias("message"))


def feed_lines(spark, sf):
    return normalize.parse_feed_messages(feed_messages(spark, sf))


@query(
    "feed_quotes",
    with_ctes(TICKS, """SELECT seq, recv_ns, 'feed' AS source, 'btcusdt' AS asset_id, seq AS update_id, round(mid * 100, 2) AS best_bid, round(mid * 100 + 1, 2) AS best_ask,
                        round(round(mid * 100 + 1, 2) - round(mid * 100, 2), 6) AS spread FROM ticks WHERE event_type = 'view'"""),
)
def feed_quotes_query(spark, sf):
    return normalize.feed_quotes(feed_lines(spark, sf), "feed").withColumn("spread", F.round("spread", 6))


@query(
    "feed_trades",
    with_ctes(TICKS, """SELECT seq, recv_ns, 'btcusdt' AS asset_id, seq * 1000000 AS exchange_ts, round(mid * 100, 2) AS price, CAST(k AS DOUBLE) AS size,
                        CASE WHEN k % 2 = 0 THEN 'SELL' ELSE 'BUY' END AS side FROM ticks WHERE event_type = 'purchase'"""),
)
def feed_trades_query(spark, sf):
    return normalize.feed_trades(feed_lines(spark, sf), "feed").select("seq", "recv_ns", "asset_id", "exchange_ts", "price", "size", "side")


@query(
    "feed_depth",
    with_ctes(TICKS, """SELECT seq, 'btcusdt' AS asset_id, round(mid * 100, 2) AS best_bid, 2 AS total_bid_levels,
                        CAST(k + 7 AS DOUBLE) AS cum_bid_depth_top5, CAST(NULL AS DOUBLE) AS cum_bid_depth_top10 FROM ticks WHERE event_type = 'click'
                        UNION ALL SELECT seq, 'btcusdt', mid, NULL, CAST(k AS DOUBLE), NULL FROM ticks WHERE event_type = 'signup'"""),
)
def feed_depth_query(spark, sf):
    return normalize.feed_book(feed_lines(spark, sf), "feed").select(
        "seq", "asset_id", "best_bid", "total_bid_levels", "cum_bid_depth_top5", "cum_bid_depth_top10"
    )


def own_messages(spark, sf):
    t = m.ticks(spark, sf)
    body = F.struct(
        F.when(F.col("event_type") == "purchase", "trade").otherwise("order").alias("event_type"), F.col("seq").cast("string").alias("id"),
        F.col("market_id").alias("market"), "asset_id", F.lit("BUY").alias("side"), F.format_string("%.2f", "mid").alias("price"),
        F.col("k").cast("string").alias("original_size"), F.lit("0").alias("size_matched"), F.col("k").cast("string").alias("size"),
        F.lit("MATCHED").alias("status"), F.lit("PLACEMENT").alias("type"), F.lit("17").alias("timestamp"),
    )
    return t.where(F.col("event_type").isin("purchase", "error")).select("recv_ns", "seq", F.to_json(body).alias("message"))


@query(
    "own_orders",
    with_ctes(TICKS, """SELECT CAST(seq AS VARCHAR) AS order_id, market_id AS market, asset_id, mid AS price, CAST(k AS DOUBLE) AS original_size,
                        'PLACEMENT' AS order_type, 17::BIGINT AS exchange_ts, recv_ns FROM ticks WHERE event_type = 'error'"""),
)
def own_orders_query(spark, sf):
    return normalize.own_orders(normalize.parse_own_messages(own_messages(spark, sf))).select("order_id", "market", "asset_id", "price", "original_size", "order_type", "exchange_ts", "recv_ns")


@query(
    "own_trades",
    with_ctes(TICKS, """SELECT CAST(seq AS VARCHAR) AS trade_id, asset_id, mid AS price, CAST(k AS DOUBLE) AS size, 'MATCHED' AS status, recv_ns
                        FROM ticks WHERE event_type = 'purchase'"""),
)
def own_trades_query(spark, sf):
    return normalize.own_trades(normalize.parse_own_messages(own_messages(spark, sf))).select("trade_id", "asset_id", "price", "size", "status", "recv_ns")


@query(
    "relevant_messages",
    with_ctes(TICKS, "SELECT seq FROM ticks WHERE asset_id IN (SELECT asset_id FROM ticks WHERE k > 95) AND event_type = 'click'"),
)
def relevant_query(spark, sf):
    t = m.ticks(spark, sf)
    clicks = t.where("event_type = 'click'").select("seq", F.array("asset_id", F.lit("none")).alias("assets"))
    return relevant_events(clicks, t.where("k > 95"), "assets", ["seq"]).select("seq")


@query(
    "nested_event_log",
    with_ctes(TICKS, "SELECT seq, k AS inner_k FROM ticks WHERE event_type = 'view'"),
)
def event_log_query(spark, sf):
    t = m.ticks(spark, sf)
    good = F.to_json(F.struct(F.col("event_type").alias("event"), F.struct(F.col("k").alias("k")).alias("prediction"), "seq"))
    lines = t.select(F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(good).alias("value"))
    rows = raw.read_event_log(lines, "event string, seq long, prediction struct<k:long>", "view")
    return rows.select("seq", F.col("prediction.k").alias("inner_k"))


# ---- canonical tables ---------------------------------------------------------------


def raw_book(spark, sf):
    """Ticks as a sparse book table whose ids hide in the source text."""
    t = m.ticks(spark, sf)
    slug = F.concat(F.lit("venue:btc-updown-5m-"), (F.floor(F.col("recv_ns") / 300e9) * 300).cast("string"))
    return t.select(
        "recv_ns", "seq", "asset_id", F.when(F.col("k") % 3 == 0, slug).otherwise("venue").alias("source"),
        F.when(F.col("k") % 3 == 1, F.col("market_id")).alias("condition_id"),
        F.when(F.col("k") % 10 != 9, F.col("mid") - 0.01).alias("best_bid"), (F.col("mid") + 0.01).alias("best_ask"),
        (F.col("recv_ns") + F.col("k") * 5_000_000_000).alias("expiry_ns"),
    )


RAW_BOOK = TICKS + f""", c AS (
  SELECT *, recv_ns // 300000000000 * 300 AS slug_start, mid - 0.01 AS bid, mid + 0.01 AS ask,
         CASE WHEN k % 3 = 0 THEN (recv_ns // 300000000000 * 300 + 300) * 1000000000 ELSE recv_ns + k * 5000000000 END AS expiry FROM ticks WHERE k % 10 <> 9)"""


@query(
    "canonical_book",
    with_ctes(
        RAW_BOOK,
        """SELECT seq, CASE WHEN k % 3 = 0 THEN 'btc-updown-5m-' || slug_start WHEN k % 3 = 1 THEN market_id ELSE 'asset:' || asset_id END AS market_id,
                  CASE WHEN k % 3 = 0 THEN 'BTC' ELSE 'UNKNOWN' END AS symbol, CASE WHEN k % 3 = 0 THEN slug_start * 1000000000 END AS start_ns,
                  expiry AS expiry_ns, round((bid + ask) / 2, 9) AS current_mid, round((ask - bid) / ((bid + ask) / 2), 9) AS relative_spread,
                  CASE WHEN (expiry - recv_ns) > 180000000000 THEN '>180s' WHEN (expiry - recv_ns) > 60000000000 THEN '60-180s'
                       WHEN (expiry - recv_ns) > 30000000000 THEN '30-60s' WHEN (expiry - recv_ns) > 10000000000 THEN '10-30s' ELSE '<10s' END AS expiry_bucket,
                  CASE WHEN (expiry - recv_ns) > 180000000000 THEN 'early' WHEN (expiry - recv_ns) > 30000000000 THEN 'mid' ELSE 'tail' END AS market_phase
           FROM c""",
    ),
)
def canonical_query(spark, sf):
    return canonical.canonical_book(raw_book(spark, sf)).select(
        "seq", "market_id", "symbol", "start_ns", "expiry_ns", F.round("current_mid", 9).alias("current_mid"),
        F.round("relative_spread", 9).alias("relative_spread"), "expiry_bucket", "market_phase",
    )


@query(
    "scoped_lifecycle_book",
    with_ctes(
        RAW_BOOK,
        """SELECT seq FROM c WHERE k % 3 = 0 AND recv_ns >= slug_start * 1000000000 + 2000000000 AND recv_ns + 10000000000 <= expiry""",
    ),
)
def scope_query(spark, sf):
    book = canonical.scope(canonical.canonical_book(raw_book(spark, sf)), ["btc"])
    return canonical.lifecycle_filter(book).select("seq")


@query(
    "canonical_trades",
    with_ctes(
        TICKS,
        """SELECT seq, 'asset:' || asset_id AS market_id, CASE WHEN event_type = 'purchase' THEN 'BUY' WHEN event_type = 'error' THEN 'ASK' ELSE '' END AS side,
                  CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE WHEN event_type = 'error' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS signed_side, mid AS price FROM ticks""",
    ),
)
def canonical_trades_query(spark, sf):
    side = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "error", "Ask").otherwise("")
    t = m.ticks(spark, sf).select("recv_ns", "seq", "asset_id", side.alias("side"), F.col("mid").alias("price"))
    return canonical.canonical_trades(t).select("seq", "market_id", "side", "signed_side", "price")


@query(
    "reference_book_state",
    with_ctes(
        TICKS
        + """, q AS (SELECT seq, recv_ns, mid, CASE WHEN event_type = 'click' THEN CAST(k AS DOUBLE) END AS depth, event_type FROM ticks
             WHERE event_type IN ('view', 'click'))""",
        """SELECT a.seq, round(a.mid, 9) AS ref_mid, (SELECT arg_max(d.depth, d.recv_ns) FROM q d WHERE d.event_type = 'click'
             AND d.recv_ns <= a.recv_ns AND d.recv_ns >= a.recv_ns - 2000000000) AS ref_cum_bid_depth_top5 FROM q a""",
    ),
)
def reference_book_query(spark, sf):
    t = m.ticks(spark, sf)
    cols = ["recv_ns", "seq", F.lit("btcusdt").alias("asset_id"), (F.col("mid") - 0.01).alias("best_bid"), (F.col("mid") + 0.01).alias("best_ask")]
    depth_rows = t.where("event_type = 'click'").select(*cols, F.col("k").cast("double").alias("cum_bid_depth_top5"))
    quotes = t.where("event_type = 'view'").select(*cols)
    out = canonical.reference_book(depth_rows, quotes)
    return out.select("seq", F.round("ref_mid", 9).alias("ref_mid"), "ref_cum_bid_depth_top5")


@query(
    "expiry_buckets",
    with_ctes(
        TICKS,
        """SELECT seq, CASE WHEN k % 13 = 0 THEN 'unknown' WHEN k * 3 > 180 THEN '>180s' WHEN k * 3 > 60 THEN '60-180s' WHEN k * 3 > 30 THEN '30-60s'
             WHEN k * 3 > 10 THEN '10-30s' ELSE '<10s' END AS bucket,
             CASE WHEN k % 13 = 0 THEN 'unknown' WHEN k * 3 > 180 THEN 'early' WHEN k * 3 > 30 THEN 'mid' ELSE 'tail' END AS phase FROM ticks""",
    ),
)
def expiry_query(spark, sf):
    left = F.when(F.col("k") % 13 != 0, (F.col("k") * 3).cast("double"))
    return m.ticks(spark, sf).select("seq", expiry_bucket(left).alias("bucket"), market_phase(left).alias("phase"))


# ---- order books ---------------------------------------------------------------------


ORDER_LEVELS = """levels AS (SELECT l_orderkey, floor(l_extendedprice / l_quantity) AS price, l_quantity AS size, l_returnflag = 'A' AS is_bid FROM lineitem),
b AS (SELECT l_orderkey, list({'p': price, 's': size} ORDER BY price DESC, size DESC) AS l FROM levels WHERE is_bid GROUP BY 1),
a AS (SELECT l_orderkey, list({'p': price, 's': size} ORDER BY price, size) AS l FROM levels WHERE NOT is_bid GROUP BY 1),
j AS (SELECT b.l_orderkey, b.l AS bids, a.l AS asks FROM b JOIN a USING (l_orderkey)),
s AS (SELECT *, list_sum(list_transform(bids[1:3], lambda x: x.s)) AS b3, list_sum(list_transform(asks[1:3], lambda x: x.s)) AS a3,
             list_sum(list_transform(bids[1:5], lambda x: x.p * x.s)) AS nb5, least(len(asks), 10) AS ka FROM j)"""


@query(
    "depth_features",
    "WITH " + ORDER_LEVELS + """ SELECT l_orderkey, bids[1].p AS best_bid, asks[1].p AS best_ask,
       round((bids[1].p * asks[1].s + asks[1].p * bids[1].s) / (bids[1].s + asks[1].s), 6) AS microprice,
       round((b3 - a3) / (b3 + a3), 9) AS depth_top3_imbalance, b3 AS cum_bid_depth_top3, round(nb5, 4) AS near_touch_bid_notional_5,
       round(CASE WHEN ka >= 2 THEN (asks[ka].s - asks[1].s) / (ka - 1) END, 9) AS ask_depth_slope_top10 FROM s""",
)
def depth_query(spark, sf):
    line = m.table(spark, sf, "lineitem")
    level = F.struct(F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"), F.col("l_quantity").alias("size"))
    bid = F.col("l_returnflag") == "A"
    books = line.groupBy("l_orderkey").agg(
        F.collect_list(F.when(bid, level)).alias("bids"), F.collect_list(F.when(~bid, level)).alias("asks")
    )
    sided = books.where((F.size("bids") > 0) & (F.size("asks") > 0)).select(
        "l_orderkey", depth.top_levels(F.col("bids"), 20, "bid").alias("bids"), depth.top_levels(F.col("asks"), 20, "ask").alias("asks")
    )
    top, deep = depth.top_of_book(F.col("bids"), F.col("asks")), depth.depth_features(F.col("bids"), F.col("asks"))
    return sided.select(
        "l_orderkey", top["best_bid"].alias("best_bid"), top["best_ask"].alias("best_ask"), F.round(top["microprice"], 6).alias("microprice"),
        F.round(deep["depth_top3_imbalance"], 9).alias("depth_top3_imbalance"), deep["cum_bid_depth_top3"].alias("cum_bid_depth_top3"),
        F.round(deep["near_touch_bid_notional_5"], 4).alias("near_touch_bid_notional_5"),
        F.round(deep["ask_depth_slope_top10"], 9).alias("ask_depth_slope_top10"),
    )


BOOK_SQL = """WITH ev AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS asset_id, epoch_us(l_shipdate) * 1000 AS recv_ns, l_orderkey * 8 + l_linenumber AS seq,
         l_returnflag = 'A' AS is_bid, round(l_extendedprice / l_quantity, 0) AS price,
         CASE WHEN l_linestatus = 'F' AND l_linenumber % 3 = 0 THEN 0 ELSE l_quantity END AS size FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY recv_ns, seq, price, size) AS pos FROM ev),
lv AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY asset_id, is_bid, price ORDER BY pos), 1000000000000) AS until FROM p),
st AS (SELECT e.asset_id, e.pos, e.recv_ns, e.seq,
         max(CASE WHEN l.is_bid THEN l.price END) AS bid, min(CASE WHEN NOT l.is_bid THEN l.price END) AS ask,
         count(*) FILTER (WHERE l.is_bid) AS nb, count(*) FILTER (WHERE NOT l.is_bid) AS na
       FROM p e LEFT JOIN lv l ON l.asset_id = e.asset_id AND l.pos <= e.pos AND l.until > e.pos AND l.size > 0 GROUP BY ALL)
SELECT asset_id, recv_ns, count(*) AS events, round(sum(CASE WHEN bid IS NOT NULL AND ask IS NOT NULL THEN ask - bid END), 2) AS spread_sum,
       round(sum(CASE WHEN bid IS NOT NULL AND ask IS NOT NULL THEN (ask + bid) / 2 END), 2) AS mid_sum,
       CAST(sum(nb) AS BIGINT) AS bid_levels, CAST(sum(na) AS BIGINT) AS ask_levels FROM st GROUP BY ALL"""


@query("order_book_states", BOOK_SQL)
def book_query(spark, sf):
    """One book summary per delta, summed per asset and day; nine slices an asset."""
    states = book_states(unique_deltas(spark, sf), 300 * DAY)
    return states.groupBy("asset_id", "recv_ns").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("spread"), 2).alias("spread_sum"), F.round(F.sum("midpoint"), 2).alias("mid_sum"),
        F.sum("total_bid_levels").alias("bid_levels"), F.sum("total_ask_levels").alias("ask_levels"),
    )


def unique_deltas(spark, sf):
    """The deltas with `part2` telling apart lines that share order and line number."""
    from pyspark.sql import Window

    d = m.deltas(spark, sf).withColumn("__p", F.col("price").cast("double")).withColumn("__s", F.col("size").cast("double"))
    w = Window.partitionBy("asset_id", "recv_ns", "seq").orderBy("__p", "__s")
    return d.withColumn("part2", F.row_number().over(w)).drop("__p", "__s")


# ---- instruments and dimensions ------------------------------------------------------


def listings(spark, sf):
    """Customers as listing payloads with two tokens each."""
    c = m.table(spark, sf, "customer")
    key = F.col("c_custkey")
    slug = F.when(key % 5 == 0, F.lit("other")).otherwise(
        F.concat(F.when(key % 2 == 0, "btc").otherwise("eth"), F.lit("-updown-"), F.when(key % 3 == 0, "5m").otherwise("15m"), F.lit("-"),
                 (F.lit(START) + key * 300).cast("string"))
    )
    tokens = F.to_json(F.array(F.concat(F.lit("t"), key * 2), F.concat(F.lit("t"), key * 2 + 1)))
    body = F.struct(
        key.cast("string").alias("id"), slug.alias("slug"), F.when(key % 7 == 0, F.lit("not json")).otherwise(tokens).alias("clobTokenIds"),
        F.when(key % 4 == 0, '["Up"]').otherwise('["Up","Down"]').alias("outcomes"), (key % 2 == 0).alias("active"), F.lit(False).alias("closed"),
        F.lit("2024-01-02T00:00:00Z").alias("endDate"), F.when(key % 3 == 0, "0.001").alias("orderPriceMinTickSize"),
        F.lit("0.01").alias("minimumTickSize"), F.col("c_acctbal").cast("string").alias("volume"),
    )
    return c.select(F.to_json(body).alias("payload"))


LISTED = f"""WITH c AS (SELECT c_custkey AS key, c_acctbal FROM customer WHERE c_custkey % 7 <> 0),
r AS (SELECT *, unnest([0, 1]) AS i FROM c)
SELECT 't' || (key * 2 + i) AS asset_id, CASE WHEN i = 0 THEN 'Up' WHEN key % 4 = 0 THEN '' ELSE 'Down' END AS outcome, CAST(i AS INTEGER) AS outcome_index,
       CAST(key AS VARCHAR) AS market_id, CASE WHEN key % 5 = 0 THEN '' WHEN key % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS symbol,
       CASE WHEN key % 5 = 0 THEN '' WHEN key % 3 = 0 THEN '5m' ELSE '15m' END AS period,
       CASE WHEN key % 5 = 0 THEN 1704153600 * 1000000000::BIGINT
            ELSE ({START} + key * 300 + CASE WHEN key % 3 = 0 THEN 300 ELSE 900 END) * 1000000000::BIGINT END AS expiry_ns,
       CASE WHEN key % 3 = 0 THEN 0.001::DOUBLE ELSE 0.01::DOUBLE END AS tick_size, c_acctbal AS volume FROM r"""


@query("instruments_from_listings", LISTED)
def listing_query(spark, sf):
    return instruments.from_listings(listings(spark, sf)).select(
        "asset_id", "outcome", "outcome_index", "market_id", "symbol", "period", "expiry_ns", "tick_size", "volume"
    )


@query(
    "instruments_of_dates",
    f"WITH i AS ({LISTED}), d AS (SELECT unnest(['20240101', '20240102', '20240105']) AS date, unnest([1704067200, 1704153600, 1704412800]) AS day) "
    "SELECT asset_id, date FROM i JOIN d ON expiry_ns >= day * 1000000000::BIGINT AND expiry_ns <= (day + 86400 + 900) * 1000000000::BIGINT",
)
def dates_query(spark, sf):
    dates = spark.createDataFrame([("20240101",), ("20240102",), ("20240105",)], "date string")
    return instruments.with_trading_dates(instruments.from_listings(listings(spark, sf)), dates).select("asset_id", "date")


@query(
    "instruments_from_venue",
    """SELECT 'v' || (s_suppkey * 2 + i) AS asset_id, CASE WHEN i = 0 THEN 'Yes' ELSE 'No' END AS outcome, CAST(i AS INTEGER) AS outcome_index,
       '0x' || s_suppkey AS market_id, 'BTC' AS symbol, 0.5::DOUBLE AS best_bid_snapshot
       FROM supplier, (SELECT unnest([0, 1]) AS i) WHERE NOT (s_suppkey % 3 = 0 AND i = 1)""",
)
def venue_query(spark, sf):
    s = m.table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    token = lambda i, o: F.struct(
        F.when(F.lit(i == 1) & (key % 3 == 0), "").otherwise(F.concat(F.lit("v"), key * 2 + i)).alias("token_id"),
        F.lit(o).alias("outcome"), F.lit("0.5").alias("price"),
    )
    body = F.struct(
        F.concat(F.lit("0x"), key).alias("condition_id"), F.concat(F.lit("btc-updown-5m-"), F.lit(START) + key).alias("market_slug"),
        F.array(token(0, "Yes"), token(1, "No")).alias("tokens"),
    )
    return instruments.from_venue(s.select(F.to_json(body).alias("payload"))).select(
        "asset_id", "outcome", "outcome_index", "market_id", "symbol", "best_bid_snapshot"
    )


@query(
    "fill_unknown_assets",
    """SELECT c_custkey AS id, 'customer' AS origin FROM customer WHERE c_custkey % 2 = 0
       UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""",
)
def unknown_query(spark, sf):
    known = m.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("origin"))
    other = m.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("origin"))
    return fill_unknown(known, other, "id")


@query(
    "dimension_enrichment",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus IN ('F') THEN coalesce(c_mktsegment, NULL) ELSE o_orderstatus END AS segment,
              CASE WHEN o_orderkey % 2 = 0 THEN c_acctbal ELSE o_totalprice END AS balance, n_name AS nation
       FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def enrich_query(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))
    facts = m.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", status.alias("segment"), F.when(F.col("o_orderkey") % 2 != 0, F.col("o_totalprice")).alias("balance")
    )
    c, n = m.table(spark, sf, "customer"), m.table(spark, sf, "nation")
    dim = c.where("c_custkey % 10 <> 0").join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("n_name").alias("nation")
    )
    return enrich(facts, dim, "o_custkey", ["segment", "balance", "nation"], ["segment"])


@query(
    "active_tagged_markets",
    """SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND (lower(c_mktsegment) LIKE '%build%' OR lower(c_mktsegment) LIKE '%auto%')""",
)
def active_query(spark, sf):
    c = m.table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_custkey") % 2 == 0).alias("active"), (F.col("c_custkey") % 3 == 0).alias("closed"), F.col("c_mktsegment").alias("tags")
    )
    return instruments.active_markets(c, ["build", "AUTO"]).select("c_custkey")


@query(
    "tag_search",
    "SELECT p_partkey FROM part WHERE lower(p_name || ' ' || p_type) LIKE '%ring%' OR lower(p_name || ' ' || p_type) LIKE '%economy%'",
)
def tag_query(spark, sf):
    return instruments.tagged_markets(m.table(spark, sf, "part"), ["p_name", "p_type"], ["Ring", "economy"]).select("p_partkey")


@query(
    "market_of_asset",
    """SELECT 't' || (c_custkey * 2 + i) AS asset_id, c_mktsegment FROM customer, (SELECT unnest([0, 1]) AS i) WHERE (c_custkey * 2 + i) % 5 = 0""",
)
def market_of_asset_query(spark, sf):
    c = m.table(spark, sf, "customer").select(F.col("c_custkey").alias("market_id"), "c_mktsegment")
    pairs = c.select("market_id", F.explode(F.array(F.col("market_id") * 2, F.col("market_id") * 2 + 1)).alias("token"))
    bridge = pairs.select("market_id", F.concat(F.lit("t"), "token").alias("asset_id"), "token")
    return instruments.markets_of_assets(bridge.where("token % 5 = 0").select("asset_id"), bridge.select("market_id", "asset_id"), c).select(
        "asset_id", "c_mktsegment"
    )


@query(
    "known_slugs",
    with_ctes(
        TICKS
        + """, b AS (SELECT min(recv_ns) // 1000000000 - 3600 AS lo, max(recv_ns) // 1000000000 + 3600 AS hi FROM ticks),
        p AS (SELECT unnest(['btc', 'btc', 'eth', 'eth']) AS sym, unnest(['5m', '15m', '5m', '15m']) AS per, unnest([300, 900, 300, 900]) AS sec)""",
        """SELECT sym || '-updown-' || per || '-' || t AS slug FROM p, b, LATERAL (SELECT unnest(range(lo - lo % sec, hi + 1, sec)) AS t)
           UNION SELECT 'm-' || k FROM ticks WHERE event_type = 'view'""",
    ),
)
def slugs_query(spark, sf):
    t = m.ticks(spark, sf).withColumn("source", F.when(F.col("event_type") == "view", F.concat(F.lit("venue:m-"), "k")).otherwise("venue"))
    return instruments.known_slugs([t], "venue")


@query(
    "condition_ids",
    "SELECT DISTINCT '0x' || (l_suppkey % 50) AS condition_id FROM lineitem WHERE l_linestatus = 'F'",
)
def condition_query(spark, sf):
    line = m.table(spark, sf, "lineitem")
    market = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("0x"), F.col("l_suppkey") % 50)).otherwise("none")
    return instruments.known_conditions([line.select(market.alias("market"))])


# ---- sets and scalars ----------------------------------------------------------------


@query(
    "union_relaxed",
    """SELECT CAST(c_custkey AS DOUBLE) AS id, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
       UNION ALL SELECT s_suppkey + 0.5, NULL, s_acctbal FROM supplier""",
)
def union_query(spark, sf):
    a = m.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    b = m.table(spark, sf, "supplier").select((F.col("s_suppkey") + 0.5).cast("double").alias("id"), F.col("s_acctbal").alias("balance"))
    return union_relaxed([a, None, b])


@query("union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_query(spark, sf):
    a = m.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    return union_distinct([a, m.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))])


@query(
    "selection_overlap",
    """WITH a AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000), b AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
       SELECT 'common' AS part, count(*) AS n FROM a SEMI JOIN b USING (o_orderkey) UNION ALL
       SELECT 'only_a', count(*) FROM a ANTI JOIN b USING (o_orderkey) UNION ALL SELECT 'only_b', count(*) FROM b ANTI JOIN a USING (o_orderkey)""",
)
def overlap_query(spark, sf):
    o = m.table(spark, sf, "orders")
    parts = overlap(o.where("o_totalprice > 200000"), o.where("o_orderstatus = 'F'"), ["o_orderkey"])
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "safe_casts_and_names",
    r"""SELECT p_partkey, left(regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9_.=-]+', '_', 'g'), 180) || '-' || left(md5(p_name || '/' || p_brand), 16) AS safe_name,
        CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN CAST(p_size AS DOUBLE) END AS number FROM part""",
)
def cast_query(spark, sf):
    p = m.table(spark, sf, "part")
    messy = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_size").cast("string")).otherwise("n/a")
    return p.select("p_partkey", text.partition_name(F.concat_ws("/", "p_name", "p_brand")).alias("safe_name"), text.safe_double(messy).alias("number"))


@query(
    "time_partitions",
    with_ctes(TICKS, "SELECT strftime(to_timestamp(recv_ns // 1000000000) AT TIME ZONE 'UTC', '%Y%m%d') AS date, count(*) AS rows, min(recv_ns) AS lo FROM ticks GROUP BY 1"),
)
def date_query(spark, sf):
    return m.ticks(spark, sf).groupBy(text.utc_date(F.col("recv_ns")).alias("date")).agg(F.count(F.lit(1)).alias("rows"), F.min("recv_ns").alias("lo"))
