"""The same views of the driver's tables, as SQL for the oracle."""

HOUR = 3600 * 1_000_000_000

TICKS = """ticks AS (
  SELECT event_id AS seq, epoch_us(ts) * 1000 AS recv_ns, 'A' || user_id AS asset_id, user_id,
         'm' || (user_id // 2) AS market_id, CASE WHEN user_id % 2 = 0 THEN 'Up' ELSE 'Down' END AS outcome,
         event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, props,
         CAST(2 + CAST(round(value * 100) AS BIGINT) % 97 AS DOUBLE) / 100 AS mid
  FROM events)"""

BOOK = (
    TICKS
    + """, book AS (
  SELECT recv_ns, seq, market_id, asset_id, outcome, 'BTC' AS symbol, mid - 0.01 AS best_bid, mid + 0.01 AS best_ask,
         mid AS current_mid, 0.01 + CAST(k % 5 AS DOUBLE) / 100 AS current_spread,
         CAST((k % 21) - 10 AS DOUBLE) / 10 AS top1_imbalance,
         CAST(k % 7 AS INTEGER) AS total_bid_levels, CAST(k % 11 AS INTEGER) AS total_ask_levels,
         CASE WHEN k % 4 <> 0 THEN CAST(k - 50 AS DOUBLE) / 50 END AS depth_top10_imbalance, 0.01::DOUBLE AS tick_size
  FROM ticks)"""
)

TRADES = """, trades AS (
  SELECT recv_ns, seq, market_id, asset_id, mid AS price, CAST(k + 1 AS DOUBLE) AS size,
         CASE WHEN event_type = 'purchase' THEN 'BUY' ELSE 'SELL' END AS side,
         CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS signed_side
  FROM ticks WHERE event_type IN ('purchase', 'error'))"""

REFERENCE = """, ref AS (SELECT recv_ns, seq, mid AS ref_mid FROM ticks WHERE event_type = 'view')"""

SCORED = (
    BOOK
    + """, scored AS (
  SELECT b.recv_ns, b.seq, b.market_id, b.asset_id, b.outcome, 'A' || xor(t.user_id, 1) AS opposite_asset_id,
         b.best_bid, b.best_ask, b.current_spread,
         CAST(b.seq % 400 AS DOUBLE) AS time_to_expiry_seconds,
         CAST((b.seq * 7919) % 1000 AS DOUBLE) / 1000 AS p_fill,
         CAST((b.seq * 104729) % 1000 AS DOUBLE) / 1000 / 10 - 0.05 AS pred_unwind_profit,
         CAST((b.seq * 31) % 100 AS DOUBLE) AS profit_ticks,
         CAST((b.seq * 31) % 100 AS DOUBLE) / 1000 - 0.04 AS profit,
         CASE WHEN (b.seq * 17) % 3 <> 0 THEN 'enter' ELSE 'skip' END AS fill_cls
  FROM book b JOIN ticks t USING (seq))"""
)


def with_ctes(base: str, body: str) -> str:
    """A statement on top of the base views."""
    return f"WITH RECURSIVE {base}\n{body}"
