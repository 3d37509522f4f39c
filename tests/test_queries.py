"""Registered queries against their SQL on the smallest tables.

All of them with TICKLOOM_ALL=1, a cross-section otherwise.
"""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tickloom.workload.check import compare, connect

SF = "/root/testdata/sf0.001"
SOME = [
    "markout_by_bucket", "change_events_debounced", "asof_backward_keyed", "asof_backward_global", "own_returns", "forward_interval_min",
    "book_event_features", "trade_flow_features", "ewma_features", "rank_buckets", "first_leg_fill", "two_leg_fill", "message_routing",
    "feed_depth", "canonical_book", "depth_features", "order_book_states", "instruments_from_listings", "chronological_split",
    "policy_grid", "two_stage_policy_search", "calibration_tables", "live_threshold_signals", "stream_signals", "stream_outcomes",
]
NAMES = sorted(entry.queries()) if os.environ.get("TICKLOOM_ALL") else SOME

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    ok, message = compare(spark, duck, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0
