"""Physical-plan properties the scale design relies on."""

import pytest

from sluice.plans.registry import all_queries

from .conftest import SMOKE_DIR

QUERIES = all_queries()


def _plan(spark, key):
    df = QUERIES[key](spark, SMOKE_DIR)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cross_or_nested_loop_join(spark, key):
    plan = _plan(spark, key)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_history_filters_reach_the_scan(spark):
    plan = QUERIES["execution_stats_by_session"](spark, SMOKE_DIR)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan
    assert "partial_count" in plan           # map-side combine before the shuffle


def test_top_n_per_session_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in _plan(spark, "latest_per_session")


def test_single_session_history_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in _plan(spark, "conversation_history")


def test_code_operators_do_not_shuffle_the_corpus(spark):
    for key in ("extract_functions", "extract_imports", "syntax_findings", "quality_metrics"):
        plan = _plan(spark, key)
        # the only exchange allowed is the round-robin spread of a small input
        assert "Exchange hashpartitioning" not in plan, key
