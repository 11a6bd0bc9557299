"""Task ordering: array fold, heap path and the Python restatement agree."""

import random

import pytest

from sluice.operators import tasks as G

from . import twins

HAND = {
    1: [("a", [], 0), ("b", ["a"], 0), ("c", ["b"], 2)],                 # chain; priority breaks it
    2: [("t3", ["t4"], 0), ("t4", ["t3"], 1), ("t5", [], 0)],            # cycle
    3: [("t1", [], 0), ("t2", ["t1"], 0), ("t1", [], 5)],                # repeated id
    4: [("s", ["s"], 0)],                                                # self-dependency
    5: [("x", ["missing"], 0), ("y", [], 1)],                            # unknown dependency
    6: [("p", [], 1), ("q", [], 1), ("r", [], 0)],                       # independent
}


def _random_requests(n_requests=150, seed=7):
    rnd = random.Random(seed)
    out = {}
    for rid in range(100, 100 + n_requests):
        n = rnd.randint(1, 12)
        rows = []
        for pos in range(1, n + 1):
            tid = f"t{rnd.randint(1, n)}" if rnd.random() < 0.2 else f"t{pos}"
            deps = [f"t{rnd.randint(1, n + 1)}" for _ in range(rnd.choice([0, 0, 1, 2]))]
            rows.append((tid, deps, rnd.randint(0, 2)))
        out[rid] = rows
    return out


def _frame(spark, requests):
    rows = [(rid, pos, tid, "debugger", prio, deps)
            for rid, rs in requests.items() for pos, (tid, deps, prio) in enumerate(rs, 1)]
    return spark.createDataFrame(rows, "request_id long, pos int, task_id string, task_type string, "
                                       "priority int, depends_on array<string>")


@pytest.mark.parametrize("limit", [64, 0])   # 0 sends every request down the heap path
def test_order_matches_python(spark, limit):
    reqs = {**HAND, **_random_requests()}
    plan = G.plan_requests(_frame(spark, reqs), array_limit=limit)
    got = {}
    for r in G.order_tasks(plan).collect():
        got.setdefault(r.request_id, []).append((r.ord, r.pos, r.cycle))
    for rid, rows in reqs.items():
        order, cycle = twins.order_tasks(rows)
        want = [(k + 1, i + 1, cycle) for k, i in enumerate(order)]
        assert sorted(got[rid]) == want, (rid, rows)


def test_priority_order_is_stable_and_can_break_dependencies(spark):
    plan = G.with_priority_order(G.plan_requests(_frame(spark, {1: HAND[1]})))
    rows = sorted(G.priority_order(plan).collect(), key=lambda r: r.exec_ord)
    assert [r.task_id for r in rows] == ["c", "a", "b"]
    bad = G.dependency_violations(plan).collect()
    assert [(r.task_id, r.depends_on) for r in bad] == [("c", "b")]


def test_execution_mode(spark):
    modes = {r.request_id: r.mode for r in G.execution_mode(_frame(spark, HAND)).collect()}
    assert modes[6] == "parallel" and modes[1] == "sequential"


def test_rollup_counts_and_summary(spark):
    rows = [(9, "s", 2, True, 1, 2, "b", "generate_docs", "failed", None, "Unknown task type: generate_docs", 102.0),
            (9, "s", 2, True, 2, 1, "a", "debugger", "completed", "fine", None, 1.005)]
    results = spark.createDataFrame(rows, "request_id long, session_id string, n_rows int, parallel_requested boolean, exec_ord int, pos int, "
                                          "task_id string, task_type string, status string, result string, error string, execution_time_ms double")
    r = G.orchestration_rollup(results.repartition(2)).first()
    assert (r.total_tasks, r.completed, r.failed, r.success, r.status) == (2, 1, 1, False, "partial")
    assert (r.total_time_ms, r.pseudo_tokens) == (103.005, 10.0)
    assert r.summary.startswith("### Task 1: b\nStatus: failed\nTime: 102.00ms\nResult:\nUnknown task type: generate_docs")


def test_one_aggregation_whatever_the_sizes(spark):
    """One shuffle and one gathering of the lists, read once."""
    rows = [(1, i + 1, f"t{i}", "debugger", 0, f"t{i + 1}") for i in range(80)] + [(2, 1, "a", "debugger", 0, None)]
    tasks = spark.createDataFrame(rows, "request_id long, pos int, task_id string, task_type string, priority int, depends_on string")
    for out in (G.order_tasks(G.plan_requests(tasks)), G.dependency_violations(G.plan_requests(tasks))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("partial_collect_list") == 1
        assert "Union" not in plan and "Join" not in plan


def test_orchestrate_runs_tasks_through_the_agents(spark):
    import pandas as pd

    from sluice.operators import inference as I

    kind = ("request_id long, session_id string, pos int, task_id string, task_type string, priority int, depends_on array<string>, code string, "
            "language string, error_message string, analysis_type string, doc_type string, style string")
    rows = [(1, "s", 1, "a", "debugger", 0, ["b"], "x = 1", "python", None, None, None, None),
            (1, "s", 2, "b", "analyzer", 5, [], None, None, None, None, None, None),
            (1, "s", 3, "b", "analyzer", 0, [], "dropped: its id is taken", None, None, None, None, None),
            (1, "s", 4, "c", "planner", 0, [], "x", None, None, None, None, None),
            (2, "t", 1, "a", "docs_generator", 0, None, "x = 2", "python", None, None, None, None),
            (3, "u", 1, "a", "debugger", 0, None, "BAD", "python", None, None, None, None)]

    def factory():
        def fn(prompts):
            if prompts.str.contains("BAD").any():
                raise I.RunError("no quota")
            return pd.Series(["fine"] * len(prompts), index=prompts.index)
        return fn

    results, histories, executions = G.orchestrate(spark.createDataFrame(rows, kind), [("One", factory)], timed=False)
    got = {(r.request_id, r.exec_ord): (r.task_id, r.pos, r.status, r.result, r.error) for r in results.collect()}
    assert got == {(1, 1): ("b", 2, "failed", None, "No code provided"), (1, 2): ("a", 1, "completed", "fine", None),
                   (1, 3): ("c", 4, "failed", None, "Unknown task type: planner"), (2, 1): ("a", 1, "completed", "fine", None),
                   (3, 1): ("a", 1, "failed", None, "Debugger error: no quota")}
    rolled = G.orchestration_rollup(results)
    roll = {r.request_id: r for r in rolled.collect()}
    assert (roll[1].total_tasks, roll[1].completed, roll[1].failed, roll[1].status) == (4, 1, 2, "partial")
    assert roll[2].success and roll[2].summary == "### Task 1: a\nStatus: completed\nTime: 0.00ms\nResult:\nfine"
    history, log = G.orchestration_log(rolled)
    assert {r.user_message for r in history.collect()} == {"Execute 4 tasks", "Execute 1 tasks"}
    assert {(r.task_description, r.status) for r in log.collect()} == {
        ("Execute 4 tasks orchestration", "partial"), ("Execute 1 tasks orchestration", "completed"), ("Execute 1 tasks orchestration", "partial")}
    assert histories.count() == 2 and sorted(r.status for r in executions.collect()) == ["completed", "completed", "failed"]


def test_log_rolls_the_runs_up_once(spark):
    """Both sides of the log's join read the stored roll-up."""
    from sluice.plans.registry import all_queries

    log = all_queries()["orchestration_log"](spark, "/root/testdata/sf0.001")
    assert "collect_list" not in log._jdf.queryExecution().executedPlan().toString() and log.count() > 0
