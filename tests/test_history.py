"""History operators on hand-made rows: ties, empty windows, null times."""

import datetime as dt

from pyspark.sql import functions as F

from sluice.operators import history as H
from sluice.operators import tasks as G

T0 = dt.datetime(2024, 1, 30, 12, 0, 0)


def _execs(spark, rows):
    return spark.createDataFrame(
        rows, "id long, session_id string, agent_type string, status string, execution_time_ms double, "
              "tokens_used int, model_used string, created_at timestamp_ntz")


def test_ties_on_time_break_on_id_desc(spark):
    df = _execs(spark, [(1, "s", "debugger", "completed", 1.0, 1, "m", T0),
                        (2, "s", "debugger", "completed", 1.0, 1, "m", T0),
                        (3, "s", "debugger", "completed", 1.0, 1, "m", T0 - dt.timedelta(seconds=1))])
    assert [r.id for r in H.execution_history(df, limit=2).collect()] == [2, 1]
    assert [r.created_at for r in H.execution_history(df, limit=1).collect()] == ["2024-01-30T12:00:00"]
    hist = df.withColumn("user_message", F.lit("u")).withColumn("agent_response", F.lit("a"))
    top = H.latest_per_session(hist, 2).orderBy("rn").collect()
    assert [(r.id, r.rn) for r in top] == [(2, 1), (1, 2)]


def test_stats_empty_window_and_null_times(spark):
    df = _execs(spark, [(1, "s", "debugger", "completed", None, 5, "m", T0),
                        (2, "s", "debugger", "failed", None, 7, None, T0)])
    r = H.execution_stats(df, "2024-01-31 00:00:00", 7).first()
    assert (r.total_executions, r.successful, r.failed, r.average_time_ms, r.total_tokens) == (2, 1, 1, 0.0, 12)
    e = H.execution_stats(df, "2024-03-01 00:00:00", 7).first()
    assert (e.total_executions, e.successful, e.failed, e.average_time_ms, e.total_tokens) == (0, 0, 0, 0.0, 0)
    assert H.execution_stats(df, "2024-01-31 00:00:00", 7, session_id="other").first().total_executions == 0


def test_cube_tells_null_model_from_subtotal(spark):
    df = _execs(spark, [(1, "s", "debugger", "failed", 1.0, 1, None, T0),
                        (2, "s", "debugger", "completed", 3.0, 1, "m", T0)])
    rows = {(r.agent_type, r.model_used, r.grouping_id): r.total_executions
            for r in H.usage_by_dimension(df).collect()}
    assert rows[("debugger", None, 0)] == 1          # a real NULL model
    assert rows[("debugger", None, 1)] == 2          # subtotal over models
    assert rows[(None, None, 3)] == 2                # grand total


def test_filter_by_map_null_means_is_null(spark):
    df = _execs(spark, [(1, "s", "debugger", "failed", 1.0, 1, None, T0),
                        (2, "s", "debugger", "completed", 3.0, 1, "m", T0)])
    assert [r.id for r in H.filter_by_map(df, {"model_used": None}).collect()] == [1]
    assert H.filter_by_map(df, {}).count() == 2


def test_unfold_empty_task_list(spark):
    req = spark.createDataFrame([(1, [])], "request_id long, tasks array<struct<task_id:string>>")
    assert G.unfold_requests(req).count() == 0
