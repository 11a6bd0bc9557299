"""Edge rows found in review."""

import pytest
from pyspark.sql import functions as F

from sluice.functions.text import ustrip
from sluice.operators import cache as H
from sluice.operators import inference as I
from sluice.operators import tasks as G
from sluice.plans.stubs import stub_providers
from sluice.sources.tables import sql_with_params


def test_similar_entries_skip_null_and_zero_vectors(spark):
    kind = "entry_id long, embedding array<float>"
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [0.5, 0.5]), (6, [None, 1.0]), (7, [0.0, 1.0]), (8, [-1.0, 0.0])]
    entries = spark.createDataFrame(rows, kind).repartition(3)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, embedding array<float>")
    got = [(r["query_id"], r["entry_id"]) for r in H.similar_entries(queries, entries, k=5).orderBy("rank").collect()]
    assert got == [(1, 1), (1, 2), (1, 5), (1, 7), (1, 8)]


@pytest.mark.parametrize("limit", [64, 2])
def test_string_request_ids_and_both_ordering_paths(spark, limit):
    rows = [("req-a", i + 1, f"t{i}", "debugger", i % 3, f"t{i - 1}" if i else None) for i in range(70)]
    tasks = spark.createDataFrame(rows, "request_id string, pos int, task_id string, task_type string, priority int, depends_on string")
    got = G.order_tasks(G.plan_requests(tasks, array_limit=limit)).orderBy("ord").collect()
    assert [r["task_id"] for r in got] == [f"t{i}" for i in range(70)] and got[0]["request_id"] == "req-a"
    assert [tuple(r) for r in G.execution_mode(tasks).collect()] == [("req-a", 70, True, "sequential")]


def test_unknown_agent_type_gets_an_error(spark):
    reqs = spark.createDataFrame([(1, "s", "planner", "x = 1", "python", None, None, None, None), (2, "s", "debugger", "x = 1", "python", None, None, None, None)],
                                 "request_id long, session_id string, agent_type string, code string, language string, error_message string, analysis_type string, doc_type string, style string")
    responses, history, _ = I.agent_job(reqs, stub_providers())
    got = {r["request_id"]: r for r in responses.collect()}
    assert got[1]["success"] is False and got[1]["error"] == "Unknown agent type: planner"
    assert got[2]["success"] and history.count() == 1


def test_sql_is_read_only(spark):
    assert sql_with_params(spark, "WITH a AS (SELECT ? AS x) SELECT 'insert into' AS t, x FROM a", [1]).count() == 1
    spark.range(1).createOrReplaceTempView("tt")
    for text in ("FROM (SELECT 4/2 AS a) INSERT INTO tt SELECT a/2", "EXECUTE IMMEDIATE 'DROP VIEW tt'", "BEGIN DROP VIEW tt; END",
                 "FROM tt INSERT INTO tt SELECT id INSERT INTO tt SELECT id + 1", "DROP TABLE x", "INSERT INTO x VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "-- select\nCREATE TABLE x (a INT)", "SET a=b"):
        with pytest.raises(ValueError):
            sql_with_params(spark, text, [])


def test_words_of_commands_are_no_commands(spark):
    got = spark.range(3).withColumnRenamed("id", "update")
    assert sql_with_params(spark, "SELECT 1 AS x -- not insert into anything", []).first()[0] == 1
    assert sql_with_params(spark, "SELECT `update` /* delete from x */ FROM {t} WHERE 'insert into' <> ?", ["merge into"], t=got).count() == 3
    assert sql_with_params(spark, "FROM {t} SELECT count(*)", [], t=got).first()[0] == 3


def test_strip_covers_information_separators(spark):
    df = spark.createDataFrame([("\x1c\t a\x1d b \x1f\u2003",)], "t string")
    assert df.select(ustrip(F.col("t"))).first()[0] == "\x1c\t a\x1d b \x1f\u2003".strip()
