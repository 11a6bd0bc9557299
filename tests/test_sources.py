"""File sources and log sinks on scratch folders."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from sluice.sources import files as A
from sluice.sources import sinks as S
from sluice.sources import tables as T


def _scratch():
    return tempfile.mkdtemp(prefix="sluice-test-", dir="/tmp")


def test_code_corpus_decodes_and_drops_bad_bytes(spark):
    d = _scratch()
    os.makedirs(f"{d}/pkg")
    with open(f"{d}/pkg/a.py", "wb") as f:
        f.write(b"def f(x):\n    return '\xff\xfeok'\n")
    with open(f"{d}/b.java", "wb") as f:
        f.write("class C { // été\n}".encode())
    with open(f"{d}/notes.md", "wb") as f:
        f.write(b"# not code")
    rows = {r.filename: r for r in A.scan_code_corpus(spark, d).collect()}
    assert rows["a.py"].code == "def f(x):\n    return 'ok'\n"
    assert rows["a.py"].language == "python"
    assert rows["b.java"].code == "class C { // été\n}"
    assert rows["notes.md"].language == "unknown"
    only_py = A.scan_code_corpus(spark, d, glob="*.py").collect()
    assert [r.filename for r in only_py] == ["a.py"]


def test_recent_images_top_20_newest_first(spark):
    d = _scratch()
    now = time.time()
    for i in range(25):
        p = f"{d}/img{i:02d}.png"
        with open(p, "wb") as f:
            f.write(b"\x89PNG")
        os.utime(p, (now - 1000 + i, now - 1000 + i))
    with open(f"{d}/skip.jpg", "wb") as f:
        f.write(b"x")
    rows = A.recent_images(spark, d).collect()
    assert len(rows) == 20
    assert rows[0].filename == "img24.png" and rows[-1].filename == "img05.png"
    assert rows[0].url == "/outputs/img24.png"


def test_appends_fill_defaults_and_continue_ids(spark):
    d = _scratch()
    df = spark.createDataFrame([("s1", "hi", "yo", "debugger")],
                               "session_id string, user_message string, agent_response string, agent_type string")
    S.append_conversations(df, f"{d}/conv")
    S.append_conversations(df, f"{d}/conv")
    back = spark.read.parquet(f"{d}/conv").collect()
    assert len(back) == 2 and {r.metadata_json for r in back} == {"{}"}
    assert len({r.id for r in back}) == 2
    ex = spark.createDataFrame([("s1", "debugger", "Debug x", "completed")],
                               "session_id string, agent_type string, task_description string, status string")
    S.append_executions(ex, f"{d}/exec")
    r = spark.read.parquet(f"{d}/exec").first()
    assert (r.execution_time_ms, r.tokens_used, r.model_used) == (0.0, 0, None)


def test_rewrite_without_sessions_never_touches_input(spark):
    d = _scratch()
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, session_id string")
    df.write.parquet(f"{d}/hist")
    S.rewrite_without_sessions(f"{d}/hist", spark.createDataFrame([("a",)], "session_id string"), f"{d}/hist2")
    assert [r.id for r in spark.read.parquet(f"{d}/hist2").collect()] == [2]
    assert spark.read.parquet(f"{d}/hist").count() == 3


def test_sql_with_params_binds_values(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    out = T.sql_with_params(spark, "SELECT id FROM {t} WHERE v = ?", ["y"], t=df).collect()
    assert [r.id for r in out] == [2]
    # a value that looks like SQL stays a value
    assert T.sql_with_params(spark, "SELECT id FROM {t} WHERE v = ?", ["x' OR '1'='1"], t=df).count() == 0


def test_conform_casts_and_defaults(spark):
    df = spark.createDataFrame([(1, "s")], "id int, session_id string")
    out = T.conform(df, T.EXECUTION_DDL).first()
    assert out.status == "pending" and out.tokens_used == 0 and out.execution_time_ms == 0.0


def test_scan_table_reads_parquet_and_conforms(spark):
    d = _scratch()
    spark.createDataFrame([(1, "s", "debugger", "completed")],
                          "id int, session_id string, agent_type string, status string") \
        .write.parquet(f"{d}/exec")
    out = T.scan_table(spark, f"{d}/exec", ddl=T.EXECUTION_DDL)
    assert out.columns == [f.name for f in __import__("pyspark.sql.types", fromlist=["StructType"])
                           .StructType.fromDDL(T.EXECUTION_DDL).fields]
    r = out.first()
    assert (r.id, r.tokens_used, r.execution_time_ms, r.model_used) == (1, 0, 0.0, None)


def test_ids_are_unique_over_appends_and_concurrent_writers(spark):
    from concurrent.futures import ThreadPoolExecutor

    d = _scratch()
    rows = spark.range(40).selectExpr("CONCAT('s', id) AS session_id", "'hi' AS user_message", "'yo' AS agent_response", "'debugger' AS agent_type").repartition(3)
    with ThreadPoolExecutor(6) as pool:
        stored = list(pool.map(lambda _: S.append_conversations(rows, f"{d}/conv"), range(6)))
    every = [r.id for r in spark.read.parquet(f"{d}/conv").collect()]
    assert len(every) == len(set(every)) == 240
    # what an append returns is what it stored
    returned = [[r.id for r in s.collect()] for s in stored]
    assert all(len(r) == 40 for r in returned) and sorted(sum(returned, [])) == sorted(every)
    last = S.append_conversations(rows.limit(1), f"{d}/conv").first()
    assert last.id > max(every)  # later appends have larger ids


def test_first_free_number_needs_few_looks():
    from sluice.sources.ids import first_free

    for n in (0, 1, 2, 3, 7, 8, 1000, 123_456):
        looks = []
        assert first_free(lambda i: looks.append(i) or i < n) == n
        assert len(looks) <= 40


def test_scan_table_pushes_filters_of_renamed_columns(spark):
    d = _scratch()
    spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts, 'x' AS unused FROM range(9)").write.parquet(f"{d}/t")
    out = T.scan_table(spark, f"{d}/t", ddl=T.EXECUTION_DDL, columns={"id": "event_id", "created_at": "ts"})
    out = out.where("created_at >= TIMESTAMP_NTZ '2023-12-31 00:00:00' AND id > 3").select("id", "status")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "GreaterThan(event_i" in plan and "unused" not in plan
    assert sorted(map(tuple, out.collect())) == [(i, "pending") for i in range(4, 9)]


def test_decoding_keeps_real_replacement_characters(spark):
    made = [b"a\xef\xbf\xbdb", b"\xe2\xef\xbf\xbd\xff!", "\ufdd01\ufdd0 0\ufffd".encode(), b"\xc3\x28 \xe2\x82", b"", "été 日本 \U0001f600".encode(), b"\xf0\x9f\x98"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(made)], "i int, content binary")
    got = {r.i: r.t for r in df.select("i", A.decode_utf8_dropping_bad_bytes(F.col("content")).alias("t")).collect()}
    assert got == {i: b.decode("utf-8", "ignore") for i, b in enumerate(made)}
