"""Streaming operators equal their batch twins on closed windows."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from sluice.plans import streams as PS
from sluice.streaming import streams as J
from sluice.views import Tables

from .conftest import SMOKE_DIR


def _scratch():
    return tempfile.mkdtemp(prefix="sluice-stream-", dir="/tmp")


def _run_to_memory(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q


def test_stats_stream_equals_batch_on_closed_windows(spark):
    t = Tables(spark, SMOKE_DIR)
    d = _scratch()
    t.executions.repartition(6, "session_id").write.parquet(f"{d}/in")
    stream = J.read_stream_like(spark, t.executions, f"{d}/in")
    _run_to_memory(J.stream_stats(stream), "j3_out")
    streamed = {(r.window_start, r.total_executions, r.total_tokens)
                for r in spark.sql("SELECT * FROM j3_out").collect()}
    # append mode emits exactly the windows closed by the watermark
    last = t.executions.agg(F.max("created_at")).first()[0]
    batch = {(r.window_start, r.total_executions, r.total_tokens)
             for r in J.stream_stats(t.executions).collect()
             if r.window_end <= last - dt.timedelta(minutes=10)}
    assert streamed and streamed == batch


def test_late_rows_are_dropped_from_windows(spark):
    t = Tables(spark, SMOKE_DIR)
    d = _scratch()
    early = t.executions.where("created_at < TIMESTAMP_NTZ '2024-01-05 00:00:00'")
    later = t.executions.where("created_at >= TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    later.write.parquet(f"{d}/in/a")
    stream = J.read_stream_like(spark, t.executions, f"{d}/in/*")

    def run():
        q = (J.rate_limit(stream, threshold=0).writeStream.format("parquet").option("path", f"{d}/out")
             .outputMode("append").option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start())
        q.awaitTermination(300)

    run()
    first = spark.read.parquet(f"{d}/out").count()
    early.write.parquet(f"{d}/in/b")      # arrives after the watermark passed it
    run()
    out = spark.read.parquet(f"{d}/out")
    assert first > 0
    assert out.where("window_start < TIMESTAMP_NTZ '2024-01-05 00:00:00'").count() == 0


def test_limit_streams_equal_batch_on_closed_windows(spark):
    t = Tables(spark, SMOKE_DIR)
    d = _scratch()
    t.executions.repartition(6, "session_id").write.parquet(f"{d}/in")
    stream = J.read_stream_like(spark, t.executions, f"{d}/in")
    closed = t.executions.agg(F.max("created_at")).first()[0] - dt.timedelta(minutes=10)
    for name, limit in (("j4_out", lambda df: J.rate_limit(df, threshold=0)), ("j5_out", lambda df: J.token_budget(df, budget=300))):
        _run_to_memory(limit(stream), name)
        streamed = {tuple(r) for r in spark.table(name).collect()}
        batch = {tuple(r) for r in limit(t.executions).collect() if r.window_end <= closed}
        assert streamed and streamed == batch


def test_ttl_replay_stream_takes_rows_in_time_order(spark):
    from sluice.operators import cache as H

    d = _scratch()
    at = dt.datetime(2024, 1, 1)
    # 3 comes after 2 but is earlier, inside the watermark delay; 4 and 5 move the watermark on
    rows = [(1, "k", at), (2, "k", at + dt.timedelta(days=2, minutes=8)), (3, "k", at + dt.timedelta(days=2, minutes=4)),
            (4, "z", at + dt.timedelta(days=2, minutes=30)), (5, "z", at + dt.timedelta(days=9))]
    reqs = spark.createDataFrame(rows, "id long, cache_key string, created_at timestamp_ntz")
    for i, _, _ in rows:
        reqs.where(F.col("id") == i).coalesce(1).write.parquet(f"{d}/in/p{i}")
    stream = J.read_stream_like(spark, reqs, f"{d}/in/*", max_files_per_trigger=1)
    q = (J.ttl_replay_stream(stream).writeStream.format("parquet").option("path", f"{d}/out")
         .option("checkpointLocation", f"{d}/ck").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = sorted((r.id, r.hit) for r in spark.read.parquet(f"{d}/out").collect())
    assert got == [(1, False), (2, True), (3, False), (4, False)]
    assert got == sorted((r.id, r.hit) for r in H.ttl_replay(reqs, 24).collect() if r.id != 5)


def test_route_stream_and_replayable_sink(spark):
    t = Tables(spark, SMOKE_DIR)
    d = _scratch()
    msgs = PS.socket_messages(t)
    msgs.write.parquet(f"{d}/in")
    stream = J.read_stream_like(spark, msgs, f"{d}/in")
    routed, errors = J.split_routes(J.stream_route(stream))
    q = (errors.writeStream.foreachBatch(J.idempotent_append(f"{d}/errors"))
         .option("checkpointLocation", f"{d}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(300)
    out = spark.read.parquet(f"{d}/errors")
    want = J.stream_route(msgs).where("NOT routed")
    assert out.count() == want.count() > 0
    # replaying batch 0 overwrites its own folder instead of appending again
    J.idempotent_append(f"{d}/errors")(want, 0)
    assert spark.read.parquet(f"{d}/errors").count() == want.count()


def test_ttl_replay_stream_equals_batch_on_passed_rows(spark):
    from sluice.operators import cache as H

    t = Tables(spark, SMOKE_DIR)
    d = _scratch()
    reqs = t.events.select(F.col("event_id").alias("id"),
                           F.md5(F.concat_ws("|", "event_type", "props")).alias("cache_key"),
                           F.col("ts").alias("created_at"))
    # arrive in four time slices
    bounds = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-23", "2024-02-01"]
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        reqs.where((F.col("created_at") >= F.lit(lo).cast("timestamp_ntz"))
                   & (F.col("created_at") < F.lit(hi).cast("timestamp_ntz"))).write.parquet(f"{d}/in/p{i}")
    stream = J.read_stream_like(spark, reqs, f"{d}/in/*", max_files_per_trigger=1)
    q = (J.ttl_replay_stream(stream).writeStream.format("parquet").option("path", f"{d}/out")
         .option("checkpointLocation", f"{d}/ck").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = {(r.id, r.hit) for r in spark.read.parquet(f"{d}/out").collect()}
    # exactly the rows that the watermark has passed, as the batch form has them
    passed = reqs.agg(F.max("created_at")).first()[0] - dt.timedelta(minutes=10)
    want = {(r.id, r.hit) for r in H.ttl_replay(reqs, 24).collect() if r.created_at <= passed}
    assert len(want) > 900 and got == want


def test_stream_log_writes_both_tables(spark):
    d = _scratch()
    rows = spark.createDataFrame(
        [("s1", "Debug python code", "r" * 700, "debugger", None, 12.5, 40, "PrimaryStub"),
         ("s2", "Analyze java code (security)", "ok", "analyzer", '{"a": 1}', 3.0, 7, "FallbackStub")],
        "session_id string, user_message string, reply string, agent_type string, metadata_json string, "
        "execution_time_ms double, tokens_used long, provider string")
    rows.write.parquet(f"{d}/in")
    stream = J.read_stream_like(spark, rows, f"{d}/in")
    J.stream_log(stream, f"{d}/hist", f"{d}/exec", f"{d}/ck").awaitTermination(300)
    hist = spark.read.parquet(f"{d}/hist")
    execs = spark.read.parquet(f"{d}/exec")
    assert hist.count() == 2 and execs.count() == 2
    assert {r.metadata_json for r in hist.collect()} == {"{}", '{"a": 1}'}
    assert max(len(r.result) for r in execs.collect()) == 500
    # a fresh checkpoint restarts at batch 0 and must not replace the first run's rows
    J.stream_log(stream, f"{d}/hist", f"{d}/exec", f"{d}/ck2").awaitTermination(300)
    assert spark.read.parquet(f"{d}/hist").count() == 4 and spark.read.parquet(f"{d}/exec").count() == 4


def test_stream_log_ids_are_unique_over_batches_and_runs_and_failed_runs_are_logged(spark):
    d = _scratch()
    at = dt.datetime(2024, 3, 1, 12)
    kind = ("session_id string, user_message string, reply string, agent_type string, metadata_json string, "
            "execution_time_ms double, tokens_used long, provider string, run_error string, created_at timestamp_ntz")
    for i in range(3):
        spark.createDataFrame([(f"s{i}", "Debug python code", f"reply {i}", "debugger", None, 1.0, 4, "Stub", None, at + dt.timedelta(days=i)),
                               (f"s{i}", "Debug python code", "", "debugger", None, 2.0, None, None, "no quota", at + dt.timedelta(days=i)),
                               (f"s{i}", "Debug python code", "", "debugger", None, 2.0, None, None, None, at)], kind) \
            .coalesce(1).write.parquet(f"{d}/in/p{i}")
    stream = J.read_stream_like(spark, spark.createDataFrame([], kind), f"{d}/in/*", max_files_per_trigger=1)
    J.stream_log(stream, f"{d}/hist", f"{d}/exec", f"{d}/ck").awaitTermination(300)
    J.stream_log(stream, f"{d}/hist", f"{d}/exec", f"{d}/ck2").awaitTermination(300)
    hist, execs = spark.read.parquet(f"{d}/hist").collect(), spark.read.parquet(f"{d}/exec").collect()
    assert len({r.append_id for r in hist}) == 6
    assert len(hist) == len({r.id for r in hist}) == 6 and len(execs) == len({r.id for r in execs}) == 12
    assert {r.created_date for r in hist} == {(at + dt.timedelta(days=i)).date() for i in range(3)}
    failed = [r for r in execs if r.status == "failed"]
    assert len(failed) == 6
    assert {(r.task_description, r.error_message, r.result, r.tokens_used, r.model_used) for r in failed} == {("Debug code", "no quota", None, 0, None)}


def test_replayed_batch_keeps_its_ids(spark):
    from sluice.sources import ids

    d = _scratch()
    assert [ids.reserve(spark, d, name) for name in ("run-0", None, "run-1", "run-0", None)] == [0, 1, 2, 0, 3]


def _plain_bucket(rows, refill, per, burst):
    out, state = {}, {}
    for rid, session, t in sorted(rows, key=lambda r: (r[2], r[0])):
        last, level = state.get(session, (t, burst))
        level = min(burst, level + refill * (t - last).total_seconds() / per) - 1
        state[session] = (t, level)
        out[rid] = level
    return out


def test_burst_limit_and_its_stream_equal_a_plain_walk(spark):
    import random

    rnd = random.Random(4)
    at = dt.datetime(2024, 1, 1)
    # in order of arrival, but for pairs that change places within the watermark delay
    times = sorted(rnd.randint(0, 3 * 86_400) for _ in range(400))
    rows = [(i, "hot" if i % 3 else rnd.choice("abc"), at + dt.timedelta(seconds=s)) for i, s in enumerate(times)]
    rows += [(1000 + i, "hot", rows[200][2]) for i in range(30)]          # a burst in one instant
    rows.sort(key=lambda r: r[2])
    want = _plain_bucket(rows, 6, 3600, 8)
    assert 30 < sum(v < 0 for v in want.values()) < len(want)
    kind = "id long, session_id string, created_at timestamp_ntz"
    df = spark.createDataFrame(rows, kind)
    for hours, most in ((1, 200_000), (24, 7), (1000, 40)):
        got = {r.id: (r.tokens_left, r.allowed) for r in J.burst_limit(df, 6, 3600, 8, bucket_hours=hours, rows_a_bucket=most).collect()}
        assert set(got) == set(want) and all(abs(got[i][0] - v) < 1e-6 and got[i][1] == (got[i][0] >= 0) for i, v in want.items())
    d = _scratch()
    late = [rows[:150] + rows[160:170], rows[150:160] + rows[170:300], rows[300:]]
    for i, part in enumerate(late):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{d}/in/p{i}")
    span = rows[169][2] - rows[150][2] + dt.timedelta(minutes=1)
    stream = J.read_stream_like(spark, df, f"{d}/in/*", max_files_per_trigger=1)
    q = (J.burst_limit_stream(stream, 6, 3600, 8, watermark=f"{int(span.total_seconds())} seconds").writeStream.format("parquet")
         .option("path", f"{d}/out").option("checkpointLocation", f"{d}/ck").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    passed = rows[-1][2] - span
    streamed = {(r.id, r.tokens_left, r.allowed) for r in spark.read.parquet(f"{d}/out").collect()}
    assert streamed == {(r.id, r.tokens_left, r.allowed) for r in J.burst_limit(df, 6, 3600, 8).collect() if r.created_at <= passed}
    assert len(streamed) > 200


def test_unacknowledged_stream_equals_batch_on_closed_time(spark):
    d = _scratch()
    at = dt.datetime(2024, 1, 1)
    queue = [(i, i % 4, at + dt.timedelta(minutes=10 * i)) for i in range(120)]
    acks = [(i, i % 4, at + dt.timedelta(minutes=10 * i + (i % 7) * 15)) for i in range(120) if i % 5]
    acks += [(i, i % 4, at + dt.timedelta(minutes=10 * i + 1)) for i in range(0, 120, 6)] + [(3, 0, at)]
    q = spark.createDataFrame(queue, "request_id long, pos long, queued_at timestamp_ntz")
    a = spark.createDataFrame(acks, "request_id long, pos long, acked_at timestamp_ntz")
    for i in range(3):
        q.where(f"request_id >= {40 * i} AND request_id < {40 * i + 40}").coalesce(1).write.parquet(f"{d}/q/p{i}")
        a.where(f"request_id >= {40 * i} AND request_id < {40 * i + 40}").coalesce(1).write.parquet(f"{d}/a/p{i}")
    got = J.unacknowledged(J.read_stream_like(spark, q, f"{d}/q/*", max_files_per_trigger=1),
                           J.read_stream_like(spark, a, f"{d}/a/*", max_files_per_trigger=1), "1 hour")
    _run_to_memory(got, "g7_out")
    batch = J.unacknowledged(q, a, "1 hour").collect()
    want = {r for r, p, t in queue if not any((r, p) == (x, y) and t <= u <= t + dt.timedelta(hours=1) for x, y, u in acks)}
    assert {r.request_id for r in batch} == want
    closed = min(queue[-1][2], max(u for *_, u in acks)) - dt.timedelta(minutes=10, hours=1)
    streamed = {r.request_id for r in spark.table("g7_out").collect()}
    # all that are closed for sure, and nothing that is acknowledged; the last watermark may close a few more
    assert {r.request_id for r in batch if r.queued_at < closed} <= streamed <= want and len(streamed) > 10


def test_stats_kept_current_after_every_batch(spark):
    t = Tables(spark, SMOKE_DIR)
    d = _scratch()
    parts = ["2024-01-01", "2024-01-08", "2024-01-16", "2024-02-01"]
    seen = None
    schema = J.stream_stats(t.executions).schema
    for i, (lo, hi) in enumerate(zip(parts, parts[1:])):
        part = t.executions.where(f"created_at >= TIMESTAMP_NTZ '{lo}' AND created_at < TIMESTAMP_NTZ '{hi}'")
        part.coalesce(1).write.parquet(f"{d}/in/p{i}")
        stream = J.read_stream_like(spark, t.executions, f"{d}/in/*")
        J.keep_stats(stream, f"{d}/stats", f"{d}/ck").awaitTermination(300)
        so_far = t.executions.where(f"created_at < TIMESTAMP_NTZ '{hi}'")
        table = J.read_upserted(spark, f"{d}/stats", J.STATS_KEYS, schema)

        def rows(df):
            return {(r.window_start, r.total_executions, r.successful, r.failed, round(r.average_time_ms, 6), r.total_tokens) for r in df.collect()}

        assert rows(table) == rows(J.stream_stats(so_far))
        if i == 1:  # what is compacted stays readable, and later batches go on top
            J.compact(spark, f"{d}/stats", J.STATS_KEYS, schema, upto=i)
            assert rows(J.read_upserted(spark, f"{d}/stats", J.STATS_KEYS, schema)) == rows(J.stream_stats(so_far))
        seen = J.read_upserted(spark, f"{d}/stats", J.STATS_KEYS, schema).count()
    assert seen and seen == J.stream_stats(t.executions).count()
