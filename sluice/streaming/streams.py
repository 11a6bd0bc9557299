"""Structured Streaming operators (J1-J5, G7 and H6 on streams) and their batch twins.

Every transformation here is written once and applied to either a static or
a streaming DataFrame. Event time must be a ``TIMESTAMP`` for watermarks, so
``TIMESTAMP_NTZ`` columns are cast (session zone UTC) and windows are cast
back to ``TIMESTAMP_NTZ`` on output.

Late rows: windows take a watermark (default 10 minutes); rows later than it
are dropped from the windowed aggregates but still logged by J2.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import fixed
from ..operators.timeline import ROWS_A_BUCKET, Buckets, micros
from ..sources.sinks import append_rows
from ..sources.tables import CONVERSATION_DDL, EXECUTION_DDL

MESSAGE_SCHEMA = "agent_type STRING, session_id STRING, context MAP<STRING, STRING>"
DEFAULT_WATERMARK = "10 minutes"


def event_time(col: str) -> Column:
    return F.col(col).cast("timestamp")


def _window_out(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("window.end").cast("timestamp_ntz").alias("window_end"),
                     *[c for c in df.columns if c != "window"])


# ------------------------------------------------------------------ J1

def stream_route(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Parse each JSON message and pick the agent branch.

    Output: the input columns (minus the payload) plus agent_type, session_id
    (``default`` when absent), context, routed, error
    (``Unknown agent type: X`` for an unknown or missing type). Stateless, so
    it runs in append mode; ``split_routes`` separates the two sinks.
    """
    parsed = messages.withColumn("_m", F.from_json(F.col(payload), MESSAGE_SCHEMA))
    agent = F.col("_m.agent_type")
    known = agent.isin(*fixed.AGENT_TYPES) & agent.isNotNull()
    keep = [c for c in messages.columns if c != payload]
    return parsed.select(
        *keep, agent.alias("agent_type"),
        F.coalesce(F.col("_m.session_id"), F.lit("default")).alias("session_id"),
        F.col("_m.context").alias("context"),
        F.coalesce(known, F.lit(False)).alias("routed"),
        F.when(~F.coalesce(known, F.lit(False)),
               F.concat(F.lit(fixed.UNKNOWN_AGENT), F.coalesce(agent, F.lit("None")))).alias("error"))


def split_routes(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return routed.where(F.col("routed")), routed.where(~F.col("routed"))


# ------------------------------------------------------------------ J2

def idempotent_append(base_path: str, partition_by: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that is safe to replay.

    Batch ``n`` lands in ``base_path/batch_id=n`` with overwrite. Give every
    checkpoint a ``base_path`` of its own: a new checkpoint starts at batch 0.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        w = batch.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(f"{base_path.rstrip('/')}/batch_id={batch_id}")

    return write


def _query_id(spark, checkpoint: str) -> str:
    """Id that Spark gave the streaming query of a checkpoint folder; a new checkpoint has a new one."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def stream_log(responses: DataFrame, history_path: str, executions_path: str,
               checkpoint_root: str, trigger: dict | None = None):
    """Log each streamed agent response as a conversation row and an execution row.

    A response whose ``run_error`` (if there is that column) is not null is a
    run that raised: it leaves a ``failed`` execution row and no conversation.
    One without a reply leaves nothing, as in the service. ``created_at`` is
    the response's own where it has one, else the time of logging.

    One query, so a response is computed once: a batch is first written as it
    came, and both tables are made from what was written. Rows get the declared
    schemas of A3/A4 and ids that no other batch, run or append has. A batch is
    an append named after the run and its number: a replayed batch replaces
    what it wrote, with the same ids, and a fresh checkpoint never what an
    earlier run wrote. Returns the started query.
    """
    checkpoint = f"{checkpoint_root.rstrip('/')}/log"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = _query_id(spark, checkpoint)
        held = f"{checkpoint_root.rstrip('/')}/responses/{run}-{batch_id}"
        now = F.lit(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
        own = F.col("created_at").cast("timestamp_ntz") if "created_at" in batch.columns else F.lit(None).cast("timestamp_ntz")
        kept = batch.withColumn("created_at", F.coalesce(own, now))
        kept.write.mode("overwrite").parquet(held)
        logged = spark.read.schema(kept.schema).parquet(held)
        for rows, path, ddl in ((conversation_rows(logged), history_path, CONVERSATION_DDL), (execution_log_rows(logged), executions_path, EXECUTION_DDL)):
            append_rows(rows, path, ddl, name=f"{run}-{batch_id}")
        remove_folder(spark, held)

    return (responses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def remove_folder(spark, path: str) -> None:
    """Delete a folder this module wrote, through the file system of its path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _run_error(responses: DataFrame) -> Column:
    return F.col("run_error") if "run_error" in responses.columns else F.lit(None).cast("string")


def conversation_rows(responses: DataFrame) -> DataFrame:
    answered = _run_error(responses).isNull() & (F.coalesce("reply", F.lit("")) != "")
    return responses.where(answered).select("session_id", "user_message", F.col("reply").alias("agent_response"), "agent_type",
                                            F.coalesce(F.col("metadata_json"), F.lit("{}")).alias("metadata_json"), "created_at")


def execution_log_rows(responses: DataFrame) -> DataFrame:
    error = _run_error(responses)
    tasks = F.create_map(*[F.lit(x) for agent, (task, _) in fixed.AGENT_FAILURES.items() for x in (agent, task)])
    ok = error.isNull()
    return responses.where(error.isNotNull() | (F.coalesce("reply", F.lit("")) != "")).select(
        "session_id", "agent_type",
        F.when(ok, F.col("user_message")).otherwise(F.coalesce(F.try_element_at(tasks, F.col("agent_type")), F.col("user_message"))).alias("task_description"),
        F.when(ok, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        F.when(ok, F.substring("reply", 1, fixed.RESULT_PREFIX_CHARS)).alias("result"), error.alias("error_message"),
        F.coalesce("execution_time_ms", F.lit(0.0)).alias("execution_time_ms"),
        F.when(ok, F.coalesce("tokens_used", F.lit(0))).otherwise(F.lit(0)).alias("tokens_used"),
        F.when(ok, F.col("provider")).alias("model_used"), "created_at")


# ------------------------------------------------------------------ J3-J5

def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_executions"),
        F.count_if(F.col("status") == "completed").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.avg("execution_time_ms"), F.lit(0.0)).alias("average_time_ms"),
        F.coalesce(F.sum("tokens_used").cast("bigint"), F.lit(0).cast("bigint")).alias("total_tokens"),
    ]


def stream_stats(executions: DataFrame, watermark: str = DEFAULT_WATERMARK,
                 length: str = "7 days", slide: str = "1 day", by_session: bool = False) -> DataFrame:
    """C1's measures over sliding windows (7 days, every day).

    With a watermark each window is emitted once, after it closes (append
    mode); the partial aggregates per window live in the state store.
    """
    df = executions.withColumn("event_time", event_time("created_at")).withWatermark("event_time", watermark)
    keys = [F.window("event_time", length, slide)] + ([F.col("session_id")] if by_session else [])
    return _window_out(df.groupBy(*keys).agg(*_measures()))


def rate_limit(executions: DataFrame, threshold: int = 20, watermark: str = DEFAULT_WATERMARK,
               length: str = "1 minute") -> DataFrame:
    """Sessions with more than ``threshold`` requests in a tumbling minute."""
    df = executions.withColumn("event_time", event_time("created_at")).withWatermark("event_time", watermark)
    counts = df.groupBy(F.window("event_time", length), "session_id").agg(
        F.count(F.lit(1)).alias("requests"))
    return _window_out(counts.where(F.col("requests") > threshold))


def token_budget(executions: DataFrame, budget: int = 10_000, watermark: str = DEFAULT_WATERMARK,
                 length: str = "1 hour") -> DataFrame:
    """Sessions above ``budget`` tokens in a tumbling hour."""
    df = executions.withColumn("event_time", event_time("created_at")).withWatermark("event_time", watermark)
    sums = df.groupBy(F.window("event_time", length), "session_id").agg(
        F.sum("tokens_used").cast("bigint").alias("tokens"))
    return _window_out(sums.where(F.col("tokens") > budget))


def read_stream_like(spark, df: DataFrame, path: str, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming reader over files with the schema of ``df`` (no inference)."""
    reader = spark.readStream.format(fmt).schema(StructType(df.schema.fields))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


# ------------------------------------------------------------------ J4 (burst)

def _units(refill: int, per_seconds: float, burst: int) -> tuple[int, int, int]:
    """``(token, refill a microsecond, burst)`` in whole units, so that levels are exact."""
    token = int(per_seconds * 1_000_000)
    return token, refill, burst * token


def burst_limit(requests: DataFrame, refill: int = 100, per_seconds: float = 60, burst: int = 200,
                bucket_hours: float = 1, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """Each request against its session's token bucket.

    A bucket holds ``burst`` tokens, is full at the session's first request and
    gains ``refill`` tokens in ``per_seconds``, never above ``burst``. Every
    request takes one, refused ones too, so a session that keeps asking stays
    refused: the level may be negative, and a request is allowed if it is not.
    ``requests(id, session_id, created_at)``, taken by (time, id); adds
    ``tokens_left`` and ``allowed``. A request without a time takes no part.

    The level after request n is ``burst - 1 - (c_n - min(c_1..c_n))`` with
    ``c_i = i - refill * t_i``: a running minimum, whose parts combine in any
    grouping. It is taken inside (session, bucket of time) and one row a bucket
    carries count and minimum on, so a hot session is many tasks.
    """
    token, rate, full = _units(refill, per_seconds, burst)
    rows = requests.select("id", "session_id", "created_at", micros("created_at").alias("t")).where("t is not null")
    dealt = Buckets(rows.select("session_id", "t"), "session_id", int(bucket_hours * 3600 * 1_000_000), rows_a_bucket).put(rows)
    place = Window.partitionBy("session_id", "bucket").orderBy("t", "id")
    upto = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (dealt.withColumn("c", F.row_number().over(place).cast("bigint") * F.lit(token) - F.lit(rate) * F.col("t"))
              .withColumn("least", F.min("c").over(upto)))
    parts = inside.groupBy("session_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("m"))
    before = Window.partitionBy("session_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)) * F.lit(token))
    parts = parts.withColumn("carried", F.min(F.col("ahead") + F.col("m")).over(before)).select(
        F.col("session_id").alias("_session"), F.col("bucket").alias("_bucket"), "ahead", "carried")
    joined = inside.join(parts, F.col("session_id").eqNullSafe(F.col("_session")) & (F.col("bucket") == F.col("_bucket")))
    level = F.lit(full - token) - (F.col("ahead") + F.col("c") - F.least(F.col("ahead") + F.col("least"), F.col("carried")))
    return joined.select("id", "session_id", "created_at", (level / F.lit(float(token))).alias("tokens_left"), (level >= 0).alias("allowed"))


# ------------------------------------------------------------------ in-order state

def _in_order(rows: DataFrame, key: str, fold, state_schema: str, out_schema: str, hold_us: int, watermark: str) -> DataFrame:
    """Fold each key's rows in (time, id) order over a stream.

    Rows wait in a list state until the watermark has passed them; a timer a
    key takes out the passed ones, folds them and puts back the rest, so the
    answer does not depend on arrival order within the watermark delay. Rows
    later than the watermark are dropped by Spark before they reach the state.
    ``fold(state, t, id) -> (state, values)`` gives the columns after ``id, key,
    created_at``. A state is forgotten ``hold_us`` after its last fold, when the
    fold would not tell it from none. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor

    spark = rows.sparkSession
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or ""):
        raise ValueError("set spark.sql.streaming.stateStore.providerClass to the RocksDB provider")
    df = (rows.withColumn("event_time", event_time("created_at")).withWatermark("event_time", watermark)
          .select(key, "event_time", "id", F.unix_micros(F.col("event_time")).alias("t")))

    class Replay(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "t long, id long")
            self.state = handle.getValueState("state", state_schema)
            self.last = handle.getValueState("last", "t long")

        def _wake(self, at_ms: int, now_ms: int) -> None:
            """One timer a key, at the earliest moment asked for; those that are due now don't count."""
            for timer in list(self.handle.listTimers()):
                if now_ms < timer <= at_ms:
                    return
                if timer > at_ms:
                    self.handle.deleteTimer(timer)
            self.handle.registerTimer(at_ms)

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            first = None
            for pdf in rows:
                new = list(zip(pdf["t"].astype("int64").tolist(), pdf["id"].astype("int64").tolist()))
                self.waiting.appendList(new)
                first = min([first] * (first is not None) + [t for t, _ in new])
            if first is not None:
                self._wake(first // 1000 + 1, timerValues.getCurrentWatermarkInMs())
            yield pd.DataFrame()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            now = timerValues.getCurrentWatermarkInMs()
            passed = now * 1000
            held = sorted(self.waiting.get())
            ready = [r for r in held if r[0] <= passed]
            state = self.state.get() if self.state.exists() else None
            last = self.last.get()[0] if self.last.exists() else None
            out = []
            for t, row in ready:
                state, values = fold(state, t, row)
                last = t
                out.append((row, key[0], dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=t), *values))
            if ready:
                self.state.update(tuple(state))
                self.last.update((last,))
                rest = held[len(ready):]
                if rest:
                    self.waiting.put(rest)
                else:
                    self.waiting.clear()
            rest = held[len(ready):]
            if rest:
                self._wake(rest[0][0] // 1000 + 1, now)
            elif last is not None and last + hold_us > passed:
                self._wake((last + hold_us) // 1000 + 1, now)
            else:
                self.state.clear()
                self.last.clear()
            yield pd.DataFrame(out, columns=[c.split()[0] for c in out_schema.split(", ")])

        def close(self) -> None:
            pass

    return df.groupBy(key).transformWithStateInPandas(Replay(), out_schema, "Append", "EventTime")


def ttl_replay_stream(requests: DataFrame, ttl_hours: int = 24,
                      watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """H6 on a stream: per key, the time of the last fill lives in the state store (``_in_order``)."""
    ttl_us = int(ttl_hours * 3600 * 1_000_000)

    def fold(state, t, row):
        hit = state is not None and t < state[0] + ttl_us
        return (state if hit else (t,)), (hit,)

    return _in_order(requests, "cache_key", fold, "fill long", "id long, cache_key string, created_at timestamp_ntz, hit boolean", ttl_us, watermark)


def burst_limit_stream(requests: DataFrame, refill: int = 100, per_seconds: float = 60, burst: int = 200,
                       watermark: str = DEFAULT_WATERMARK, hold: float | None = None) -> DataFrame:
    """J4's token bucket on a stream: time and level of each session's last request are its state.

    A session's state is kept for ``hold`` seconds after its last request, by
    default the time that fills a bucket which is ``burst`` tokens in debt.
    """
    token, rate, full = _units(refill, per_seconds, burst)

    def fold(state, t, row):
        level = (full if state is None else min(full, state[1] + rate * (t - state[0]))) - token
        return (t, level), (level / float(token), level >= 0)

    hold_us = int((hold if hold is not None else 2 * burst / refill * per_seconds) * 1_000_000)
    return _in_order(requests, "session_id", fold, "t long, level long",
                     "id long, session_id string, created_at timestamp_ntz, tokens_left double, allowed boolean", hold_us, watermark)


# ------------------------------------------------------------------ G7 (stream)

def unacknowledged(queue: DataFrame, acks: DataFrame, within: str = "1 hour", keys: tuple[str, ...] = ("request_id", "pos"),
                   queued_at: str = "queued_at", acked_at: str = "acked_at", watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """G7 in time: queued tasks that nobody acknowledged within ``within`` of their queueing.

    The same outer join for tables and streams. On streams both sides have a
    watermark, so the state of a task ends, and the task comes out, once the
    watermark has passed the last moment an acknowledgement could have.
    """
    tasks = queue.withColumn("_queued", event_time(queued_at)).withWatermark("_queued", watermark)
    seen = (acks.select(*[F.col(k).alias(f"_ack_{k}") for k in keys], event_time(acked_at).alias("_acked"))
            .withWatermark("_acked", watermark))
    same = [F.col(k) == F.col(f"_ack_{k}") for k in keys]
    in_time = (F.col("_acked") >= F.col("_queued")) & (F.col("_acked") <= F.col("_queued") + F.expr(f"INTERVAL {within}"))
    joined = tasks.join(seen, reduce(lambda a, b: a & b, same) & in_time, "left_outer")
    return joined.where(F.col("_acked").isNull()).select(*queue.columns)


# ------------------------------------------------------------------ keyed sink

def upsert_changes(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of an update-mode stream into a keyed table.

    A batch holds the new values of the keys it changed and lands in
    ``path/batch_id=<n>`` with overwrite: a replayed batch replaces itself and
    nothing that is read is overwritten. ``read_upserted`` gives the newest row
    of each key, ``compact`` folds old batches into one. Give every checkpoint
    a path of its own.
    """
    return idempotent_append(path)


def _compacted(spark, path: str) -> int:
    """Number of the newest complete compaction, or -1."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = -1
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("_upto-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            done = max(done, int(name.removeprefix("_upto-")))
    return done


def read_upserted(spark, path: str, keys: list[str], schema: StructType, upto: int | None = None) -> DataFrame:
    """The newest row of each key (columns of ``schema``); one grouped maximum, combined before the shuffle."""
    path = path.rstrip("/")
    done = _compacted(spark, path)
    batches = spark.read.schema(StructType([*schema.fields, StructField("batch_id", LongType())])).parquet(path).where(F.col("batch_id") > done)
    if upto is not None:
        batches = batches.where(F.col("batch_id") <= upto)
    if done >= 0:
        batches = batches.unionByName(spark.read.schema(schema).parquet(f"{path}/_upto-{done}").withColumn("batch_id", F.lit(done).cast("bigint")))
    rest = [f.name for f in schema.fields if f.name not in keys]
    newest = batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("row"))
    return newest.select(*[F.col(f.name) if f.name in keys else F.col(f"row.{f.name}") for f in schema.fields])


def compact(spark, path: str, keys: list[str], schema: StructType, upto: int) -> None:
    """Fold the batches up to ``upto`` into one folder and delete them; call it between batches.

    The folder counts once its ``_SUCCESS`` file is there, and the batches go
    only then, so a reader finds every key at any moment.
    """
    path = path.rstrip("/")
    before = _compacted(spark, path)
    if upto <= before:
        return
    read_upserted(spark, path, keys, schema, upto).write.mode("overwrite").parquet(f"{path}/_upto-{upto}")
    for n in range(before + 1, upto + 1):
        remove_folder(spark, f"{path}/batch_id={n}")
    if before >= 0:
        remove_folder(spark, f"{path}/_upto-{before}")


def keep_stats(executions: DataFrame, path: str, checkpoint: str, watermark: str = DEFAULT_WATERMARK, by_session: bool = False,
               trigger: dict | None = None):
    """J3 kept current: C1's windows in a keyed table that is right after every batch.

    Update mode sends the windows that a batch changed, open ones too, to
    ``upsert_changes``. Read the table with ``read_upserted`` and
    ``STATS_KEYS`` (and ``session_id`` if ``by_session``). Returns the started query.
    """
    stats = stream_stats(executions, watermark, by_session=by_session)
    return (stats.writeStream.outputMode("update").foreachBatch(upsert_changes(path)).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


STATS_KEYS = ["window_start", "window_end"]
