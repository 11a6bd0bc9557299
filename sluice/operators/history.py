"""Conversation and execution history: look-ups, top-k and statistics.

Inputs follow the two log tables of the data model:
``history(id, session_id, user_message, agent_response, agent_type, created_at[, metadata_json])``
and ``executions(id, session_id, agent_type, status, execution_time_ms,
tokens_used, model_used, created_at, ...)``.

Every ordering breaks ties on ``id`` so results are deterministic.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iso_text
from ..sources.tables import CONVERSATION_DDL, EXECUTION_DDL, conform

HISTORY_COLUMNS = ["id", "session_id", "user_message", "agent_response",
                   "agent_type", "created_at", "metadata_json"]
EXECUTION_COLUMNS = ["id", "session_id", "agent_type", "task_description", "status",
                     "execution_time_ms", "tokens_used", "model_used", "created_at"]


def _newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id").desc()]


def _declared(df: DataFrame, cols: list[str], ddl: str) -> DataFrame:
    """The declared columns, in their declared types; one that the table lacks has its declared default."""
    return conform(df, ddl).select(*cols)


def conversation_history(history: DataFrame, session_id: str, limit: int = 50) -> DataFrame:
    """B1: one session's rows, newest first, at most ``limit``.

    Planned as a pushed-down filter and a ``TakeOrderedAndProject``: each task
    keeps its own top ``limit`` and only those reach the final merge.
    """
    return (history.where(F.col("session_id") == F.lit(session_id))
            .transform(_declared, HISTORY_COLUMNS, CONVERSATION_DDL)
            .orderBy(*_newest_first())
            .limit(limit))


def execution_history(executions: DataFrame, session_id: str | None = None,
                      agent_type: str | None = None, status: str | None = None,
                      limit: int = 50) -> DataFrame:
    """B2: optional equality filters (empty value = no filter), newest first.

    ``created_at`` comes back as ISO text, as the service returns it.
    """
    df = executions
    for name, value in (("session_id", session_id), ("agent_type", agent_type),
                        ("status", status)):
        if value:
            df = df.where(F.col(name) == F.lit(value))
    top = _declared(df, EXECUTION_COLUMNS, EXECUTION_DDL).orderBy(*_newest_first()).limit(limit)
    return top.withColumn("created_at", iso_text(F.col("created_at")))


def latest_per_session(history: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` rows of every session in one pass.

    ``row_number() <= n`` lets Spark insert a WindowGroupLimit before the
    shuffle, so a session holding a third of all rows contributes at most
    ``n`` rows per input partition to the exchange.
    """
    w = Window.partitionBy("session_id").orderBy(*_newest_first())
    return (_declared(history, HISTORY_COLUMNS, CONVERSATION_DDL)
            .withColumn("rn", F.row_number().over(w))
            .where(F.col("rn") <= n))


def _stats_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_executions"),
        F.count_if(F.col("status") == "completed").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.avg("execution_time_ms"), F.lit(0.0)).alias("average_time_ms"),
        F.coalesce(F.sum("tokens_used").cast("bigint"), F.lit(0).cast("bigint")).alias("total_tokens"),
    ]


def _since(df: DataFrame, as_of: str, days: int) -> DataFrame:
    cutoff = _dt.datetime.fromisoformat(as_of) - _dt.timedelta(days=days)
    return df.where(F.col("created_at") >= F.lit(cutoff.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz"))


def execution_stats(executions: DataFrame, as_of: str, days: int = 7,
                    session_id: str | None = None) -> DataFrame:
    """Run count, completed, failed, mean time and token sum since ``as_of - days``.

    A global aggregate always yields one row; an empty window gives zeros.
    """
    df = _since(executions, as_of, days)
    if session_id:
        df = df.where(F.col("session_id") == F.lit(session_id))
    return df.agg(*_stats_measures())


def execution_stats_by_session(executions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """C1 for every session at once (partial + final hash aggregate)."""
    return _since(executions, as_of, days).groupBy("session_id").agg(*_stats_measures())


def usage_by_dimension(executions: DataFrame) -> DataFrame:
    """C4: the C1 measures by agent type, by model, by both and overall.

    ``grouping_id`` tells a subtotal apart from a real null ``model_used``:
    bit 1 = agent_type rolled up, bit 0 = model_used rolled up.
    """
    return (executions.cube("agent_type", "model_used")
            .agg(F.grouping_id().cast("int").alias("grouping_id"), *_stats_measures()))


def clear_sessions(history: DataFrame, session_ids: DataFrame) -> DataFrame:
    """A5: every row except those of the given sessions.

    A left-anti equi-join; AQE turns it into a broadcast join only when the
    id table proves small at run time, otherwise both sides shuffle on the key.
    The caller writes the result to a new location (never over its input).
    """
    ids = session_ids.select("session_id").distinct()
    return history.join(ids, on="session_id", how="left_anti")


def filter_by_map(df: DataFrame, equalities: dict) -> DataFrame:
    """AND of ``column = value`` for each entry; a ``None`` value means IS NULL."""
    if not equalities:
        return df

    def cond(name, value):
        return F.col(name).isNull() if value is None else F.col(name) == F.lit(value)

    return df.where(reduce(lambda a, b: a & b, (cond(k, v) for k, v in equalities.items())))
