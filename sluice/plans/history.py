"""Registered history queries (B, C, A5, A7, A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..sources import tables as S
from ..views import AS_OF, AS_OF_SQL, table_path
from .registry import query

# Parameters of the registered questions.
SESSION = "conv-7"
CUTOFF_SQL = f"{AS_OF_SQL} - INTERVAL '7' DAY"

_STATS_SQL = f"""
  CAST(COUNT(*) AS BIGINT) AS total_executions,
  CAST(COALESCE(count_if(status = 'completed'), 0) AS BIGINT) AS successful,
  CAST(COALESCE(count_if(status = 'failed'), 0) AS BIGINT) AS failed,
  ROUND(COALESCE(AVG(execution_time_ms), 0), 6) AS average_time_ms,
  CAST(COALESCE(SUM(tokens_used), 0) AS BIGINT) AS total_tokens"""


def _round_avg(df):
    return df.withColumn("average_time_ms", F.round("average_time_ms", 6))


@query("execution_stats_by_session", ("executions",), f"""
SELECT session_id, {_STATS_SQL}
FROM executions WHERE created_at >= {CUTOFF_SQL}
GROUP BY session_id""")
def execution_stats_by_session(t):
    """How did each session's runs go in the last 7 days?"""
    return _round_avg(H.execution_stats_by_session(t.executions, AS_OF, 7))


@query("execution_stats", ("executions",), f"""
SELECT {_STATS_SQL}
FROM executions WHERE created_at >= {CUTOFF_SQL}""")
def execution_stats(t):
    return _round_avg(H.execution_stats(t.executions, AS_OF, 7))


@query("execution_stats_empty", ("executions",), f"""
SELECT {_STATS_SQL}
FROM executions WHERE created_at >= {AS_OF_SQL} + INTERVAL '1' DAY""")
def execution_stats_empty(t):
    """C1 with a window after the last row: the all-zero reply."""
    return _round_avg(H.execution_stats(t.executions, "2024-02-08 00:00:00", 7))


@query("usage_by_dimension", ("executions",), f"""
SELECT agent_type, model_used, CAST(GROUPING(agent_type, model_used) AS INT) AS grouping_id, {_STATS_SQL}
FROM executions GROUP BY CUBE (agent_type, model_used)""")
def usage_by_dimension(t):
    return _round_avg(H.usage_by_dimension(t.executions))


@query("conversation_history", ("history",), f"""
SELECT id, session_id, user_message, agent_response, agent_type, created_at, '{{}}' AS metadata_json
FROM history WHERE session_id = '{SESSION}'
ORDER BY created_at DESC, id DESC LIMIT 50""")
def conversation_history(t):
    return H.conversation_history(t.history, SESSION, 50)


_ISO_SQL = """CASE WHEN strftime(created_at, '%f') = '000000'
    THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S')
    ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') END"""


@query("execution_history", ("executions",), f"""
SELECT id, session_id, agent_type, CAST(NULL AS VARCHAR) AS task_description, status, execution_time_ms, tokens_used, model_used,
  {_ISO_SQL} AS created_at
FROM (SELECT * FROM executions WHERE agent_type = 'debugger' AND status = 'completed'
      ORDER BY created_at DESC, id DESC LIMIT 50) q""")
def execution_history(t):
    return H.execution_history(t.executions, None, "debugger", "completed", 50)


@query("latest_per_session", ("history",), """
SELECT * FROM (
  SELECT id, session_id, user_message, agent_response, agent_type, created_at, '{}' AS metadata_json,
    CAST(ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS INT) AS rn
  FROM history) q
WHERE rn <= 3""")
def latest_per_session(t):
    return H.latest_per_session(t.history, 3)


@query("clear_sessions", ("history",), """
SELECT * FROM history h
WHERE NOT EXISTS (SELECT 1 FROM history d WHERE d.agent_type = 'orchestrator' AND d.session_id = h.session_id)""")
def clear_sessions(t):
    """Delete every conversation of the sessions that used the orchestrator."""
    doomed = t.history.where(F.col("agent_type") == "orchestrator").select("session_id")
    return H.clear_sessions(t.history, doomed)


@query("filter_by_map", ("executions",), """
SELECT * FROM executions WHERE agent_type = 'debugger' AND status = 'failed' AND model_used IS NULL""")
def filter_by_map(t):
    return H.filter_by_map(t.executions, {"agent_type": "debugger", "status": "failed",
                                          "model_used": None})


PARAM_SQL = """
SELECT session_id, CAST(COUNT(*) AS BIGINT) AS runs, CAST(SUM(tokens_used) AS BIGINT) AS tokens
FROM {executions} WHERE status = ? AND tokens_used >= ?
GROUP BY session_id"""


@query("sql_with_params", ("executions",), PARAM_SQL.format(executions="executions").replace("?", "'completed'", 1).replace("?", "350", 1))
def sql_with_params(t):
    return S.sql_with_params(t.spark, PARAM_SQL, ["completed", 350], executions=t.executions)


# The execution log as the event table stores it.
STORED_EXECUTIONS = {
    "id": "event_id", "session_id": "'user-' || CAST(user_id AS STRING)",
    "agent_type": "CASE event_type WHEN 'click' THEN 'debugger' WHEN 'view' THEN 'analyzer' WHEN 'purchase' THEN 'docs_generator' "
                  "WHEN 'signup' THEN 'orchestrator' ELSE 'debugger' END",
    "status": "CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'partial' ELSE 'completed' END",
    "execution_time_ms": "value * 10", "tokens_used": "CAST(event_id % 700 AS INT)",
    "model_used": "CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'MistralProvider' ELSE 'OllamaProvider' END",
    "created_at": "ts",
}


@query("scan_tables", ("executions",), """
SELECT id, session_id, agent_type, CAST(NULL AS VARCHAR) AS task_description, status,
  CAST(NULL AS VARCHAR) AS result, CAST(NULL AS VARCHAR) AS error_message, execution_time_ms,
  tokens_used, model_used, created_at, CAST(NULL AS TIMESTAMP) AS updated_at
FROM executions""")
def scan_tables(t):
    """Read the stored execution log through the reader, in the declared schema."""
    return S.scan_table(t.spark, table_path(t.sf_dir, "events"), ddl=S.EXECUTION_DDL, columns=STORED_EXECUTIONS)
