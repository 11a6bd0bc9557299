"""Registered batch twins of the streaming operators.

The same functions run on ``readStream`` inputs (see ``tests/test_streams.py``);
here they run on the static tables so DuckDB can check them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as J
from .registry import query

# Messages of the agent socket, derived from the event log: one JSON text per
# event. Error events name an agent type nobody serves; every eleventh has no
# type; every fifth has no session.
_AGENT_SQL = ("CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_type = 'click' THEN 'debugger' "
              "WHEN event_type = 'view' THEN 'analyzer' WHEN event_type = 'purchase' THEN 'docs_generator' "
              "WHEN event_type = 'signup' THEN 'orchestrator' ELSE 'planner' END")
_SESSION_SQL = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'user-' || CAST(user_id AS STRING) END"


def socket_messages(t):
    e = t.events
    payload = F.to_json(F.struct(F.expr(_AGENT_SQL).alias("agent_type"),
                                 F.expr(_SESSION_SQL).alias("session_id"),
                                 F.create_map(F.lit("value"), F.col("value").cast("string")).alias("context")))
    return e.select(F.col("event_id").alias("message_id"), F.col("ts").alias("received_at"),
                    payload.alias("payload"))


@query("stream_route", (), f"""
SELECT event_id AS message_id, received_at, agent_type, COALESCE(session_id, 'default') AS session_id,
  COALESCE(agent_type IN ('debugger', 'analyzer', 'docs_generator', 'orchestrator'), false) AS routed,
  CASE WHEN COALESCE(agent_type IN ('debugger', 'analyzer', 'docs_generator', 'orchestrator'), false) THEN NULL
       ELSE 'Unknown agent type: ' || COALESCE(agent_type, 'None') END AS error
FROM (SELECT event_id, ts AS received_at, {_AGENT_SQL.replace('STRING', 'VARCHAR')} AS agent_type,
        {_SESSION_SQL.replace('STRING', 'VARCHAR')} AS session_id FROM events) m""")
def stream_route(t):
    return J.stream_route(socket_messages(t)).drop("context")


_MEASURES_SQL = """
  CAST(COUNT(*) AS BIGINT) AS total_executions,
  CAST(COALESCE(count_if(status = 'completed'), 0) AS BIGINT) AS successful,
  CAST(COALESCE(count_if(status = 'failed'), 0) AS BIGINT) AS failed,
  ROUND(COALESCE(AVG(execution_time_ms), 0), 6) AS average_time_ms,
  CAST(COALESCE(SUM(tokens_used), 0) AS BIGINT) AS total_tokens"""


@query("stream_stats", ("executions",), f"""
SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, {_MEASURES_SQL}
FROM (SELECT *, date_trunc('day', created_at) - INTERVAL 1 DAY * k AS window_start
      FROM executions CROSS JOIN range(0, 7) AS r(k)) w
GROUP BY window_start""")
def stream_stats(t):
    out = J.stream_stats(t.executions)
    return out.withColumn("average_time_ms", F.round("average_time_ms", 6))


@query("rate_limit", ("executions",), """
SELECT window_start, window_start + INTERVAL 1 MINUTE AS window_end, session_id, CAST(COUNT(*) AS BIGINT) AS requests
FROM (SELECT *, date_trunc('minute', created_at) AS window_start FROM executions) w
GROUP BY window_start, session_id HAVING COUNT(*) > 1""")
def rate_limit(t):
    """J4 with a threshold of one request a minute (the fixtures reach two)."""
    return J.rate_limit(t.executions, threshold=1)


@query("token_budget", ("executions",), """
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, session_id, CAST(SUM(tokens_used) AS BIGINT) AS tokens
FROM (SELECT *, date_trunc('hour', created_at) AS window_start FROM executions) w
GROUP BY window_start, session_id HAVING SUM(tokens_used) > 500""")
def token_budget(t):
    """J5 with a budget of 500 tokens an hour (the fixtures stay far below 10,000)."""
    return J.token_budget(t.executions, budget=500)


@query("burst_limit", (), """
WITH RECURSIVE r AS (
  SELECT event_id AS id, 'user-' || CAST(user_id AS VARCHAR) AS session_id, ts AS created_at, epoch_us(ts) AS t,
    ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
walk AS (
  SELECT session_id, rn, id, created_at, t, CAST(3 AS BIGINT) * 86400000000 AS level FROM r WHERE rn = 1
  UNION ALL
  SELECT n.session_id, n.rn, n.id, n.created_at, n.t,
    LEAST(CAST(4 AS BIGINT) * 86400000000, w.level + 3 * (n.t - w.t)) - 86400000000
  FROM walk w JOIN r n ON n.session_id = w.session_id AND n.rn = w.rn + 1)
SELECT id, session_id, created_at, level / 86400000000.0::DOUBLE AS tokens_left, level >= 0 AS allowed FROM walk""")
def burst_limit(t):
    """J4's token bucket: three requests a day, four at once (fixture sessions ask about three times a day)."""
    return J.burst_limit(t.executions, refill=3, per_seconds=86_400, burst=4, bucket_hours=24)


@query("pending_within", (), """
SELECT o_orderkey AS request_id, o_orderdate AS queued_at FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY)""")
def pending_within(t):
    """G7 in time: orders are the queue, shipped lines acknowledge them; those not shipped from within 30 days."""
    queue = t.orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("queued_at"))
    acks = t.lineitem.select(F.col("l_orderkey").alias("request_id"), F.col("l_shipdate").alias("acked_at"))
    return J.unacknowledged(queue, acks, "30 days", keys=("request_id",))
