"""Registered task-graph queries.

The oracle for the ordering rule is a recursive CTE that walks each request
one pick at a time — a different formulation from the array fold, so the two
check each other.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import tasks as G
from ..session import materialize
from .prompts import prompted_sql
from .registry import query
from .stubs import reply_sql, stub_providers

_KNOWN = "(" + ", ".join(f"'{t}'" for t in fixed.TASK_TYPES) + ")"

WALK_CTES = """WITH RECURSIVE t AS (SELECT request_id, pos, task_id, task_type, priority, depends_on FROM tasks),
sz AS (SELECT request_id, CAST(COUNT(*) AS INT) AS n FROM t GROUP BY request_id),
walk AS (
  SELECT request_id, n, 0 AS step, CAST([] AS VARCHAR[]) AS taken, CAST([] AS INT[]) AS picked, false AS done, false AS cycle FROM sz
  UNION ALL
  SELECT request_id, n, step + 1,
    CASE WHEN nxt IS NOT NULL THEN list_append(taken, nxt_id) ELSE taken END,
    CASE WHEN nxt IS NOT NULL THEN list_append(picked, nxt) ELSE list_concat(picked, COALESCE(rest, CAST([] AS INT[]))) END,
    nxt IS NULL, nxt IS NULL
  FROM (
    SELECT w.*,
      (SELECT MIN(x.pos) FROM t x WHERE x.request_id = w.request_id AND NOT list_contains(w.taken, x.task_id)
         AND (x.depends_on IS NULL OR list_contains(w.taken, x.depends_on))) AS nxt,
      (SELECT arg_min(x.task_id, x.pos) FROM t x WHERE x.request_id = w.request_id AND NOT list_contains(w.taken, x.task_id)
         AND (x.depends_on IS NULL OR list_contains(w.taken, x.depends_on))) AS nxt_id,
      (SELECT list(x.pos ORDER BY x.pos) FROM t x WHERE x.request_id = w.request_id AND NOT list_contains(w.taken, x.task_id)) AS rest
    FROM walk w WHERE NOT w.done AND len(w.picked) < w.n) s),
final AS (SELECT request_id, picked, cycle FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY step DESC) AS r FROM walk) q WHERE r = 1),
g2 AS (
  SELECT o.request_id, CAST(o.ord AS INT) AS ord, CAST(o.pos AS INT) AS pos, t.task_id, t.task_type, t.priority, t.depends_on, o.cycle
  FROM (SELECT f.request_id, f.cycle, unnest(f.picked) AS pos, generate_subscripts(f.picked, 1) AS ord FROM final f) o
  JOIN t ON t.request_id = o.request_id AND t.pos = o.pos),
g3 AS (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY priority DESC, ord) AS INT) AS exec_ord FROM g2)
"""


def plan(t):
    return G.with_priority_order(G.plan_requests(t.tasks))


@query("unfold_requests", ("tasks",), """
SELECT request_id, pos, task_id, task_type, priority, depends_on FROM tasks""")
def unfold_requests(t):
    """G1: request rows with a nested task list, unfolded back to task rows."""
    requests = t.tasks.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "task_id", "task_type", "priority", "depends_on")))
        .alias("tasks"))
    return G.unfold_requests(requests.withColumn(
        "tasks", F.transform("tasks", lambda x: x.dropFields("pos"))))


@query("order_tasks", ("tasks",), WALK_CTES + """
SELECT request_id, ord, pos, task_id, task_type, priority, cycle FROM g2""")
def order_tasks(t):
    return G.order_tasks(G.plan_requests(t.tasks))


@query("priority_order", ("tasks",), WALK_CTES + """
SELECT request_id, exec_ord, ord, pos, task_id, task_type, priority FROM g3""")
def priority_order(t):
    return G.priority_order(plan(t))


@query("dependency_violations", ("tasks",), WALK_CTES + """
SELECT * FROM (
  SELECT a.request_id, a.task_id, a.depends_on, a.exec_ord AS task_exec_ord,
    (SELECT CAST(MIN(b.exec_ord) AS INT) FROM g3 b WHERE b.request_id = a.request_id AND b.task_id = a.depends_on) AS dep_exec_ord
  FROM g3 a WHERE a.depends_on IS NOT NULL) v
WHERE dep_exec_ord > task_exec_ord""")
def dependency_violations(t):
    return G.dependency_violations(plan(t))


@query("execution_mode", ("tasks",), """
SELECT request_id, CAST(COUNT(*) AS INT) AS n_rows, bool_or(depends_on IS NOT NULL) AS has_dependencies,
  CASE WHEN bool_or(depends_on IS NOT NULL) THEN 'sequential' ELSE 'parallel' END AS mode
FROM tasks GROUP BY request_id""")
def execution_mode(t):
    """G5 with parallel execution requested for every request."""
    return G.execution_mode(t.tasks)


@query("unknown_task_types", ("tasks",), f"""
SELECT request_id, pos, task_id, task_type, 'failed' AS status, 'Unknown task type: ' || task_type AS error
FROM tasks WHERE task_type NOT IN {_KNOWN}""")
def unknown_task_types(t):
    return G.unknown_task_types(t.tasks)


# Every task's run: its file through the agent of its type, with the stub providers' replies.
_FILE_CORPUS = """corpus AS (
  SELECT DISTINCT file_id, code, language, CAST(NULL AS VARCHAR) AS error_message, CAST(NULL AS VARCHAR) AS analysis_type,
    CAST(NULL AS VARCHAR) AS doc_type, CAST(NULL AS VARCHAR) AS style FROM task_inputs WHERE code IS NOT NULL)"""
RUN_CTES = WALK_CTES.rstrip() + f""",
{prompted_sql(lambda intent: _FILE_CORPUS)},
res AS (
  SELECT g.request_id, g.exec_ord, g.pos, g.task_id, i.session_id,
    CASE WHEN g.task_type IN {_KNOWN} AND i.code IS NOT NULL THEN 'completed' ELSE 'failed' END AS status,
    CASE WHEN g.task_type IN {_KNOWN} THEN {reply_sql("p.prompt")} END AS result,
    CASE WHEN g.task_type NOT IN {_KNOWN} THEN 'Unknown task type: ' || g.task_type WHEN i.code IS NULL THEN 'No code provided' END AS error
  FROM g3 g JOIN task_inputs i ON i.request_id = g.request_id AND i.pos = g.pos
  LEFT JOIN prompted p ON p.message_id = i.file_id AND p.agent_type = g.task_type AND i.code IS NOT NULL),
roll AS (
  SELECT r.request_id, MIN(r.session_id) AS session_id, MIN(sz.n) AS total_tasks,
    CAST(COALESCE(count_if(status = 'completed'), 0) AS INT) AS completed,
    CAST(COALESCE(count_if(status = 'failed'), 0) AS INT) AS failed,
    bool_and(status = 'completed') AS success, 0.0::DOUBLE AS total_time_ms, 0.0::DOUBLE AS pseudo_tokens,
    string_agg('### Task ' || CAST(exec_ord AS VARCHAR) || ': ' || task_id || chr(10) || 'Status: ' || status || chr(10)
      || 'Time: 0.00ms' || chr(10) || 'Result:' || chr(10) || COALESCE(result, error, 'None'), chr(10) || chr(10) ORDER BY exec_ord) AS summary
  FROM res r JOIN sz ON sz.request_id = r.request_id
  GROUP BY r.request_id)
"""


def orchestrated(t):
    """Result rows of every request: tasks on their files, stub providers, times left out so that reruns agree."""
    inputs = t.task_inputs.select("request_id", "pos", "session_id", "code", "language",
                                  *[F.lit(None).cast("string").alias(c) for c in ("error_message", "analysis_type", "doc_type", "style")])
    results, _histories, _executions = G.orchestrate(t.tasks.join(inputs, ["request_id", "pos"]), stub_providers(), timed=False)
    return results


@query("pending_tasks", ("tasks", "task_inputs"), RUN_CTES + """
SELECT q.request_id, q.pos, q.task_id, q.task_type FROM t q
WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.request_id = q.request_id AND r.pos = q.pos AND r.status = 'completed')""")
def pending_tasks(t):
    """Queued task rows with no successful run (failed or never run)."""
    acks = orchestrated(t).where("status = 'completed'").select("request_id", "pos")
    queue = t.tasks.select("request_id", "pos", "task_id", "task_type")
    return G.pending_tasks(queue, acks)


@query("orchestration_rollup", ("tasks", "task_inputs"), RUN_CTES + """
SELECT request_id, session_id, true AS parallel, total_tasks, completed, failed, success,
  CASE WHEN success THEN 'completed' ELSE 'partial' END AS status, total_time_ms, pseudo_tokens, summary
FROM roll""")
def orchestration_rollup(t):
    return G.orchestration_rollup(orchestrated(t))


@query("orchestration_log", ("tasks", "task_inputs"), RUN_CTES + """
SELECT session_id, 'Execute ' || CAST(total_tasks AS VARCHAR) || ' tasks' AS user_message, summary AS agent_response, 'orchestrator' AS agent_type,
  '{"total_tasks":' || CAST(total_tasks AS VARCHAR) || ',"completed":' || CAST(completed AS VARCHAR) || ',"failed":' || CAST(failed AS VARCHAR) || ',"parallel":true}' AS metadata_json,
  'Execute ' || CAST(total_tasks AS VARCHAR) || ' tasks orchestration' AS task_description, CASE WHEN success THEN 'completed' ELSE 'partial' END AS status,
  substring(summary, 1, 500) AS result, CAST(0 AS BIGINT) AS tokens_used
FROM roll""")
def orchestration_log(t):
    """The history row and the execution row of each request, side by side."""
    # stored, so that the runs are not rolled up for each side of the join
    rollup = materialize(G.orchestration_rollup(orchestrated(t)), "rollup")
    history, executions = G.orchestration_log(rollup)
    return history.join(executions.drop("agent_type", "execution_time_ms"), "session_id")
