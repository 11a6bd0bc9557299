"""Base tables and the derived fixture views.

The driver supplies TPC-H-like tables; the developer-assistant data model
(execution log, conversation log, source files, task requests, chat messages,
cache writes) is derived from them with one SQL text per view that runs
unchanged on Spark and DuckDB. The texts are templates: ``{events}`` etc.
name the input relations. Spark binds them to DataFrames
(``spark.sql(text, events=df)``); the DuckDB oracles bind them to the
pre-registered table names and use the text as a leading CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import TASK_BYTES, input_bytes, prepare

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed reference date for every "last N days" question.
AS_OF = "2024-01-31 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"

VIEW_SQL: dict[str, str] = {}
VIEW_INPUTS: dict[str, tuple[str, ...]] = {}

VIEW_SQL["executions"] = """
SELECT event_id AS id, 'user-' || CAST(user_id AS STRING) AS session_id,
  CASE event_type WHEN 'click' THEN 'debugger' WHEN 'view' THEN 'analyzer' WHEN 'purchase' THEN 'docs_generator' WHEN 'signup' THEN 'orchestrator' ELSE 'debugger' END AS agent_type,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'partial' ELSE 'completed' END AS status,
  value * 10 AS execution_time_ms, CAST(event_id % 700 AS INT) AS tokens_used,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'MistralProvider' ELSE 'OllamaProvider' END AS model_used,
  ts AS created_at
FROM {events}
"""
VIEW_INPUTS["executions"] = ("events",)

VIEW_SQL["history"] = """
SELECT id, session_id, user_message, agent_response, agent_type, created_at FROM (
  SELECT conv_id * 1000 + turn AS id, 'conv-' || CAST(conv_id AS STRING) AS session_id, text AS user_message, role,
    LEAD(text) OVER (PARTITION BY conv_id ORDER BY turn) AS agent_response,
    LEAD(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
    CASE conv_id % 4 WHEN 0 THEN 'debugger' WHEN 1 THEN 'analyzer' WHEN 2 THEN 'docs_generator' ELSE 'orchestrator' END AS agent_type,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * conv_id + INTERVAL '1' MINUTE * turn AS created_at
  FROM {conversations}) q
WHERE role = 'user' AND next_role = 'assistant'
"""
VIEW_INPUTS["history"] = ("conversations",)

VIEW_SQL["code_files"] = """
SELECT p_partkey AS file_id,
  'src/' || replace(lower(p_brand), '#', '_') || '/f' || CAST(p_partkey AS STRING) || CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java' WHEN 3 THEN '.TS' ELSE '.txt' END AS filename,
  CASE p_partkey % 5
  WHEN 0 THEN 'import os, sys' || chr(10) || 'from a.b' || CAST(p_size AS STRING) || ' import c as d' || chr(10) || chr(10) || '# ' || p_name || chr(10) ||
    CASE WHEN p_partkey % 2 = 0 THEN chr(9) ELSE '    ' END || 'def f' || CAST(p_size AS STRING) || '(x, y=(1, 2)):' || chr(10) || '    raise ' || CASE WHEN p_size % 3 = 0 THEN 'KeyError' WHEN p_size % 3 = 1 THEN 'TypeError' ELSE 'Oops' END || '(x' || CASE WHEN p_size % 2 = 0 THEN ')' ELSE '' END || chr(10) || 'def g():' || chr(10) || '    pass'
  WHEN 1 THEN 'import x from "m' || CAST(p_size AS STRING) || '"' || chr(10) || 'function f(a, b) {{ return a }}' || chr(10) || 'const g = async (q) => q' || CASE WHEN p_size % 4 = 0 THEN '}}' ELSE '' END || chr(10) || '// RangeError: ' || repeat('z', p_size * 3)
  WHEN 2 THEN 'import java.util.List;' || chr(10) || 'public class C {{' || chr(10) || '  public static int m' || CAST(p_size AS STRING) || '(int a) {{ return go(a); }}' || chr(10) || '  // NullPointerException' || chr(10) || '}}'
  WHEN 3 THEN 'import {{ a }} from ''lib''' || chr(10) || 'function t(n) {{ return n[0] }}'
  ELSE p_name || chr(10) || p_type END AS code
FROM {part}
"""
VIEW_INPUTS["code_files"] = ("part",)

VIEW_SQL["tasks"] = """
SELECT request_id, pos, task_id, task_type, priority,
  CASE WHEN k = 0 AND pos > 1 THEN 't' || CAST(pos - 1 AS STRING) WHEN k = 1 THEN 't' || CAST(pos + 1 AS STRING) WHEN k = 2 AND pos > 2 THEN 't1' ELSE NULL END AS depends_on
FROM (
  SELECT l_orderkey AS request_id, pos, 't' || CAST(CASE WHEN l_partkey % 29 = 0 THEN 1 ELSE pos END AS STRING) AS task_id,
    CASE l_partkey % 4 WHEN 0 THEN 'debugger' WHEN 1 THEN 'analyzer' WHEN 2 THEN 'docs_generator' ELSE 'generate_docs' END AS task_type,
    CAST(l_suppkey % 3 AS INT) AS priority, l_partkey % 7 AS k
  FROM (SELECT l_orderkey, l_partkey, l_suppkey, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS pos FROM {lineitem}) a) b
"""
VIEW_INPUTS["tasks"] = ("lineitem",)

# What each orchestrated task works on: the source file of its part; every tenth file comes without its code.
VIEW_SQL["task_inputs"] = """
SELECT a.request_id, a.pos, 'order-' || CAST(a.request_id AS STRING) AS session_id, a.file_id,
  CASE WHEN a.file_id % 10 = 9 THEN NULL ELSE f.code END AS code,
  CASE a.file_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' WHEN 3 THEN 'typescript' ELSE 'unknown' END AS language
FROM (SELECT l_orderkey AS request_id, l_partkey AS file_id,
    CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS pos FROM {lineitem}) a
  LEFT JOIN {code_files} f ON f.file_id = a.file_id
"""
VIEW_INPUTS["task_inputs"] = ("lineitem", "code_files")

VIEW_SQL["chat_messages"] = """
SELECT e.event_id AS message_id, 'user-' || CAST(e.user_id AS STRING) AS session_id, e.ts AS created_at,
  CASE e.event_type WHEN 'error' THEN 'Please debug this' WHEN 'view' THEN 'Review for ' || CASE WHEN e.event_id % 3 = 0 THEN 'security' WHEN e.event_id % 3 = 1 THEN 'performance' ELSE 'style' END
    WHEN 'click' THEN 'Document this ' || CASE WHEN e.event_id % 3 = 0 THEN 'class, numpy style' WHEN e.event_id % 3 = 1 THEN 'api, sphinx style' ELSE 'thing' END
    WHEN 'signup' THEN 'hello' ELSE 'run multiple jobs' END
  || CASE WHEN e.event_id % 4 = 3 THEN '' ELSE chr(10) || '```' || CASE c.file_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' ELSE '' END || chr(10) || c.code || chr(10) || '```' END
  || CASE WHEN e.event_type = 'error' AND e.event_id % 2 = 0 THEN chr(10) || 'error: boom ' || CAST(e.event_id AS STRING) WHEN e.event_type = 'error' THEN ' Error: X' ELSE '' END AS content
FROM (SELECT *, event_id % (SELECT COUNT(*) FROM {part}) AS file_no FROM {events}) e JOIN {code_files} c ON c.file_id = e.file_no
"""
VIEW_INPUTS["chat_messages"] = ("events", "code_files", "part")

VIEW_SQL["cache_entries"] = """
SELECT event_id AS id, md5(event_type || '|' || props) AS cache_key,
  CASE event_type WHEN 'click' THEN 'debug' WHEN 'view' THEN 'analysis' WHEN 'purchase' THEN 'docs' ELSE 'embedding' END AS cache_type,
  props AS value, event_id % (SELECT COUNT(*) FROM {embeddings}) AS vec_id, 24 AS ttl_hours, ts AS created_at, ts + INTERVAL '24' HOUR AS expires_at
FROM {events}
"""
VIEW_INPUTS["cache_entries"] = ("events", "embeddings")


# Views whose consumers do heavy per-row text work (regex scans, prompt
# assembly) before any shuffle: their base inputs are spread over the cores.
TEXT_VIEWS = {"code_files", "chat_messages"}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


class Tables:
    """Lazily resolved base tables and views of one data directory.

    Every attribute is a DataFrame; nothing is read until an action runs, and
    Catalyst prunes columns and pushes filters into each parquet scan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in BASE_TABLES:
                df = self.spark.read.parquet(table_path(self.sf_dir, name))
            elif name in VIEW_SQL:
                inputs = {n: spread(self.get(n)) if name in TEXT_VIEWS and n in BASE_TABLES else self.get(n)
                          for n in VIEW_INPUTS[name]}
                df = self.spark.sql(VIEW_SQL[name], **inputs)
            else:
                raise KeyError(f"unknown table or view: {name}")
            self._cache[name] = df
        return self._cache[name]


def spread(df: DataFrame) -> DataFrame:
    """Give a table whose input splits are few for the CPU time of its rows
    more partitions: one for each ``TASK_BYTES`` of its files, at least one per
    core (round-robin, deterministic under retries).

    The text operators spend CPU per row, not I/O per byte, so a small file
    read as one split would run them in a single task, and a large one in
    tasks that grow with the splits. A table that already has as many splits
    is returned unchanged. Used for the inputs of the text views only;
    everything else starts with its own exchange anyway.
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # no SparkContext on this client (e.g. Spark Connect)
        return df
    parts = max(cores, -(-input_bytes(df) // TASK_BYTES))
    return df.repartition(parts) if splits < parts else df


def view_cte(*names: str) -> str:
    """``WITH`` clause that defines the named views for a DuckDB oracle."""
    order = [n for n in VIEW_SQL if n in _closure(names)]
    parts = []
    for name in order:
        binding = {n: n for n in VIEW_INPUTS[name]}
        parts.append(f"{name} AS ({VIEW_SQL[name].format(**binding).strip()})")
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


def _closure(names) -> set[str]:
    seen: set[str] = set()
    stack = list(names)
    while stack:
        n = stack.pop()
        if n in VIEW_SQL and n not in seen:
            seen.add(n)
            stack.extend(VIEW_INPUTS[n])
    return seen
