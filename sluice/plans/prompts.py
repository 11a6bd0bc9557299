"""Registered prompt, provider and inference queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import fixed
from ..operators import chat as C
from ..operators import inference as I
from ..operators import prompts as P
from .chat import _REQUESTS_CTE
from .code import _bracket_cte, _fn_ctes, _METRICS_SQL, _PATTERN_HITS
from ..session import input_partitions, materialize
from .registry import query
from .stubs import provider_sql, reply_sql, stub_providers


def _lit(s: str) -> str:
    """A Python text as a DuckDB string expression (newlines via chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts) if s else "''"


def _preamble_sql(agent: str, instructions_sql: str | None = None) -> str:
    role, text = P.ROLES[agent]
    head, tail = P.PREAMBLE.split("{instructions}")
    return f"{_lit(head.format(role=role))} || {instructions_sql or _lit(text)} || {_lit(tail)}"


def _fenced_sql(lang: str, code: str) -> str:
    return f"'```' || {lang} || chr(10) || {code} || chr(10) || '```' || chr(10) || chr(10)"


def _case_map_sql(expr: str, d: dict, default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {_lit(v)}" for k, v in d.items())
    return f"COALESCE(CASE {expr} {arms} END, {default})"


def _tokens_sql(expr: str) -> str:
    return f"CAST(floor(length({expr}) / 4) AS BIGINT)"


_CHAT_CORPUS = """corpus AS (
  SELECT message_id AS file_id, code, COALESCE(language, 'unknown') AS language, error_message,
    analysis_type, doc_type, style
  FROM req WHERE intent = '{intent}' AND action = 'call_agent')"""


def _requests(intent: str):
    return lambda t: C.chat_requests(t.chat_messages).where(
        (F.col("intent") == intent) & (F.col("action") == "call_agent"))


# ------------------------------------------------------------------ E1, E8

@query("token_estimate", ("history",), f"""
SELECT id, {_tokens_sql('user_message')} + {_tokens_sql('agent_response')} AS tokens_used,
  {_tokens_sql('user_message')} AS prompt_tokens
FROM history""")
def token_estimate(t):
    h = t.history
    return h.select("id", P.token_estimate(F.col("user_message"), F.col("agent_response")).alias("tokens_used"),
                    P.token_estimate(F.col("user_message")).alias("prompt_tokens"))


@query("execution_rows", ("history",), f"""
SELECT id, session_id, agent_type, user_message AS task_description, 'completed' AS status,
  substring(agent_response, 1, {fixed.RESULT_PREFIX_CHARS}) AS result,
  {_tokens_sql('user_message')} + {_tokens_sql('agent_response')} AS tokens_used, 'history' AS model_used
FROM history""")
def execution_rows(t):
    """Execution-log rows for the logged replies of the conversation history."""
    h = t.history.withColumn("provider", F.lit("history"))
    return P.execution_rows(h, reply="agent_response", prompt="user_message").select(
        "id", "session_id", "agent_type", F.col("user_message").alias("task_description"), "status",
        "result", "tokens_used", "model_used")


# ------------------------------------------------------------------ E6

@query("resolve_provider", (), """
SELECT conv_id, COALESCE(arg_min(text, turn) FILTER (WHERE text IS NOT NULL AND text <> ''), '') AS reply,
  COALESCE(arg_min('turn-' || CAST(turn AS VARCHAR), turn) FILTER (WHERE text IS NOT NULL AND text <> ''), 'none') AS provider
FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def resolve_provider(t):
    """E6 in row form: assistant turns are candidate replies ranked by turn;
    the first non-empty one wins per conversation."""
    c = t.conversations.where(F.col("role") == "assistant")
    replies = c.select("conv_id", F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("provider"),
                       F.col("turn").alias("rank"), F.col("text").alias("reply"))
    return P.resolve_provider_rows(replies, key="conv_id")


# ------------------------------------------------------------------ E2

_FINDINGS_LIST = """flist AS (
  SELECT file_id, COUNT(*) AS n, string_agg(txt, chr(10) ORDER BY grp, k1, k2) AS txt FROM (
    SELECT file_id, 0 AS grp, k AS k1, 0 AS k2, '- ' || message AS txt FROM brackets
    UNION ALL
    SELECT file_id, 1, pattern_index, line, '- ' || message || ' (line ' || CAST(line AS VARCHAR) || ')' FROM hits) u
  GROUP BY file_id)"""

_DEBUG_PROMPT_SQL = (
    f"{_preamble_sql('debugger')} || chr(10) || chr(10) || 'Debug this ' || c.language || ' code:' || chr(10) || chr(10) || "
    f"{_fenced_sql('c.language', 'c.code')} || "
    "CASE WHEN c.error_message IS NOT NULL AND c.error_message <> '' THEN 'Reported error: ' || c.error_message || chr(10) || chr(10) ELSE '' END || "
    "CASE WHEN fl.n > 0 THEN 'Static checks found:' || chr(10) || fl.txt || chr(10) || chr(10) ELSE '' END || "
    f"{_lit(P.DEBUG_ASK)}")


@query("debug_prompts", ("chat_messages",), _REQUESTS_CTE.rstrip() + ",\n"
       + _CHAT_CORPUS.format(intent="debug") + ",\n" + _bracket_cte() + ",\n" + _PATTERN_HITS + ",\n"
       + _FINDINGS_LIST + f"""
SELECT file_id AS message_id, CAST(COALESCE(n, 0) AS INT) AS findings_count, prompt, {_tokens_sql('prompt')} AS prompt_tokens
FROM (SELECT c.file_id, fl.n, {_DEBUG_PROMPT_SQL} AS prompt
      FROM corpus c LEFT JOIN flist fl USING (file_id)) p""")
def debug_prompts(t):
    return P.debug_prompts(_requests("debug")(t)).select(
        "message_id", "findings_count", "prompt", "prompt_tokens")


# ------------------------------------------------------------------ E3

_ATYPE = f"COALESCE(c.analysis_type, '{fixed.ANALYSIS_DEFAULT}')"
_ANALYSIS_PROMPT_SQL = (
    _preamble_sql("analyzer", f"'Review the code below (' || {_ATYPE} || ' review) and report what should change.'")
    + " || chr(10) || chr(10) || 'Review this ' || c.language || ' code:' || chr(10) || chr(10) || "
    + _fenced_sql("c.language", "c.code")
    + " || 'Metrics:' || chr(10) || '- Lines: ' || CAST(len(ls) AS VARCHAR)"
    + r" || chr(10) || '- Non-blank lines: ' || CAST(len(list_filter(ls, lambda l: regexp_matches(l, '\S'))) AS VARCHAR)"
    + " || chr(10) || '- Functions: ' || CAST(COALESCE(nf.n, 0) AS VARCHAR)"
    + " || chr(10) || '- Lines over 100 characters: ' || CAST(len(list_filter(ls, lambda l: length(l) > 100)) AS VARCHAR)"
    + " || chr(10) || '- Mean line length: ' || printf('%.1f', floor((length(c.code) - (len(ls) - 1)) / len(ls) * 10 + 0.5) / 10)"
    + " || chr(10) || chr(10) || "
    + _case_map_sql(_ATYPE, P.ANALYSIS_SECTIONS, _lit(P.ANALYSIS_SECTIONS[fixed.ANALYSIS_DEFAULT]))
    + " || chr(10) || chr(10) || 'Give concrete, actionable feedback.'")


@query("analysis_prompts", ("chat_messages",), _REQUESTS_CTE.rstrip() + ",\n"
       + _CHAT_CORPUS.format(intent="analyze") + ",\n" + _fn_ctes() + f"""
SELECT file_id AS message_id, prompt, {_tokens_sql('prompt')} AS prompt_tokens
FROM (SELECT c.file_id, {_ANALYSIS_PROMPT_SQL} AS prompt
      FROM (SELECT *, string_split(code, chr(10)) AS ls FROM corpus) c
      LEFT JOIN (SELECT file_id, COUNT(*) AS n FROM fns GROUP BY file_id) nf USING (file_id)) p""")
def analysis_prompts(t):
    return P.analysis_prompts(_requests("analyze")(t)).select("message_id", "prompt", "prompt_tokens")


# ------------------------------------------------------------------ E4

_DTYPE = f"COALESCE(c.doc_type, '{fixed.DOC_TYPE_DEFAULT}')"
_STYLE = f"COALESCE(c.style, '{fixed.DOC_STYLE_DEFAULT}')"
_STYLE_SEC = " ".join(f"WHEN '{k}' THEN chr(10) || {_lit(v)}" for k, v in P.STYLE_SECTIONS.items())
_DOCS_PROMPT_SQL = (
    _preamble_sql("docs_generator", f"'Write ' || {_STYLE} || '-style ' || {_DTYPE} || ' documentation that a newcomer can follow.'")
    + f" || chr(10) || chr(10) || 'Write ' || {_STYLE} || '-style ' || {_DTYPE} || ' documentation for this ' || c.language || ' code:' || chr(10) || chr(10) || "
    + _fenced_sql("c.language", "c.code") + " || "
    + _case_map_sql(_DTYPE, P.DOC_SECTIONS, "''")
    + f" || chr(10) || chr(10) || 'Use the ' || {_STYLE} || ' style:' || COALESCE(CASE {_STYLE} {_STYLE_SEC} END, '')")


@query("docs_prompts", ("chat_messages",), _REQUESTS_CTE.rstrip() + ",\n"
       + _CHAT_CORPUS.format(intent="docs") + f"""
SELECT file_id AS message_id, prompt, {_tokens_sql('prompt')} AS prompt_tokens
FROM (SELECT c.file_id, {_DOCS_PROMPT_SQL} AS prompt FROM corpus c) p""")
def docs_prompts(t):
    return P.docs_prompts(_requests("docs")(t)).select("message_id", "prompt", "prompt_tokens")


# ------------------------------------------------------------------ E5, E7

# Every agent request with its prompt, and what the run learned about its code as JSON members.
_METRIC_NAMES = re.findall(r"AS (\w+),?$", _METRICS_SQL, re.M)
_METRICS_JSON = " || ',' || ".join(f"'\"{n}\":' || CAST({'avg_length' if n == 'average_line_length' else n} AS VARCHAR)" for n in _METRIC_NAMES)
def prompted_sql(corpus) -> str:
    """CTE ``prompted(message_id, agent_type, prompt, details)``; ``corpus(intent)`` defines the code each agent sees."""
    return f"""prompted AS (
  (WITH {corpus("debug")}, {_bracket_cte()}, {_PATTERN_HITS}, {_FINDINGS_LIST}
   SELECT c.file_id AS message_id, 'debugger' AS agent_type, {_DEBUG_PROMPT_SQL} AS prompt,
     CASE WHEN c.error_message IS NULL THEN '' ELSE ',"error_message":' || CAST(to_json(c.error_message) AS VARCHAR) END
       || ',"syntax_errors_found":' || CAST(COALESCE(fl.n, 0) AS VARCHAR) AS details
   FROM corpus c LEFT JOIN flist fl USING (file_id))
  UNION ALL
  (WITH {corpus("analyze")}, {_fn_ctes()},
   measured AS (
     SELECT c.*, nf.n, (length(code) - (len(ls) - 1)) / len(ls) AS avg_length, {_METRICS_SQL}
     FROM (SELECT *, string_split(code, chr(10)) AS ls FROM corpus) c
     LEFT JOIN (SELECT file_id, COUNT(*) AS n FROM fns GROUP BY file_id) nf USING (file_id))
   SELECT c.file_id, 'analyzer', {_ANALYSIS_PROMPT_SQL.replace("nf.n", "c.n")},
     ',"analysis_type":' || CAST(to_json({_ATYPE}) AS VARCHAR) || ',"quality_metrics":{{' || {_METRICS_JSON} || '}}'
   FROM measured c)
  UNION ALL
  (WITH {corpus("docs")}
   SELECT c.file_id, 'docs_generator', {_DOCS_PROMPT_SQL},
     ',"doc_type":' || CAST(to_json({_DTYPE}) AS VARCHAR) || ',"style":' || CAST(to_json({_STYLE}) AS VARCHAR)
   FROM corpus c))"""


_ALL_PROMPTS = _REQUESTS_CTE.rstrip() + f""",
{prompted_sql(lambda intent: _CHAT_CORPUS.format(intent=intent))},
answered AS (
  SELECT message_id AS request_id, agent_type, prompt, details, {provider_sql("prompt")} AS provider, {reply_sql("prompt")} AS reply
  FROM prompted)
"""

_SETTINGS_CASE = " ".join(f"WHEN '{k}' THEN '{{\"temperature\":{t},\"max_tokens\":{m}}}'" for k, (t, m) in fixed.AGENT_SETTINGS.items())
_AGENT_JOB_SQL = _ALL_PROMPTS + f"""
SELECT r.message_id AS request_id, r.session_id,
  CASE r.intent WHEN 'debug' THEN 'debugger' WHEN 'analyze' THEN 'analyzer' ELSE 'docs_generator' END AS agent_type,
  a.reply IS NOT NULL AS success, a.reply AS result,
  CASE WHEN a.reply IS NULL THEN 'No code provided' END AS error,
  {_tokens_sql("a.prompt")} + {_tokens_sql("a.reply")} AS tokens_used, a.provider,
  '{{"language":' || CAST(to_json(COALESCE(r.language, 'unknown')) AS VARCHAR) || a.details || ',"provider":"' || a.provider
    || '","settings":' || CASE a.agent_type {_SETTINGS_CASE} END || '}}' AS metadata_json
FROM req r LEFT JOIN answered a ON a.request_id = r.message_id
WHERE r.intent IN ('debug', 'analyze', 'docs')"""


@query("batch_inference", ("chat_messages",), _ALL_PROMPTS + """
SELECT request_id, agent_type, provider, reply FROM answered""")
def batch_inference(t):
    """E5 over every routed chat request's prompt, with the stub providers.

    Prompts depend only on the request inputs, so they are built for the
    distinct inputs and the replies join back to every request. The requests
    are stored once, so that no message is parsed for each side of that join.
    """
    reqs = I.requests_from_chat(C.chat_requests(t.chat_messages))
    parts = input_partitions(t.chat_messages)
    keyed = materialize(reqs.withColumn("_in_hash", F.sha2(F.to_json(F.struct(*I.INPUT_COLUMNS)), 256)), "requests")
    distinct = (keyed.select("_in_hash", *I.INPUT_COLUMNS)
                .dropDuplicates(["_in_hash"]).repartition(parts, "_in_hash")
                .where(F.col("code").isNotNull()))
    answered = I.batch_inference(I.agent_prompts(distinct), stub_providers(), key="_in_hash")
    # a left join: an inner join would add an inferred NOT NULL filter on the
    # hash, copying the whole input expression into the scan stage
    return (keyed.where(F.col("code").isNotNull()).select("request_id", "agent_type", "_in_hash")
            .join(answered.select("_in_hash", "provider", "reply"), "_in_hash", "left")
            .drop("_in_hash"))


@query("agent_job", ("chat_messages",), _AGENT_JOB_SQL)
def agent_job(t):
    """Responses for every routed chat request (stub providers)."""
    reqs = I.requests_from_chat(C.chat_requests(t.chat_messages))
    responses, _history, _executions = I.agent_job(reqs, stub_providers())
    return responses.drop("execution_time_ms")
