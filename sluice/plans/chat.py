"""Registered chat queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import chat as C
from .registry import query

_FENCE_RE = r"'(?s)```(\w+)?\n(.*?)\n```'"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _sql_list(words) -> str:
    return " OR ".join(f"strpos(lower(content), '{w}') > 0" for w in words)


def _first_word_sql(words, default) -> str:
    arms = " ".join(f"WHEN strpos(lower(content), '{w}') > 0 THEN '{w}'" for w in words)
    return f"CASE {arms} ELSE '{default}' END"


_CODE_SQL = f"CASE WHEN regexp_matches(content, {_FENCE_RE}) THEN regexp_extract(content, {_FENCE_RE}, 2) END"
_LANG_SQL = (f"CASE WHEN regexp_matches(content, {_FENCE_RE}) THEN "
             f"COALESCE(NULLIF(regexp_extract(content, {_FENCE_RE}, 1), ''), 'unknown') END")
_INTENT_SQL = ("CASE " + " ".join(f"WHEN {_sql_list(ws)} THEN '{i}'" for i, ws in fixed.ROUTE_WORDS)
               + f" ELSE '{fixed.ROUTE_DEFAULT}' END")
_ERROR_SQL = f"CASE WHEN strpos(lower(content), 'error:') > 0 THEN trim(string_split(content, 'error:')[-1], {_WS}) END"
_ANALYSIS_SQL = _first_word_sql(fixed.ANALYSIS_WORDS, fixed.ANALYSIS_DEFAULT)
_DOCTYPE_SQL = _first_word_sql(fixed.DOC_TYPE_WORDS, fixed.DOC_TYPE_DEFAULT)
_STYLE_SQL = _first_word_sql(fixed.DOC_STYLE_WORDS, fixed.DOC_STYLE_DEFAULT)

_REQUESTS_CTE = f"""WITH req AS (
  SELECT message_id, session_id, created_at, code, language, intent,
    CASE WHEN intent = 'menu' THEN 'show_menu' WHEN code IS NULL OR code = '' THEN 'ask_for_code' ELSE 'call_agent' END AS action,
    CASE WHEN intent = 'debug' THEN err END AS error_message,
    CASE WHEN intent = 'analyze' THEN an END AS analysis_type,
    CASE WHEN intent = 'docs' THEN dt END AS doc_type,
    CASE WHEN intent = 'docs' THEN st END AS style
  FROM (SELECT *, {_CODE_SQL} AS code, {_LANG_SQL} AS language, {_INTENT_SQL} AS intent,
          {_ERROR_SQL} AS err, {_ANALYSIS_SQL} AS an, {_DOCTYPE_SQL} AS dt, {_STYLE_SQL} AS st
        FROM chat_messages) m)
"""


@query("extract_fence", ("chat_messages",), f"""
SELECT message_id, {_CODE_SQL} AS code, {_LANG_SQL} AS language FROM chat_messages""")
def extract_fence(t):
    return C.extract_fence(t.chat_messages).select("message_id", "code", "language")


@query("route_intent", ("chat_messages",), _REQUESTS_CTE + """
SELECT message_id, intent, action FROM req""")
def route_intent(t):
    return C.chat_requests(t.chat_messages).select("message_id", "intent", "action")


@query("error_message", ("chat_messages",), f"""
SELECT message_id, {_ERROR_SQL} AS error_message FROM chat_messages""")
def error_message(t):
    return t.chat_messages.select("message_id", C.error_message(F.col("content")).alias("error_message"))


@query("analysis_type", ("chat_messages",), f"""
SELECT message_id, {_ANALYSIS_SQL} AS analysis_type FROM chat_messages""")
def analysis_type(t):
    return t.chat_messages.select("message_id", C.analysis_type(F.col("content")).alias("analysis_type"))


@query("doc_type_style", ("chat_messages",), f"""
SELECT message_id, {_DOCTYPE_SQL} AS doc_type, {_STYLE_SQL} AS style FROM chat_messages""")
def doc_type_style(t):
    c = F.col("content")
    return t.chat_messages.select("message_id", C.doc_type(c).alias("doc_type"), C.doc_style(c).alias("style"))


@query("chat_requests", ("chat_messages",), _REQUESTS_CTE + """
SELECT * FROM req""")
def chat_requests(t):
    return C.chat_requests(t.chat_messages)


@query("fan_out_tasks", ("chat_messages",), _REQUESTS_CTE + """
SELECT r.message_id, r.session_id, f.pos, f.task_id, f.task_type, COALESCE(r.language, 'unknown') AS language,
  f.analysis_type, f.doc_type, f.style, '' AS depends_on, 0 AS priority, r.code
FROM req r CROSS JOIN (VALUES (1, 'debug', 'debugger', NULL, NULL, NULL),
                              (2, 'analyze', 'analyzer', 'comprehensive', NULL, NULL),
                              (3, 'docs', 'docs_generator', NULL, 'function', 'google'))
     f(pos, task_id, task_type, analysis_type, doc_type, style)
WHERE r.intent = 'orchestrate' AND r.action = 'call_agent'""")
def fan_out_tasks(t):
    out = C.fan_out_tasks(C.chat_requests(t.chat_messages))
    return out.withColumn("depends_on", F.array_join("depends_on", ","))
