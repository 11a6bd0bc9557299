"""Chat-message operators: code fences, intent routing, request parameters.

Input: ``chat_messages(message_id, session_id, created_at, content)`` and,
optionally, an attachment (``attachment_name``, ``attachment_code``) that
wins over a fenced block. All rules are ordered ``when`` chains of substring
tests on the lower-cased whole message, evaluated per row in codegen.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import ustrip
from .code import upload_language

# First fenced block: optional language word, a newline, the body (lazy,
# across lines), a newline, the closing fence.
FENCE_PATTERN = r"(?sU)```(\w+)?\n(.*?)\n```"


def _any_word(text: Column, words) -> Column:
    """Substring test for any of ``words`` as one regex alternation (the words
    are plain letters, so this is exactly an OR of ``contains``)."""
    return text.rlike("|".join(words))


def fence_match(content: Column) -> Column:
    """The whole first fenced block, or '' when there is none (a match always
    holds the fence characters, so it is never empty)."""
    return F.regexp_extract(content, FENCE_PATTERN, 0)


def fence_code(fence: Column) -> Column:
    """Body of a fenced block found by :func:`fence_match` (NULL if none)."""
    return F.when(fence != "", F.regexp_extract(fence, FENCE_PATTERN, 2))


def fence_language(fence: Column) -> Column:
    lang = F.regexp_extract(fence, FENCE_PATTERN, 1)
    return F.when(fence != "", F.when(lang == "", F.lit("unknown")).otherwise(lang))


def extract_fence(messages: DataFrame) -> DataFrame:
    """code and language of the message: the attachment if there is one
    (language from its name, chat-page rule), else the first fenced block
    (its tag or ``unknown``), else NULL for both."""
    df = messages.withColumn("_fence", fence_match(F.col("content")))
    fence = F.col("_fence")
    code, lang = fence_code(fence), fence_language(fence)
    if "attachment_code" in messages.columns:
        has_file = F.col("attachment_code").isNotNull() & (F.col("attachment_code") != "")
        code = F.when(has_file, F.col("attachment_code")).otherwise(code)
        lang = F.when(has_file, upload_language(F.col("attachment_name"))).otherwise(lang)
    return df.withColumn("code", code).withColumn("language", lang).drop("_fence")


def route_intent(content: Column) -> Column:
    """first matching word group wins; no match → ``menu``."""
    low = F.lower(content)
    expr = F.lit(fixed.ROUTE_DEFAULT)
    for intent, words in reversed(fixed.ROUTE_WORDS):
        expr = F.when(_any_word(low, words), F.lit(intent)).otherwise(expr)
    return expr


def route_action(intent: Column, code: Column) -> Column:
    """What the chat page does next: the menu, a request for code, or the agent call."""
    return (F.when(intent == fixed.ROUTE_DEFAULT, F.lit("show_menu"))
            .when(code.isNull() | (code == ""), F.lit("ask_for_code"))
            .otherwise(F.lit("call_agent")))


def error_message(content: Column) -> Column:
    """text after the last case-sensitive ``error:``, stripped, when the
    lower-cased message holds ``error:``; else NULL. If only ``Error:`` occurs
    the split finds nothing and the whole (stripped) message comes back."""
    tail = F.element_at(F.split(content, "error:", -1), -1)
    return F.when(F.lower(content).contains("error:"), ustrip(tail))


def _first_word(content: Column, words, default: str) -> Column:
    low = F.lower(content)
    expr = F.lit(default)
    for w in reversed(words):
        expr = F.when(low.contains(w), F.lit(w)).otherwise(expr)
    return expr


def analysis_type(content: Column) -> Column:
    """security, else performance, else quality, else comprehensive."""
    return _first_word(content, fixed.ANALYSIS_WORDS, fixed.ANALYSIS_DEFAULT)


def doc_type(content: Column) -> Column:
    """Class / module / api, else function (substring test)."""
    return _first_word(content, fixed.DOC_TYPE_WORDS, fixed.DOC_TYPE_DEFAULT)


def doc_style(content: Column) -> Column:
    """Numpy / sphinx, else google."""
    return _first_word(content, fixed.DOC_STYLE_WORDS, fixed.DOC_STYLE_DEFAULT)


def chat_requests(messages: DataFrame) -> DataFrame:
    """F1-F5 in one projection: what each message asks for, with its parameters.

    ``intent`` is computed once as a column and referenced afterwards, so the
    routing expression is not repeated inside the generated code.
    """
    df = extract_fence(messages).withColumn("intent", route_intent(F.col("content")))
    c, intent = F.col("content"), F.col("intent")
    return df.select(
        "message_id", "session_id", "created_at", "code", "language", "intent",
        route_action(intent, F.col("code")).alias("action"),
        F.when(intent == "debug", error_message(c)).alias("error_message"),
        F.when(intent == "analyze", analysis_type(c)).alias("analysis_type"),
        F.when(intent == "docs", doc_type(c)).alias("doc_type"),
        F.when(intent == "docs", doc_style(c)).alias("style"))


# The three tasks a multi-task request fans out to (fixed by the chat page).
_FAN_OUT = [
    ("debug", "debugger", None, None, None),
    ("analyze", "analyzer", "comprehensive", None, None),
    ("docs", "docs_generator", None, "function", "google"),
]


def fan_out_tasks(requests: DataFrame) -> DataFrame:
    """each orchestrate request with code → three independent tasks,
    priority 0, no dependencies, in a fixed order (``pos`` 1..3)."""
    tasks = F.array(*[
        F.struct(F.lit(i + 1).alias("pos"), F.lit(tid).alias("task_id"), F.lit(ttype).alias("task_type"),
                 F.lit(at).cast("string").alias("analysis_type"), F.lit(dt).cast("string").alias("doc_type"),
                 F.lit(st).cast("string").alias("style"))
        for i, (tid, ttype, at, dt, st) in enumerate(_FAN_OUT)])
    src = requests.where((F.col("intent") == "orchestrate") & (F.col("action") == "call_agent"))
    return (src.select("message_id", "session_id", "code",
                       F.coalesce(F.col("language"), F.lit("unknown")).alias("language"),
                       F.explode(tasks).alias("t"))
            .select("message_id", "session_id", "t.pos", "t.task_id", "t.task_type", "language",
                    "t.analysis_type", "t.doc_type", "t.style",
                    F.array().cast("array<string>").alias("depends_on"),
                    F.lit(0).alias("priority"), "code"))
