"""Batch inference with provider fallback (E5) and the agent job.

A provider is a plain callable ``pandas.Series[str] -> pandas.Series[str]``
(one reply per prompt; an empty reply means "no answer"). Providers are
passed as ``(name, factory)`` pairs: the factory runs once per task, so a
client is built once per partition, never per row. A provider that raises for
some prompts is skipped for those prompts only: a call that raises is repeated
on halves of its batch until the prompts that raise are alone. Replies thus
depend on the prompts, not on the batches they came in. A provider that raises
``RunError`` ends the run of the prompt it was raised for; one that raises
``ProviderDown`` is asked for nothing more in that batch.

Only distinct prompts are sent (keyed by a SHA-256 of the text), and the
number of partitions of that distinct set caps how many calls run at once.
Model replies are not reproducible, so the agent job checkpoints the replies
once to the session's checkpoint folder before deriving its three outputs:
a lost executor can then never make the response, history and execution
rows disagree.

Agents are plug-ins (``Agent``): a registry maps an agent type to a DataFrame
function that writes prompts, and to what its log rows say.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..session import input_partitions, materialize
from . import prompts as P

Provider = Callable[["object"], "object"]
ProviderFactory = Callable[[], Provider]

REPLY_SCHEMA = ("_prompt_hash string, reply string, provider string, call_ms double, prompt_chars long, "
                "details string, run_error string")


class RunError(Exception):
    """Raised by a provider: the run of these prompts failed, and no other provider is asked."""


class ProviderDown(Exception):
    """Raised by a provider that cannot answer anything now: it is skipped without further calls."""


def ask(provider: Provider, prompts):
    """``(replies, errors)``, Series by the index of ``prompts``.

    A reply is null where the provider raised, an error where it raised
    ``RunError``. Halving costs two calls a level for each prompt that raises.
    """
    import pandas as pd

    replies = pd.Series(None, index=prompts.index, dtype=object)
    errors = pd.Series(None, index=prompts.index, dtype=object)
    todo = [prompts] if len(prompts) else []
    while todo:
        part = todo.pop()
        try:
            replies.loc[part.index] = pd.Series(list(provider(part)), index=part.index, dtype=object)
        except ProviderDown:
            break
        except Exception as error:
            if len(part) > 1:
                middle = len(part) // 2
                todo += [part.iloc[middle:], part.iloc[:middle]]
            elif isinstance(error, RunError):
                errors.loc[part.index] = str(error)
    return replies, errors


def _caller(providers: Sequence[tuple[str, ProviderFactory]]):
    def call(batches):
        import pandas as pd

        clients = []
        for name, factory in providers:
            try:
                clients.append((name, factory()))
            except Exception:  # a provider that cannot start is skipped
                continue
        for pdf in batches:
            prompts = pdf["prompt"].fillna("")
            reply = pd.Series("", index=pdf.index, dtype=object)
            chosen = pd.Series("none", index=pdf.index, dtype=object)
            raised = pd.Series(None, index=pdf.index, dtype=object)
            todo = pd.Series(True, index=pdf.index)
            t0 = time.perf_counter()
            for name, provider in clients:
                if not todo.any():
                    break
                out, errors = ask(provider, prompts[todo])
                failed = errors.index[errors.notna()]
                raised.loc[failed] = errors.loc[failed]
                out = out.where(out.notna(), "").astype(str)
                got = out.index[out != ""]
                reply.loc[got] = out.loc[got]
                chosen.loc[got] = name
                todo.loc[got.union(failed)] = False
            per_row = (time.perf_counter() - t0) * 1000.0 / max(len(pdf), 1)
            yield pd.DataFrame({"_prompt_hash": pdf["_prompt_hash"], "reply": reply,
                                "provider": chosen, "call_ms": per_row,
                                "prompt_chars": prompts.str.len().astype("int64"),
                                "details": pdf["details"], "run_error": raised})

    return call


def batch_inference(df: DataFrame, providers: Sequence[tuple[str, ProviderFactory]],
                    prompt_col: str = "prompt", max_parallel_calls: int | None = None,
                    key: str | None = None) -> DataFrame:
    """E5: add ``reply``, ``provider``, ``call_ms`` and ``run_error`` to every row.

    First non-empty reply in provider order wins; a provider that raises is
    skipped; nothing → ``("", "none")``. ``run_error`` is the message of a
    ``RunError``. The distinct prompts are spread over the cores, or over
    ``max_parallel_calls`` partitions.

    ``key`` names a unique column of a table whose prompts are distinct already
    and lie as they should be sent: they are then neither hashed nor moved, and
    the result has that column and the added ones, for the caller to join.
    """
    added = ["reply", "provider", "call_ms", "run_error"]
    if key:
        return call_providers(df.select(key, F.col(prompt_col).alias("prompt")), providers, key, max_parallel_calls).select(key, *added)
    keyed = df.withColumn("_prompt_hash", F.sha2(F.coalesce(F.col(prompt_col), F.lit("")), 256))
    distinct = keyed.select("_prompt_hash", F.col(prompt_col).alias("prompt")).dropDuplicates(["_prompt_hash"])
    replies = call_providers(distinct, providers, "_prompt_hash", max_parallel_calls or input_partitions(df))
    return keyed.join(replies.select("_prompt_hash", *added), "_prompt_hash", "left").select(*df.columns, *added)


# ------------------------------------------------------------------ agents

def _language():
    return F.coalesce(F.col("language"), F.lit("unknown"))


def _or_default(name: str, default: str):
    return F.coalesce(F.col(name), F.lit(default))


def _debug_message() -> Column:
    return F.concat(F.lit("Debug "), _language(), F.lit(" code"))


def _analysis_message() -> Column:
    return F.concat(F.lit("Analyze "), _language(), F.lit(" code ("), _or_default("analysis_type", fixed.ANALYSIS_DEFAULT), F.lit(")"))


def _docs_message() -> Column:
    return F.concat(F.lit("Generate "), _or_default("doc_type", fixed.DOC_TYPE_DEFAULT), F.lit(" documentation ("),
                    _or_default("style", fixed.DOC_STYLE_DEFAULT), F.lit(" style)"))


@dataclass(frozen=True)
class Agent:
    """A plug-in agent.

    ``prompts`` is a DataFrame function: it gets requests with a column
    ``_in_hash`` and the input columns and returns them with ``prompt`` (null:
    no run) and ``details`` (a string of its own, or null). Agents that share
    one function are served by one call of it. ``message`` is the user message
    of the log rows and ``metadata`` the members of its JSON beside language,
    provider and settings, both from the request columns and ``details``.
    ``failure`` is the task text and the error prefix of a run that raised.
    """

    prompts: Callable[[DataFrame], DataFrame]
    message: Callable[[], Column]
    metadata: Callable[[Column], Mapping[str, Column]]
    settings: tuple[float, int]
    failure: tuple[str, str]


def _told(details: Column) -> Column:
    return F.from_json(details, P.DETAILS_DDL)


def default_agents(texts: P.Texts | None = None) -> dict[str, Agent]:
    """The three built-in agents, with the section texts of ``texts``.

    They share one prompt function, so a mixed table is read once.
    """
    def write(requests: DataFrame) -> DataFrame:
        return P.agent_prompt_column(requests, texts=texts)

    return {
        "debugger": Agent(write, _debug_message, lambda d: {
            "error_message": F.col("error_message"), "syntax_errors_found": _told(d)["syntax_errors_found"]},
            fixed.AGENT_SETTINGS["debugger"], fixed.AGENT_FAILURES["debugger"]),
        "analyzer": Agent(write, _analysis_message, lambda d: {
            "analysis_type": _or_default("analysis_type", fixed.ANALYSIS_DEFAULT), "quality_metrics": _told(d)["quality_metrics"]},
            fixed.AGENT_SETTINGS["analyzer"], fixed.AGENT_FAILURES["analyzer"]),
        "docs_generator": Agent(write, _docs_message, lambda d: {
            "doc_type": _or_default("doc_type", fixed.DOC_TYPE_DEFAULT), "style": _or_default("style", fixed.DOC_STYLE_DEFAULT)},
            fixed.AGENT_SETTINGS["docs_generator"], fixed.AGENT_FAILURES["docs_generator"]),
    }


def _choose(kind: Column, values: Mapping[str, Column]) -> Column:
    """The value of the row's agent type; null for others."""
    return reduce(lambda out, item: out.when(kind == item[0], item[1]), values.items(), F.when(F.lit(False), F.lit(None)))


def _metadata(agents: Mapping[str, Agent], details: Column) -> Column:
    """JSON of a run: what its agent was told and found, the provider and the settings."""
    kind = F.col("agent_type")

    def members(agent: Agent) -> Column:
        temperature, max_tokens = agent.settings
        own = [value.alias(name) for name, value in agent.metadata(details).items()]
        return F.to_json(F.struct(_language().alias("language"), *own, F.col("provider"),
                                  F.struct(F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens")).alias("settings")))

    return _choose(kind, {name: members(agent) for name, agent in agents.items()})


def agent_prompts(requests: DataFrame, agents: Mapping[str, Agent] | None = None) -> DataFrame:
    """``prompt`` and ``details`` per agent request, by the agent of its type.

    ``requests`` columns: agent_type, code, language, error_message,
    analysis_type, doc_type, style, and any others. Each distinct prompt
    function reads the requests of its types once; requests of other types
    give no row.
    """
    agents = agents or default_agents()
    served: dict[Callable, list[str]] = {}
    for name, agent in agents.items():
        served.setdefault(agent.prompts, []).append(name)
    names = [*requests.columns, "prompt", "details"]
    parts = [write(requests.where(F.col("agent_type").isin(*kinds))).select(*names) for write, kinds in served.items()]
    return reduce(DataFrame.unionByName, parts).where(F.col("prompt").isNotNull())


def call_providers(prompts: DataFrame, providers: Sequence[tuple[str, ProviderFactory]],
                   key: str, max_parallel_calls: int | None = None) -> DataFrame:
    """Send already-distinct prompts (one row per ``key``) to the providers.

    Returns ``key, reply, provider, call_ms, prompt_chars, details, run_error``;
    ``details`` is passed through (null if ``prompts`` has none), ``run_error``
    is the message of a ``RunError``.
    """
    details = F.col("details") if "details" in prompts.columns else F.lit(None).cast("string").alias("details")
    src = prompts.select(F.col(key).alias("_prompt_hash"), "prompt", details)
    if max_parallel_calls:
        src = src.repartition(max_parallel_calls, "_prompt_hash")
    return src.mapInPandas(_caller(providers), REPLY_SCHEMA).withColumnRenamed("_prompt_hash", key)


INPUT_COLUMNS = ["agent_type", "code", "language", "error_message", "analysis_type", "doc_type", "style"]


def agent_job(requests: DataFrame, providers: Sequence[tuple[str, ProviderFactory]],
              max_parallel_calls: int | None = None, checkpoint: bool = True,
              agents: Mapping[str, Agent] | None = None):
    """One response row per request, plus history and execution rows.

    Returns ``(responses, history_rows, execution_rows)``. A request without
    code fails with ``No code provided``; a request without any reply fails
    with ``Failed to get response from LLM`` and, as in the service, is not
    logged; one with an agent type that ``agents`` (default: the three built-in
    ones) does not have fails with that message. A run that raised fails with
    its agent's error text and leaves a ``failed`` execution row. Successful
    requests produce one history and one execution row.

    A prompt is a pure function of the request's inputs, so requests are
    de-duplicated on a hash of those inputs first: prompts are assembled and
    sent once per distinct input, and the answers join back on the hash.
    """
    agents = agents or default_agents()
    has_code = F.coalesce(F.col("code"), F.lit("")) != ""
    keyed = requests.withColumn(
        "_in_hash", F.sha2(F.to_json(F.struct(*[F.col(c) for c in INPUT_COLUMNS])), 256))
    # filter after the de-duplication: the predicate then stays above the
    # aggregate instead of being copied into the scan below it
    # copies are combined before the shuffle; only distinct inputs are then
    # spread, so the CPU-heavy prompt assembly keeps one partition per core
    distinct = (keyed.select("_in_hash", *INPUT_COLUMNS).dropDuplicates(["_in_hash"])
                .repartition(input_partitions(requests), "_in_hash").where(has_code))
    answers = call_providers(agent_prompts(distinct, agents), providers, "_in_hash", max_parallel_calls)
    if checkpoint:
        answers = materialize(answers, "answers")
    answers = answers.withColumnRenamed("details", "_details")
    # one pass over the requests: rows without code find no answer
    joined = keyed.join(answers, "_in_hash", "left").drop("_in_hash").withColumn("_has_code", has_code)
    code_ok = F.col("_has_code")
    kind = F.col("agent_type")
    known = F.coalesce(kind.isin(*agents), F.lit(False))
    raised = code_ok & known & F.col("run_error").isNotNull()
    ok = code_ok & known & (F.coalesce(F.col("reply"), F.lit("")) != "")
    meta = _metadata(agents, F.col("_details"))
    message = _choose(kind, {name: agent.message() for name, agent in agents.items()})
    tokens = (P.floor_div(F.col("prompt_chars"), fixed.CHARS_PER_TOKEN)
              + P.floor_div(F.length("reply"), fixed.CHARS_PER_TOKEN))
    prefix = _choose(kind, {name: F.lit(agent.failure[1]) for name, agent in agents.items()})
    responses = joined.select(
        "request_id", "session_id", "agent_type", ok.alias("success"),
        F.when(ok, F.col("reply")).alias("result"),
        F.when(~known, F.concat(F.lit(fixed.UNKNOWN_AGENT), F.coalesce("agent_type", F.lit("None"))))
        .when(~code_ok, F.lit("No code provided"))
        .when(raised, F.concat(prefix, F.col("run_error")))
        .when(~ok, F.lit("Failed to get response from LLM")).alias("error"),
        F.when(ok, tokens).alias("tokens_used"),
        F.when(code_ok, F.col("call_ms")).otherwise(F.lit(0.0)).alias("execution_time_ms"),
        F.when(code_ok, F.col("provider")).alias("provider"),
        F.when(ok, meta).alias("metadata_json"))

    history_rows = joined.where(ok).select(
        "session_id", message.alias("user_message"), F.col("reply").alias("agent_response"),
        "agent_type", meta.alias("metadata_json"))
    exec_rows = joined.where(ok | raised).select(
        "session_id", "agent_type",
        F.when(raised, _choose(kind, {name: F.lit(agent.failure[0]) for name, agent in agents.items()}))
        .otherwise(message).alias("task_description"),
        F.when(raised, F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        F.when(ok, F.substring("reply", 1, fixed.RESULT_PREFIX_CHARS)).alias("result"),
        F.col("run_error").alias("error_message"),
        F.col("call_ms").alias("execution_time_ms"),
        F.when(ok, tokens).otherwise(F.lit(0)).alias("tokens_used"),
        F.when(ok, F.col("provider")).alias("model_used"))
    return responses, history_rows, exec_rows


def requests_from_chat(chat_requests: DataFrame) -> DataFrame:
    """Agent requests from routed chat messages (debug / analyze / docs)."""
    agent = (F.when(F.col("intent") == "debug", F.lit("debugger"))
             .when(F.col("intent") == "analyze", F.lit("analyzer"))
             .when(F.col("intent") == "docs", F.lit("docs_generator")))
    return (chat_requests.where(F.col("intent").isin("debug", "analyze", "docs"))
            .select(F.col("message_id").alias("request_id"), "session_id", agent.alias("agent_type"),
                    "code", "language", "error_message", "analysis_type", "doc_type", "style"))
