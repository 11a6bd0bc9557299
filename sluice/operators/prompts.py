"""Prompt assembly and execution-log projections.

Prompts are built per row with ``concat``/``array_join`` — no Python. The
wording is this project's own; the structure follows the agents: a role
preamble, the code, then the request-specific blocks (error, findings,
metrics, sections). The default section texts are small literal maps looked up
with ``element_at``, so there is no join at all; a caller's own texts come as a
table (``Texts``) that joins on its names, broadcast only up to a checked size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import fixed_digits, floor_div
from .code import findings_of, functions_of, quality_columns, quality_exprs

# What agent_prompt_column tells of the code beside the prompt.
DETAILS_DDL = ("syntax_errors_found INT, quality_metrics STRUCT<total_lines: INT, non_empty_lines: INT, "
               "comment_lines: INT, average_line_length: DOUBLE, functions: INT, indentation_issues: INT, "
               "long_lines: INT>")

# ------------------------------------------------------------------ texts

# Short defaults of this project's own; callers with house texts replace them.
ROLES = {
    "debugger": ("bug finder", "Say what fails and why, and give working code."),
    "analyzer": ("code auditor", "Say what you would change, the most harmful first."),
    "docs_generator": ("technical author", "Write the text that belongs beside this code."),
}

PREAMBLE = "Role: {role}.\n\n{instructions}\n\nReply in markdown with fenced code."

DEBUG_ASK = "Explain each failure in one paragraph, then show the repaired code."

ANALYSIS_SECTIONS = {
    "security": "Judge only what an attacker could use.",
    "performance": "Judge only what costs time or memory.",
    "quality": "Judge only how easy the code is to change.",
    "comprehensive": "Judge risk, cost and clarity, each in one paragraph.",
}

DOC_SECTIONS = {
    "function": "Subject: the main function, from the view of its callers.",
    "class": "Subject: the main class, from the view of its users.",
    "module": "Subject: the module as a whole, and when to import it.",
    "api": "Subject: the interface, request by request.",
}

STYLE_SECTIONS = {
    "google": "Docstring style: Google.",
    "numpy": "Docstring style: NumPy.",
    "sphinx": "Docstring style: Sphinx fields.",
}


#: Kinds of section texts, and the request column that names the section.
SECTION_KINDS = {"analysis": "analysis_type", "doc": "doc_type", "style": "style"}
#: Bytes of one kind's texts up to which they are broadcast; larger ones join by shuffle.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Texts:
    """Section texts of a caller: a table ``kind, name, text``.

    ``kind`` is a key of ``SECTION_KINDS``. A row without a name is the kind's
    default, for requests whose name has no row. A kind without any row keeps
    the texts of this module. Of rows that repeat a kind and name the smallest
    text counts.
    """

    table: DataFrame

    def join(self, requests: DataFrame) -> DataFrame:
        """``requests`` with ``_section_<kind>`` for each kind that has rows."""
        named = self.table.where("kind is not null and text is not null").groupBy("kind", "name").agg(F.min("text").alias("text"))
        # one row a kind comes to the driver: its default text and its size
        sizes = named.groupBy("kind").agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("name"), F.lit(0))).alias("bytes"),
                                          F.max(F.when(F.col("name").isNull(), F.col("text"))).alias("default"))
        for row in sizes.where(F.col("kind").isin(*SECTION_KINDS)).collect():
            kind, column = row["kind"], f"_section_{row['kind']}"
            names = named.where((F.col("kind") == kind) & F.col("name").isNotNull()).select(
                F.col("name").alias("_name"), F.col("text").alias(column))
            if row["bytes"] <= BROADCAST_BYTES:
                names = F.broadcast(names)
            default = {"analysis": fixed.ANALYSIS_DEFAULT, "doc": fixed.DOC_TYPE_DEFAULT, "style": fixed.DOC_STYLE_DEFAULT}[kind]
            wanted = F.coalesce(F.col(SECTION_KINDS[kind]), F.lit(default))
            requests = (requests.join(names, wanted == F.col("_name"), "left").drop("_name")
                        .withColumn(column, F.coalesce(F.col(column), F.lit(row["default"]))))
        return requests


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def preamble(agent_type: str, instructions: Column | None = None) -> Column:
    role, text = ROLES[agent_type]
    head, tail = PREAMBLE.split("{instructions}")
    return F.concat(F.lit(head.format(role=role)),
                    instructions if instructions is not None else F.lit(text), F.lit(tail))


def _fenced(language: Column, code: Column) -> Column:
    return F.concat(F.lit("```"), language, F.lit("\n"), code, F.lit("\n```\n\n"))


def token_estimate(prompt: Column, reply: Column | None = None) -> Column:
    """``len(prompt)//4 + len(reply)//4`` (two floors), or one text ``len//4``."""
    est = floor_div(F.coalesce(F.length(prompt), F.lit(0)), fixed.CHARS_PER_TOKEN)
    if reply is not None:
        est = est + floor_div(F.coalesce(F.length(reply), F.lit(0)), fixed.CHARS_PER_TOKEN)
    return est


def findings_text(findings: Column) -> Column:
    """The finding list: ``- message (line n)`` per finding, one per line."""
    lines = F.transform(findings, lambda f: F.concat(
        F.lit("- "), f["message"],
        F.coalesce(F.concat(F.lit(" (line "), f["line"].cast("string"), F.lit(")")), F.lit(""))))
    return F.array_join(lines, "\n")


def _lang() -> Column:
    return F.coalesce(F.col("language"), F.lit("unknown"))


def debug_prompt(findings: Column) -> Column:
    """E2 text from the request columns (code, language, error_message) and
    its finding list (an array column computed once by the caller)."""
    lang = _lang()
    err = F.col("error_message")
    user = F.concat(
        F.lit("Debug this "), lang, F.lit(" code:\n\n"), _fenced(lang, F.col("code")),
        F.when(err.isNotNull() & (err != ""), F.concat(F.lit("Reported error: "), err, F.lit("\n\n")))
        .otherwise(F.lit("")),
        F.when(F.size(findings) > 0, F.concat(F.lit("Static checks found:\n"), findings_text(findings),
                                              F.lit("\n\n"))).otherwise(F.lit("")),
        F.lit(DEBUG_ASK))
    return F.concat(preamble("debugger"), F.lit("\n\n"), user)


def analysis_prompt(m: dict[str, Column] | Column, section: Column | None = None) -> Column:
    """E3 text from the request columns (code, language, analysis_type) and
    its quality metrics by name (expressions, or a struct computed once).

    ``section`` is a caller's text; the default texts stand in where it is absent.
    """
    lang = _lang()
    atype = F.coalesce(F.col("analysis_type"), F.lit(fixed.ANALYSIS_DEFAULT))
    metrics = F.concat(
        F.lit("Metrics:\n- Lines: "), m["total_lines"].cast("string"),
        F.lit("\n- Non-blank lines: "), m["non_empty_lines"].cast("string"),
        F.lit("\n- Functions: "), m["functions"].cast("string"),
        F.lit("\n- Lines over 100 characters: "), m["long_lines"].cast("string"),
        F.lit("\n- Mean line length: "), fixed_digits(m["average_line_length"], 1), F.lit("\n\n"))
    if section is None:
        section = F.coalesce(F.try_element_at(_map(ANALYSIS_SECTIONS), atype),
                             F.lit(ANALYSIS_SECTIONS[fixed.ANALYSIS_DEFAULT]))
    instructions = F.concat(F.lit("Review the code below ("), atype, F.lit(" review) and report what should change."))
    user = F.concat(F.lit("Review this "), lang, F.lit(" code:\n\n"), _fenced(lang, F.col("code")),
                    metrics, F.coalesce(section, F.lit("")), F.lit("\n\nGive concrete, actionable feedback."))
    return F.concat(preamble("analyzer", instructions), F.lit("\n\n"), user)


def docs_prompt(doc_section: Column | None = None, style_section: Column | None = None) -> Column:
    """E4 text from the request columns (code, language, doc_type, style), with a caller's section texts or the default ones."""
    lang = _lang()
    dtype = F.coalesce(F.col("doc_type"), F.lit(fixed.DOC_TYPE_DEFAULT))
    style = F.coalesce(F.col("style"), F.lit(fixed.DOC_STYLE_DEFAULT))
    dsec = F.coalesce(F.try_element_at(_map(DOC_SECTIONS), dtype) if doc_section is None else doc_section, F.lit(""))
    ssec = F.coalesce(F.concat(F.lit("\n"), F.try_element_at(_map(STYLE_SECTIONS), style) if style_section is None else style_section), F.lit(""))
    instructions = F.concat(F.lit("Write "), style, F.lit("-style "), dtype,
                            F.lit(" documentation that a newcomer can follow."))
    user = F.concat(F.lit("Write "), style, F.lit("-style "), dtype, F.lit(" documentation for this "),
                    lang, F.lit(" code:\n\n"), _fenced(lang, F.col("code")), dsec,
                    F.lit("\n\nUse the "), style, F.lit(" style:"), ssec)
    return F.concat(preamble("docs_generator", instructions), F.lit("\n\n"), user)


def debug_prompts(requests: DataFrame) -> DataFrame:
    """Prompt per debug request (code, language, optional error_message).

    Adds ``findings_count``, ``prompt`` and ``prompt_tokens``.
    """
    df = requests.withColumn("_findings", findings_of(F.col("code"), _lang()))
    return (df.withColumn("findings_count", F.size("_findings").cast("int"))
            .withColumn("prompt", debug_prompt(F.col("_findings"))).drop("_findings")
            .withColumn("prompt_tokens", token_estimate(F.col("prompt"))))


def _section(df: DataFrame, kind: str) -> Column | None:
    return F.col(f"_section_{kind}") if f"_section_{kind}" in df.columns else None


def _without_sections(df: DataFrame) -> DataFrame:
    return df.drop(*[f"_section_{kind}" for kind in SECTION_KINDS])


def analysis_prompts(requests: DataFrame, texts: Texts | None = None) -> DataFrame:
    """Prompt per analysis request, with the metrics block; an unknown
    analysis type falls back to the comprehensive section, or to the default
    row of ``texts``."""
    df = (texts.join(requests) if texts else requests).withColumn("_fn", functions_of(F.col("code"), _lang()))
    prompt = analysis_prompt(quality_exprs(F.col("code"), _lang(), F.col("_fn")), _section(df, "analysis"))
    return (_without_sections(df.withColumn("prompt", prompt).drop("_fn"))
            .withColumn("prompt_tokens", token_estimate(F.col("prompt"))))


def docs_prompts(requests: DataFrame, texts: Texts | None = None) -> DataFrame:
    """Prompt per documentation request; an unknown doc type or style adds
    no section, or the default row of ``texts``."""
    df = texts.join(requests) if texts else requests
    return (_without_sections(df.withColumn("prompt", docs_prompt(_section(df, "doc"), _section(df, "style"))))
            .withColumn("prompt_tokens", token_estimate(F.col("prompt"))))


def agent_prompt_column(df: DataFrame, agent_type: str = "agent_type", texts: Texts | None = None) -> DataFrame:
    """E2-E4 in one projection: each row gets the prompt of its agent type.

    The finding and function lists are computed only for the rows that need
    them, and ``CASE`` evaluates only the matching branch, so a mixed request
    table is read once (no union of three filtered copies). ``details`` is
    what the run learned about the code, as JSON of ``DETAILS_DDL``.
    """
    kind = F.col(agent_type)
    lang = _lang()
    df = texts.join(df) if texts else df
    metrics = F.struct(*quality_columns(F.col("code"), lang, F.col("_fn")))
    df = (df.withColumn("_findings", F.when(kind == "debugger", findings_of(F.col("code"), lang)))
          .withColumn("_fn", F.when(kind == "analyzer", functions_of(F.col("code"), lang)))
          .withColumn("_metrics", F.when(kind == "analyzer", metrics)))
    prompt = (F.when(kind == "debugger", debug_prompt(F.col("_findings")))
              .when(kind == "analyzer", analysis_prompt(F.col("_metrics"), _section(df, "analysis")))
              .when(kind == "docs_generator", docs_prompt(_section(df, "doc"), _section(df, "style"))))
    details = F.to_json(F.struct(F.when(kind == "debugger", F.size("_findings")).alias("syntax_errors_found"),
                                 F.col("_metrics").alias("quality_metrics")))
    return _without_sections(df.withColumn("prompt", prompt).withColumn("details", details).drop("_findings", "_fn", "_metrics"))


def resolve_provider(replies: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """E6 (columns): first non-empty reply in provider order and its provider
    name; nothing → ``("", "none")``."""
    reply = F.coalesce(*[F.nullif(c, F.lit("")) for _, c in replies], F.lit(""))
    name = F.lit("none")
    for pname, c in reversed(replies):
        name = F.when(F.coalesce(c, F.lit("")) != "", F.lit(pname)).otherwise(name)
    return reply, name


def resolve_provider_rows(replies: DataFrame, key: str = "request_id") -> DataFrame:
    """E6 (rows): ``(key, provider, rank, reply)`` → the first non-empty reply
    by rank per key. A partial aggregate (``min_by``) per key, so a hot key is
    reduced map-side before the shuffle."""
    ok = F.col("reply").isNotNull() & (F.col("reply") != "")
    best = F.min_by(F.when(ok, F.struct("provider", "reply")), F.when(ok, F.col("rank")))
    return (replies.groupBy(key).agg(best.alias("b"))
            .select(key, F.coalesce(F.col("b.reply"), F.lit("")).alias("reply"),
                    F.coalesce(F.col("b.provider"), F.lit("none")).alias("provider")))


def execution_rows(df: DataFrame, reply: str = "reply", prompt: str = "prompt",
                   provider: str = "provider") -> DataFrame:
    """Execution-log columns for successful runs: status, the first 500
    characters of the reply, token estimate and provider."""
    return df.select(
        "*",
        F.lit("completed").alias("status"),
        F.substring(F.col(reply), 1, fixed.RESULT_PREFIX_CHARS).alias("result"),
        token_estimate(F.col(prompt), F.col(reply)).alias("tokens_used"),
        F.col(provider).alias("model_used"))
