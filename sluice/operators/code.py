"""Code-corpus operators: language, functions, imports, findings, metrics.

Input: ``code_files(file_id, filename, code)`` plus a ``language`` column.
Every operator is a per-row projection (plus ``posexplode`` for row-shaped
output): fixed lookup tables are unrolled into the expressions, so the plans
have no join and no shuffle, and the work grows linearly with the corpus.

Regular expressions follow Python ``re`` semantics on the JVM engine:
``(?d)`` makes ``\\n`` the only line end (as for ``.``, ``^`` and ``$`` in
Python) and ``(?U)`` makes ``\\w``/``\\s`` Unicode-aware, as Python's are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import count_sub, ustrip

# Marker put in front of every regex match before the text is split; any
# occurrence already in a file is removed first (the only change made to text).
MARK = "\u0001\ufdd1\u0001"

# Spark-side function patterns. Same matches as fixed.FUNCTION_PATTERNS; white
# space that is followed by a word character or a literal keyword is taken
# possessively (`\s*+`): giving it back can never let the rest match, so the
# result is unchanged while long white-space runs no longer backtrack.
_JVM_FUNCTION_PATTERNS = {
    "python": [r"(?mdU)^\s*+def\s+(\w+)\s*\((.*?)\)"],
    "js": [r"(?mdU)function\s+(\w+)\s*\((.*?)\)",
           r"(?mdU)const\s+(\w+)\s*=\s*(?:async\s*)?\((.*?)\)\s*=>"],
    "java": [r"(?dU)(?:public|private|protected)?\s*+(?:static)?\s*+(?:final)?\s*+\w+\s+(\w+)\s*\((.*?)\)"],
}

_JVM_IMPORT_PATTERNS = {
    "python": [r"(?mdU)^\s*+import\s+(.+)$", r"(?mdU)^\s*+from\s+(.+?)\s+import\s+(.+)$"],
    "js": [r"(?mdU)^\s*+import\s+.+?\s+from\s+['\"](.+?)['\"]", r"(?mdU)^\s*+require\(['\"](.+?)['\"]\)"],
    "java": [r"(?mdU)^\s*+import\s+(.+);"],
}

_FN_TYPE = "array<struct<name:string,params:string,line:int>>"


# ---------------------------------------------------------------- language

def _basename(filename: Column) -> Column:
    """Last path part (trailing slashes ignored)."""
    return F.regexp_extract(filename, r"([^/]*)/*$", 1)


def file_suffix(filename: Column) -> Column:
    """Suffix of the last path part: ``.ext`` with at least one character
    before the dot and none after it; dot-files have no suffix."""
    return F.regexp_extract(_basename(filename), r"^.+(\.[^.]+)$", 1)


def _suffix_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def file_language(filename: Column) -> Column:
    """Language from the lower-cased suffix; NULL when the suffix is not
    in the table."""
    return F.try_element_at(_suffix_map(fixed.BACKEND_SUFFIXES), F.lower(file_suffix(filename)))


def upload_language(filename: Column) -> Column:
    """The chat page's rule: case-sensitive ends-with, first hit, else ``unknown``."""
    expr = F.lit("unknown")
    for suffix, lang in reversed(fixed.UPLOAD_SUFFIXES):
        expr = F.when(filename.endswith(suffix), F.lit(lang)).otherwise(expr)
    return expr


def with_language(files: DataFrame, default: str = "text") -> DataFrame:
    """Add ``language`` from the suffix; unknown suffixes get ``default``."""
    return files.withColumn("language", F.coalesce(file_language(F.col("filename")), F.lit(default)))


# ---------------------------------------------------------------- functions

def _find_all(code: Column, pattern: str) -> Column:
    """Every match of ``pattern`` as ``struct(name=group 1, params=group 2, line)``.

    A marker goes in front of each match, the text is split on it, and piece
    *i* (i >= 2) starts exactly at match *i-1*. The 1-based line of a match is
    one plus the newlines in all earlier pieces, carried by a running sum.
    """
    marked = F.regexp_replace(code, pattern, MARK + "$0")
    pieces = F.split(marked, MARK, -1)
    starts = F.aggregate(
        pieces,
        F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("lines")),
        lambda acc, p: F.struct(
            (acc["line"] + count_sub(p, "\n").cast("int")).alias("line"),
            F.concat(acc["lines"], F.array(acc["line"])).alias("lines")),
    )["lines"]
    found = F.zip_with(pieces, starts, lambda p, ln: F.struct(
        F.regexp_extract(p, pattern, 1).alias("name"),
        F.regexp_extract(p, pattern, 2).alias("params"),
        ln.alias("line")))
    # texts without a match skip the split and the running line count
    return F.when(code.rlike(pattern), F.slice(found, 2, F.size(found) - 1)) \
        .otherwise(F.array().cast(_FN_TYPE))


def _clean(code: Column) -> Column:
    return F.replace(code, F.lit(MARK), F.lit(""))


def functions_of(code: Column, language: Column) -> Column:
    """D4 as an array column: definitions pattern by pattern, then by position."""
    text = _clean(code)

    def run(key):
        parts = [_find_all(text, p) for p in _JVM_FUNCTION_PATTERNS[key]]
        return reduce(F.concat, parts) if len(parts) > 1 else parts[0]

    return (F.when(language == "python", run("python"))
            .when(language.isin("javascript", "typescript"), run("js"))
            .when(language == "java", run("java"))
            .otherwise(F.array().cast(_FN_TYPE)))


def extract_functions(files: DataFrame) -> DataFrame:
    """One row per definition: file_id, fn_index (1-based), name, params, line."""
    return (files.select("file_id", F.posexplode(functions_of(F.col("code"), F.col("language"))))
            .select("file_id", (F.col("pos") + 1).cast("int").alias("fn_index"),
                    F.col("col.name").alias("name"), F.col("col.params").alias("params"),
                    F.col("col.line").alias("line")))


# ---------------------------------------------------------------- imports

def imports_of(code: Column, language: Column) -> Column:
    """D5 as an array column: group 1 of every import pattern, pattern by pattern."""

    def run(key):
        parts = [F.regexp_extract_all(code, F.lit(p), 1) for p in _JVM_IMPORT_PATTERNS[key]]
        return reduce(F.concat, parts) if len(parts) > 1 else parts[0]

    return (F.when(language == "python", run("python"))
            .when(language.isin("javascript", "typescript"), run("js"))
            .when(language == "java", run("java"))
            .otherwise(F.array().cast("array<string>")))


def extract_imports(files: DataFrame) -> DataFrame:
    """One row per import: file_id, import_index (1-based), module."""
    return (files.select("file_id", F.posexplode(imports_of(F.col("code"), F.col("language"))))
            .select("file_id", (F.col("pos") + 1).cast("int").alias("import_index"),
                    F.col("col").alias("module")))


# ---------------------------------------------------------------- findings

_FINDING_TYPE = ("struct<type:string,message:string,line:int,code:string,severity:string>")


def bracket_findings(code: Column) -> Column:
    """D6 as an array column: one finding per bracket pair whose counts differ."""
    items = [
        F.struct(
            (count_sub(code, o) != count_sub(code, c)).alias("bad"),
            F.struct(F.lit("bracket_mismatch").alias("type"),
                     F.lit(f"Mismatched {o}{c} brackets").alias("message"),
                     F.lit(None).cast("int").alias("line"),
                     F.lit(None).cast("string").alias("code"),
                     F.lit("high").alias("severity")).alias("f"))
        for o, c in fixed.BRACKET_PAIRS
    ]
    return F.transform(F.filter(F.array(*items), lambda x: x["bad"]), lambda x: x["f"])


def bracket_balance(files: DataFrame) -> DataFrame:
    """file_id, finding_index, type, message, severity for unbalanced pairs."""
    return (files.select("file_id", F.posexplode(bracket_findings(F.col("code"))))
            .select("file_id", (F.col("pos") + 1).cast("int").alias("finding_index"),
                    "col.type", "col.message", "col.severity"))


def pattern_findings(code: Column, language: Column) -> Column:
    """D7 as an array column: for each pattern of the file's language (in
    order), one finding per matching line (in line order).

    The pattern table is fixed and tiny, so it is unrolled into the
    expression: every line is tested only against its own language's
    patterns, with no join and no shuffle.
    """
    lines = F.transform(F.split(code, "\n", -1),
                        lambda l, i: F.struct(l.alias("text"), (i + 1).alias("line")))

    def per_pattern(pattern, message):
        hits = F.filter(lines, lambda x: x["text"].rlike(pattern))
        return F.transform(hits, lambda x: F.struct(
            F.lit("error_pattern").alias("type"), F.lit(message).alias("message"),
            x["line"].cast("int").alias("line"), ustrip(x["text"]).alias("code"),
            F.lit("high").alias("severity")))

    empty = F.array().cast(f"array<{_FINDING_TYPE}>")
    expr = empty
    for lang, pats in reversed(list(fixed.ERROR_PATTERNS.items())):
        # a pattern's lines are scanned only when the pattern occurs in the
        # text at all; the whole language is skipped when none occurs
        found = reduce(F.concat, [F.when(code.rlike(p), per_pattern(p, m)).otherwise(empty)
                                  for p, m in pats])
        any_hit = code.rlike("|".join(f"(?:{p})" for p, _ in pats))
        expr = F.when(language == lang, F.when(any_hit, found).otherwise(empty)).otherwise(expr)
    return expr


def findings_of(code: Column, language: Column) -> Column:
    """D8 as an array column: bracket findings, then pattern findings."""
    return F.concat(bracket_findings(code), pattern_findings(code, language))


def _explode_findings(files: DataFrame, arr: Column) -> DataFrame:
    return (files.select("file_id", F.posexplode(arr))
            .select("file_id", (F.col("pos") + 1).cast("int").alias("finding_index"),
                    "col.type", "col.message", "col.line", "col.code", "col.severity"))


def error_patterns(files: DataFrame) -> DataFrame:
    """One row per (pattern, line) hit, ``finding_index`` in list order."""
    return _explode_findings(files, pattern_findings(F.col("code"), F.col("language")))


def syntax_findings(files: DataFrame) -> DataFrame:
    """D6 then D7 as one ordered list per file."""
    return _explode_findings(files, findings_of(F.col("code"), F.col("language")))


# ---------------------------------------------------------------- metrics

def quality_exprs(code: Column, language: Column, functions: Column | None = None) -> dict[str, Column]:
    """D9 as named expressions over the file's lines (``split`` on ``\\n``)."""
    lines = F.split(code, "\n", -1)
    n = F.size(lines)

    def count_matching(pattern):
        return F.size(F.filter(lines, lambda l: l.rlike(pattern)))

    fn = functions if functions is not None else functions_of(code, language)
    tabs = F.instr(code, "\t") > 0
    space_led = F.exists(lines, lambda l: l.startswith(" "))
    return {
        "total_lines": n.cast("int"),
        "non_empty_lines": count_matching(r"(?U)[^\s\x1C-\x1F]").cast("int"),
        "comment_lines": F.when(language == "python", count_matching(r"(?U)^[\s\x1C-\x1F]*#"))
        .otherwise(count_matching(r"(?U)^[\s\x1C-\x1F]*//")).cast("int"),
        "average_line_length": (F.length(code) - (n - 1)) / n,
        "functions": F.size(fn).cast("int"),
        "indentation_issues": F.when((language == "python") & tabs & space_led, 1).otherwise(0).cast("int"),
        "long_lines": F.size(F.filter(lines, lambda l: F.length(l) > fixed.LONG_LINE_CHARS)).cast("int"),
    }


def quality_columns(code: Column, language: Column, functions: Column | None = None) -> list[Column]:
    """D9 as aliased columns."""
    return [c.alias(k) for k, c in quality_exprs(code, language, functions).items()]


def quality_metrics(files: DataFrame) -> DataFrame:
    """Per file the seven quality numbers."""
    return files.select("file_id", *quality_columns(F.col("code"), F.col("language")))


def corpus_profile(files: DataFrame) -> DataFrame:
    """D9 plus function and import counts in one projection.

    The function array is computed once and feeds both counts.
    """
    with_fn = files.withColumn("_fn", functions_of(F.col("code"), F.col("language")))
    return with_fn.select(
        "file_id", "language",
        *quality_columns(F.col("code"), F.col("language"), F.col("_fn")),
        F.size(F.col("_fn")).cast("int").alias("functions_count"),
        F.size(imports_of(F.col("code"), F.col("language"))).cast("int").alias("imports_count"))
