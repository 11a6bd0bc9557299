"""Registered code-corpus queries (D1, D2, D4-D10) and their DuckDB oracles.

Oracles use the original pattern texts with RE2's ``(?m)`` flag (RE2 has no
``d``/``U`` flags and no possessive quantifiers; on the ASCII fixtures it
agrees with Python ``re``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import code as D
from .registry import query

# ------------------------------------------------------------ oracle pieces


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case_map(expr: str, pairs) -> str:
    whens = " ".join(f"WHEN {_sql_str(k)} THEN {_sql_str(v)}" for k, v in pairs)
    return f"CASE {expr} {whens} END"


_SUFFIX_SQL = r"regexp_extract(regexp_extract(filename, '([^/]*)/*$', 1), '^.+(\.[^.]+)$', 1)"
_LANG_SQL = _case_map(f"lower({_SUFFIX_SQL})", fixed.BACKEND_SUFFIXES)

CORPUS_CTE = f"""corpus AS (
  SELECT file_id, filename, code, COALESCE({_LANG_SQL}, 'text') AS language FROM code_files)"""

_LANG_GROUPS = {"python": "('python')", "js": "('javascript', 'typescript')", "java": "('java')"}
_SRC_LANG = {"python": "python", "js": "javascript", "java": "java"}


def _re2(pattern: str, multiline: bool) -> str:
    return ("(?m)" if multiline else "") + pattern


def _fn_ctes() -> str:
    """CTEs ``fn_pieces`` → ``fns(file_id, fn_index, name, params, line)``."""
    parts = []
    for key, langs in _LANG_GROUPS.items():
        src = _SRC_LANG[key]
        for k, pat in enumerate(fixed.FUNCTION_PATTERNS[src], start=1):
            re_ = _sql_str(_re2(pat, fixed.FUNCTION_MULTILINE[src]))
            parts.append(f"""SELECT file_id, {k} AS pat, piece, i,
      regexp_extract(piece, {re_}, 1) AS name, regexp_extract(piece, {re_}, 2) AS params
    FROM (SELECT file_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
          FROM (SELECT file_id, string_split(regexp_replace(replace(code, chr(1), ''), {re_}, chr(1) || '\\0', 'g'), chr(1)) AS p
                FROM corpus WHERE language IN {langs}) a) b""")
    union = "\n    UNION ALL ".join(parts)
    return f"""fn_pieces AS (
    {union}),
fn_lined AS (
  SELECT *, 1 + COALESCE(SUM(length(piece) - length(replace(piece, chr(10), ''))) OVER (
      PARTITION BY file_id, pat ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
  FROM fn_pieces),
fns AS (
  SELECT file_id, CAST(ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY pat, i) AS INT) AS fn_index,
    name, params, CAST(line AS INT) AS line
  FROM fn_lined WHERE i > 1)"""


def _imports_cte() -> str:
    arms = []
    for key, langs in _LANG_GROUPS.items():
        src = _SRC_LANG[key]
        lists = [f"regexp_extract_all(code, {_sql_str(_re2(p, True))}, 1)" for p in fixed.IMPORT_PATTERNS[src]]
        expr = lists[0] if len(lists) == 1 else f"list_concat({', '.join(lists)})"
        arms.append(f"WHEN language IN {langs} THEN {expr}")
    return f"""imp_lists AS (
  SELECT file_id, CASE {' '.join(arms)} ELSE CAST([] AS VARCHAR[]) END AS imps FROM corpus),
imps AS (
  SELECT file_id, CAST(generate_subscripts(imps, 1) AS INT) AS import_index, unnest(imps) AS module
  FROM imp_lists)"""


def _bracket_cte() -> str:
    arms = []
    for k, (o, c) in enumerate(fixed.BRACKET_PAIRS, start=1):
        arms.append(f"""SELECT file_id, {k} AS k, 'bracket_mismatch' AS type, {_sql_str(f'Mismatched {o}{c} brackets')} AS message
    FROM corpus WHERE length(code) - length(replace(code, {_sql_str(o)}, '')) <> length(code) - length(replace(code, {_sql_str(c)}, ''))""")
    return "brackets AS (\n  " + "\n  UNION ALL ".join(arms) + ")"


def _pattern_values() -> str:
    rows = []
    for lang, pats in fixed.ERROR_PATTERNS.items():
        for i, (p, m) in enumerate(pats, start=1):
            rows.append(f"({_sql_str(lang)}, {i}, {_sql_str(p)}, {_sql_str(m)})")
    return "pats(language, pattern_index, pattern, message) AS (VALUES " + ", ".join(rows) + ")"


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_PATTERN_HITS = f"""{_pattern_values()},
lines AS (
  SELECT file_id, language, unnest(ls) AS text, CAST(generate_subscripts(ls, 1) AS INT) AS line
  FROM (SELECT file_id, language, string_split(code, chr(10)) AS ls FROM corpus) a),
hits AS (
  SELECT l.file_id, p.pattern_index, l.line, p.message, trim(l.text, {_WS}) AS code
  FROM lines l JOIN pats p ON l.language = p.language AND regexp_matches(l.text, p.pattern))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------------ queries

def corpus(t):
    return D.with_language(t.code_files)


@query("file_language", ("code_files",), f"""
SELECT file_id, filename, {_SUFFIX_SQL} AS suffix, {_LANG_SQL} AS language FROM code_files""")
def file_language(t):
    f = t.code_files
    return f.select("file_id", "filename", D.file_suffix(F.col("filename")).alias("suffix"),
                    D.file_language(F.col("filename")).alias("language"))


def _upload_sql() -> str:
    arms = " ".join(f"WHEN ends_with(filename, {_sql_str(s)}) THEN {_sql_str(l)}"
                    for s, l in fixed.UPLOAD_SUFFIXES)
    return f"CASE {arms} ELSE 'unknown' END"


@query("upload_language", ("code_files",), f"""
SELECT file_id, filename, {_upload_sql()} AS language FROM code_files""")
def upload_language(t):
    f = t.code_files
    return f.select("file_id", "filename", D.upload_language(F.col("filename")).alias("language"))


@query("extract_functions", ("code_files",), _with(CORPUS_CTE, _fn_ctes()) + """
SELECT file_id, fn_index, name, params, line FROM fns""")
def extract_functions(t):
    return D.extract_functions(corpus(t))


@query("extract_imports", ("code_files",), _with(CORPUS_CTE, _imports_cte()) + """
SELECT file_id, import_index, module FROM imps""")
def extract_imports(t):
    return D.extract_imports(corpus(t))


@query("bracket_balance", ("code_files",), _with(CORPUS_CTE, _bracket_cte()) + """
SELECT file_id, CAST(ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY k) AS INT) AS finding_index,
  type, message, 'high' AS severity FROM brackets""")
def bracket_balance(t):
    return D.bracket_balance(corpus(t))


@query("error_patterns", ("code_files",), _with(CORPUS_CTE, _PATTERN_HITS) + """
SELECT file_id, CAST(ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY pattern_index, line) AS INT) AS finding_index,
  'error_pattern' AS type, message, line, code, 'high' AS severity FROM hits""")
def error_patterns(t):
    return D.error_patterns(corpus(t))


@query("syntax_findings", ("code_files",), _with(CORPUS_CTE, _bracket_cte(), _PATTERN_HITS) + """
SELECT file_id, CAST(ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY grp, k1, k2) AS INT) AS finding_index,
  type, message, line, code, 'high' AS severity
FROM (SELECT file_id, 0 AS grp, k AS k1, 0 AS k2, type, message, CAST(NULL AS INT) AS line, CAST(NULL AS VARCHAR) AS code FROM brackets
      UNION ALL
      SELECT file_id, 1, pattern_index, line, 'error_pattern', message, line, code FROM hits) u""")
def syntax_findings(t):
    return D.syntax_findings(corpus(t))


_METRICS_SQL = r"""
  CAST(len(ls) AS INT) AS total_lines,
  CAST(len(list_filter(ls, lambda l: regexp_matches(l, '\S'))) AS INT) AS non_empty_lines,
  CAST(len(list_filter(ls, lambda l: regexp_matches(l, CASE WHEN language = 'python' THEN '^\s*#' ELSE '^\s*//' END))) AS INT) AS comment_lines,
  ROUND((length(code) - (len(ls) - 1)) / len(ls), 6) AS average_line_length,
  CAST(COALESCE(nf.n, 0) AS INT) AS functions,
  CAST(CASE WHEN language = 'python' AND strpos(code, chr(9)) > 0
            AND len(list_filter(ls, lambda l: starts_with(l, ' '))) > 0 THEN 1 ELSE 0 END AS INT) AS indentation_issues,
  CAST(len(list_filter(ls, lambda l: length(l) > 100)) AS INT) AS long_lines"""

_METRICS_FROM = """FROM (SELECT *, string_split(code, chr(10)) AS ls FROM corpus) c
LEFT JOIN (SELECT file_id, COUNT(*) AS n FROM fns GROUP BY file_id) nf USING (file_id)"""


def _round_len(df):
    return df.withColumn("average_line_length", F.round("average_line_length", 6))


@query("quality_metrics", ("code_files",), _with(CORPUS_CTE, _fn_ctes()) + f"""
SELECT file_id, {_METRICS_SQL}
{_METRICS_FROM}""")
def quality_metrics(t):
    return _round_len(D.quality_metrics(corpus(t)))


@query("corpus_profile", ("code_files",), _with(CORPUS_CTE, _fn_ctes(), _imports_cte()) + f"""
SELECT file_id, language, {_METRICS_SQL},
  CAST(COALESCE(nf.n, 0) AS INT) AS functions_count,
  CAST(COALESCE(ni.n, 0) AS INT) AS imports_count
{_METRICS_FROM}
LEFT JOIN (SELECT file_id, COUNT(*) AS n FROM imps GROUP BY file_id) ni USING (file_id)""")
def corpus_profile(t):
    return _round_len(D.corpus_profile(corpus(t)))
