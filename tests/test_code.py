"""Code-corpus operators against the Python restatement on edge rows."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import code as D

from . import twins

EDGE = [
    ("python", ""),
    ("python", "\n\n\n"),
    ("python", "\n\n\ndef a(x)\n"),
    ("python", "def f(x, y=(1, 2)):\n\treturn x\n  def g():\n pass"),
    ("python", "import os, sys\nfrom a.b import c\nimport   \nx = {'k': [1, 2}\nraise KeyError('k')\r\n"),
    ("python", "def ünï(ä):\n    ValueError\u0001 and TypeError"),
    ("python", "async def h(a):\n    pass\ndef k(a,\n b):\n  pass"),
    ("javascript", "function f(a, b) { return a }\nconst g = async (q) => q\nconst h = (x) =>\nrequire('m')\n  require(\"n\")\nCannot read properties of undefined"),
    ("typescript", "import { a } from 'lib'\nimport x from \"y\"\nfunction t(n) { return n[0] }"),
    ("java", "import java.util.List;\npublic class C {\n  public static int m(int a) { return go(a); }\n  // IOException\n}"),
    ("java", "   \n\n\t  \nprivate final String name(String s) {\n throw new NullPointerException(); }"),
    ("text", "plain words (unbalanced"),
    ("python", "x" * 150 + "\n# comment\n    # indented comment"),
]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(i, f"f{i}", code, lang) for i, (lang, code) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "file_id long, filename string, code string, language string")


def test_functions_match_python(files):
    got = {}
    for r in D.extract_functions(files).collect():
        got.setdefault(r.file_id, []).append((r.fn_index, r.name, r.params, r.line))
    for i, (lang, code) in enumerate(EDGE):
        clean = code.replace(D.MARK, "")
        want = [(k + 1, *f) for k, f in enumerate(twins.functions(clean, lang))]
        assert sorted(got.get(i, [])) == want, (i, code)


def test_blank_lines_above_def_report_first_blank_line(files):
    rows = D.extract_functions(files).where("file_id = 2").collect()
    assert [(r.name, r.line) for r in rows] == [("a", 1)]


def test_imports_match_python(files):
    got = {}
    for r in D.extract_imports(files).collect():
        got.setdefault(r.file_id, []).append((r.import_index, r.module))
    for i, (lang, code) in enumerate(EDGE):
        want = [(k + 1, m) for k, m in enumerate(twins.imports(code, lang))]
        assert sorted(got.get(i, [])) == want, (i, code)


def test_findings_match_python(files):
    got = {}
    for r in D.syntax_findings(files).collect():
        got.setdefault(r.file_id, []).append((r.finding_index, r.type, r.message, r.line, r.code))
    for i, (lang, code) in enumerate(EDGE):
        want = [(k + 1, *f) for k, f in enumerate(twins.findings(code, lang))]
        assert sorted(got.get(i, [])) == want, (i, code)


def test_metrics_match_python(files):
    rows = {r.file_id: r.asDict() for r in D.quality_metrics(files).collect()}
    for i, (lang, code) in enumerate(EDGE):
        want = twins.metrics(code, lang)
        # the function count reads the text with the split marker removed
        want["functions"] = len(twins.functions(code.replace(D.MARK, ""), lang))
        got = rows[i]
        for k, v in want.items():
            assert got[k] == pytest.approx(v), (i, k, got[k], v)


@pytest.mark.parametrize("name", ["a.py", "A.PY", ".py", "x/.bashrc", "a.", "a..b", "dir.d/file", "x/y.tar.gz",
                                  "noext", "a/b/c.TS", "..py", "trail/"])
def test_suffix_language(spark, name):
    got = spark.range(1).select(D.file_language(F.lit(name)).alias("l")).first().l
    assert got == twins.suffix_language(name)


def test_upload_language_is_case_sensitive(spark):
    df = spark.createDataFrame([("a.py",), ("a.PY",), ("a.scala",), (".py",), ("x.tsx",)], "n string")
    got = [r.l for r in df.select(D.upload_language(F.col("n")).alias("l")).collect()]
    assert got == ["python", "unknown", "unknown", "python", "tsx"]


def test_control_characters_in_code_stay(spark):
    """The marker between matches is a sequence of its own: single control characters are part of the code."""
    code = "def f(a\x01b):\n    pass\n\x01def not_at_line_start(x):\n\x01\ndef g\x01(x):\ndef h(y):\n"
    df = spark.createDataFrame([(1, code, "python")], "file_id long, code string, language string")
    got = [(r.name, r.params, r.line) for r in D.extract_functions(df).collect()]
    import re

    want = [(m[1], m[2], code[:m.start()].count("\n") + 1) for m in re.finditer(r"^\s*def\s+(\w+)\s*\((.*?)\)", code, re.M)]
    assert got == want and ("f", "a\x01b", 1) in got
