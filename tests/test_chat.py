"""Chat rules on edge messages."""

import re

from sluice.operators import chat as C


def _py_fence(text):
    if "```" not in text:
        return None, None
    m = re.search(r"```(\w+)?\n(.*?)\n```", text, re.DOTALL)
    return (m.group(2), m.group(1) or "unknown") if m else (None, None)


def _py_error(text):
    return text.split("error:")[-1].strip() if "error:" in text.lower() else None


MESSAGES = [
    "no fence here",
    "```python\nprint(1)\n```",
    "two\n```js\na\n```\n```py\nb\n```",
    "```\nbare\n```",
    "```\n\n```",
    "fix this error: boom  ",
    "Error: only capital",
    "error: one error: two\t",
    "```python\nunterminated",
    "DEBUG ｆｕｌｌ ｗｉｄｔｈ ```x\nÿ\n```",
]


def test_fence_and_error_match_python(spark):
    df = spark.createDataFrame([(i, "s", m) for i, m in enumerate(MESSAGES)],
                               "message_id long, session_id string, content string")
    rows = {r.message_id: r for r in C.extract_fence(df).collect()}
    errs = {r.message_id: r.e for r in df.select("message_id", C.error_message(df.content).alias("e")).collect()}
    for i, m in enumerate(MESSAGES):
        assert (rows[i].code, rows[i].language) == _py_fence(m), m
        assert errs[i] == _py_error(m), m


def test_routing_precedence(spark):
    texts = ["please review and fix", "document the api", "run multiple tasks", "hello", "rapid"]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    got = [r.i for r in df.select(C.route_intent(df.content).alias("i")).collect()]
    assert got == ["debug", "docs", "orchestrate", "menu", "menu"]
    got = [r.d for r in df.select(C.doc_type(df.content).alias("d")).collect()]
    assert got[4] == "api"      # substring rule: "rapid" means api
