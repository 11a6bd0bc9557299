"""Provider fallback semantics of batch inference."""

import json

import pandas as pd

from sluice.operators import inference as I
from sluice.plans.stubs import stub_providers


def _const(text):
    def factory():
        return lambda s: pd.Series([text] * len(s), index=s.index)
    return factory


def _boom():
    def fn(s):
        raise RuntimeError("down")
    return fn


def _even_only():
    return lambda s: pd.Series([p if len(p) % 2 == 0 else "" for p in s], index=s.index)


def test_first_non_empty_reply_wins(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "ab")], "id long, prompt string")
    out = I.batch_inference(df, [("Broken", _boom), ("Even", lambda: _even_only()), ("Last", _const("z"))])
    got = {r.id: (r.reply, r.provider) for r in out.collect()}
    assert got == {1: ("ab", "Even"), 2: ("z", "Last"), 3: ("ab", "Even")}


def test_no_reply_gives_empty_and_none(spark):
    df = spark.createDataFrame([(1, "x")], "id long, prompt string")
    out = I.batch_inference(df, [("Empty", _const(""))]).first()
    assert (out.reply, out.provider) == ("", "none")


def test_agent_job_outputs(spark):
    reqs = spark.createDataFrame(
        [(1, "s", "debugger", "def f(:\n  pass", "python", "boom", None, None, None),
         (2, "s", "analyzer", None, "python", None, "security", None, None),
         (3, "s", "docs_generator", "x = 1", "python", None, None, "class", "numpy")],
        "request_id long, session_id string, agent_type string, code string, language string, "
        "error_message string, analysis_type string, doc_type string, style string")
    resp, hist, execs = I.agent_job(reqs, stub_providers())
    r = {x.request_id: x for x in resp.collect()}
    assert r[2].success is False and r[2].error == "No code provided"
    assert r[1].success and r[3].success
    assert hist.count() == 2 and execs.count() == 2
    assert {x.task_description for x in execs.collect()} == {
        "Debug python code", "Generate class documentation (numpy style)"}


def test_run_that_raises_leaves_a_failed_row(spark):
    reqs = spark.createDataFrame(
        [(1, "s", "debugger", "x = (1", "python", 'say "no"', None, None, None),
         (2, "s", "analyzer", "x = 1\n", "python", None, None, None, None),
         (3, "s", "docs_generator", "x = 1", None, None, None, None, None)],
        "request_id long, session_id string, agent_type string, code string, language string, "
        "error_message string, analysis_type string, doc_type string, style string")

    def quota():
        def fn(prompts):
            raise I.RunError("no quota")
        return fn

    resp, hist, execs = I.agent_job(reqs, [("Quota", quota), ("Last", _const("z"))])
    assert {x.error for x in resp.collect()} == {"Debugger error: no quota", "Analyzer error: no quota",
                                                 "Docs generator error: no quota"}
    assert hist.count() == 0
    assert {(x.task_description, x.status, x.result, x.error_message, x.tokens_used) for x in execs.collect()} == {
        (t, "failed", None, "no quota", 0) for t in ("Debug code", "Analyze code", "Generate documentation")}

    resp, hist, _ = I.agent_job(reqs, [("Last", _const("z"))])
    meta = {x.agent_type: json.loads(x.metadata_json) for x in hist.collect()}
    settings = {k: v.pop("settings") for k, v in meta.items()}
    assert settings["debugger"] == {"temperature": 0.3, "max_tokens": 2048}
    assert meta["debugger"] == {"language": "python", "error_message": 'say "no"', "syntax_errors_found": 1, "provider": "Last"}
    assert meta["analyzer"] == {
        "language": "python", "analysis_type": "comprehensive", "provider": "Last",
        "quality_metrics": {"total_lines": 2, "non_empty_lines": 1, "comment_lines": 0, "average_line_length": 2.5,
                            "functions": 0, "indentation_issues": 0, "long_lines": 0}}
    assert meta["docs_generator"] == {"language": "unknown", "doc_type": "function", "style": "google", "provider": "Last"}


def _picky(error, bad):
    def factory():
        def fn(s):
            if any(p in bad for p in s):
                raise error("boom")
            return pd.Series([f"ok {p}" for p in s], index=s.index)
        return fn
    return factory


def test_one_bad_prompt_spoils_only_itself(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "id long, prompt string")
    for parts in (1, 7):
        out = I.batch_inference(df, [("Picky", _picky(I.RunError, {"p3"})), ("Last", _const("z"))], max_parallel_calls=parts)
        got = {r.id: (r.reply, r.provider, r.run_error) for r in out.collect()}
        assert got == {i: ("", "none", "boom") if i == 3 else (f"ok p{i}", "Picky", None) for i in range(20)}
        # any other error: the next provider answers that prompt
        out = I.batch_inference(df, [("Picky", _picky(ValueError, {"p3", "p11"})), ("Last", _const("z"))], max_parallel_calls=parts)
        got = {r.id: (r.reply, r.provider, r.run_error) for r in out.collect()}
        assert got == {i: ("z", "Last", None) if i in (3, 11) else (f"ok p{i}", "Picky", None) for i in range(20)}


def test_calls_of_a_halved_batch():
    calls = []

    def fn(s):
        calls.append(len(s))
        if "p5" in set(s):
            raise I.RunError("boom")
        return s

    prompts = pd.Series([f"p{i}" for i in range(64)])
    replies, errors = I.ask(fn, prompts)
    assert errors.dropna().to_dict() == {5: "boom"} and replies.drop(5).tolist() == prompts.drop(5).tolist()
    assert len(calls) == 1 + 2 * 6

    def down(s):
        calls.append(0)
        raise I.ProviderDown

    calls.clear()
    assert I.ask(down, prompts)[0].isna().all() and calls == [0]


REQUEST = ("request_id long, session_id string, agent_type string, code string, language string, "
           "error_message string, analysis_type string, doc_type string, style string")


def test_agent_job_one_failing_prompt(spark):
    reqs = spark.createDataFrame([(i, "s", "debugger", f"x = {i}", "python", "BAD" if i == 2 else None, None, None, None) for i in range(5)], REQUEST)

    def factory():
        def fn(s):
            if s.str.contains("BAD").any():
                raise I.RunError("no quota")
            return pd.Series(["fine"] * len(s), index=s.index)
        return fn

    resp, hist, execs = I.agent_job(reqs, [("One", factory)])
    assert {r.request_id: (r.success, r.error) for r in resp.collect()} == {
        i: (False, "Debugger error: no quota") if i == 2 else (True, None) for i in range(5)}
    assert hist.count() == 4 and sorted(r.status for r in execs.collect()) == ["completed"] * 4 + ["failed"]


def test_fourth_agent_and_own_texts(spark):
    """A registered agent with a prompt function of its own, and section texts from a table."""
    from pyspark.sql import functions as F

    from sluice.operators import prompts as P

    texts = P.Texts(spark.createDataFrame(
        [("analysis", "security", "OWN SECURITY"), ("analysis", None, "OWN DEFAULT"), ("doc", "class", "OWN CLASS"), ("doc", "class", "OWN CLASS, later"),
         ("other", "x", "unused"), (None, "x", "unused")], "kind string, name string, text string"))

    def translate(requests):
        return (requests.withColumn("prompt", F.concat(F.lit("Translate to Go: "), F.col("code")))
                .withColumn("details", F.length("code").cast("string")))

    agents = I.default_agents(texts) | {"translator": I.Agent(
        translate, lambda: F.lit("Translate code"), lambda details: {"chars": details.cast("int")}, (0.1, 99), ("Translate code", "Translator error: "))}
    reqs = spark.createDataFrame(
        [(1, "s", "translator", "x = 1", "python", None, None, None, None), (2, "s", "analyzer", "x = 1", "python", None, "security", None, None),
         (3, "s", "analyzer", "x = 2", "python", None, "unheard of", None, None), (4, "s", "docs_generator", "x = 3", None, None, None, "class", "numpy"),
         (5, "s", "docs_generator", "x = 4", None, None, None, "module", None), (6, "s", "planner", "x = 5", None, None, None, None, None)], REQUEST)
    got = {r.request_id: r.prompt for r in I.agent_prompts(reqs, agents).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1] == "Translate to Go: x = 1"
    assert "OWN SECURITY" in got[2] and "OWN DEFAULT" in got[3]
    assert "OWN CLASS\n" in got[4] and "later" not in got[4] and P.STYLE_SECTIONS["numpy"] in got[4] and "OWN" not in got[5]
    resp, hist, execs = I.agent_job(reqs, [("Last", _const("z"))], agents=agents)
    out = {r.request_id: r for r in resp.collect()}
    assert out[1].success and json.loads(out[1].metadata_json) == {
        "language": "python", "chars": 5, "provider": "Last", "settings": {"temperature": 0.1, "max_tokens": 99}}
    assert out[6].error == "Unknown agent type: planner"
    assert {r.user_message for r in hist.where("agent_type = 'translator'").collect()} == {"Translate code"}

    def quota():
        def fn(prompts):
            raise I.RunError("no quota")
        return fn

    resp, _, execs = I.agent_job(reqs, [("Quota", quota)], agents=agents)
    assert {r.error for r in resp.where("request_id = 1").collect()} == {"Translator error: no quota"}
    assert execs.where("agent_type = 'translator' AND status = 'failed'").count() == 1


def test_own_texts_beyond_the_broadcast_bound_join_by_shuffle(spark, monkeypatch):
    from sluice.operators import prompts as P

    texts = P.Texts(spark.createDataFrame([("doc", "class", "OWN CLASS")], "kind string, name string, text string"))
    reqs = spark.createDataFrame([(4, "s", "docs_generator", "x = 3", None, None, None, "class", "numpy")], REQUEST)
    small = P.docs_prompts(reqs, texts)
    monkeypatch.setattr(P, "BROADCAST_BYTES", 1)
    large = P.docs_prompts(reqs, texts)
    hinted = [d._jdf.queryExecution().analyzed().toString().count("ResolvedHint") for d in (small, large)]
    assert hinted == [1, 0] and small.first().prompt == large.first().prompt and "OWN CLASS" in large.first().prompt


def test_tasks_keep_their_share_as_the_input_grows(spark, tmp_path, monkeypatch):
    """CPU-bound stages get a partition for each ``TASK_BYTES`` of the files, not a fixed number."""
    from sluice import session, views

    path = str(tmp_path / "t")
    spark.range(20000).selectExpr("id", "uuid() AS t").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    held = session.input_bytes(df)
    assert held > 200_000 and session.input_partitions(df) == session.cpu_partitions(spark)
    for module in (session, views):
        monkeypatch.setattr(module, "TASK_BYTES", 10_000)
    parts = -(-held // 10_000)
    assert session.input_partitions(df.where("id > 3").groupBy("t").count()) == parts > session.cpu_partitions(spark)
    assert views.spread(df).rdd.getNumPartitions() == parts
    assert session.input_bytes(spark.createDataFrame([(1,)], "id int")) == 0
