import math
import random
import re

import pytest
import tiktoken  # noqa: F401  the brute-force twin of the last stage
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import langid, mixing, queries, simhash
from sluice.llm.common import words
from sluice.plans.compare import compare

from .helpers import doc_frame, doc_rows, sentence
from .test_dedup import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_oracles(spark, key):
    res = compare(spark, key, SF, queries.QUERIES[key], queries.ORACLES[key])
    assert res["match"] and res["types_match"], res


def test_entry_adds_the_queries():
    import __spark_entry__ as e

    assert set(queries.QUERIES) | {"pipeline"} <= set(e.queries())


def test_stages_on_awkward_rows(spark):
    """Each stage against a plain version of it, on nulls, copies, repeated rows and clashing columns."""
    rows = doc_rows()
    docs = doc_frame(spark, rows)
    stage = dict(corpus_pipeline.STAGES)
    names = docs.columns

    kept = stage["language ID"](spark, docs, SF)
    assert kept.columns == names
    profiles = langid.train(docs)
    least = langid.least_scores(docs, profiles)
    want = [d for d, t, *_ in rows if (f := profiles.classify(t))[0] != "und" and f[1] >= least.get((f[0], int(math.log2(len(t)))), 0)]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, want))

    once = stage["exact dedup"](spark, docs, SF)
    assert once.columns == names
    seen = {}
    for d, t, *_ in rows:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        seen[t] = min((x for x in (d, seen.get(t)) if x is not None), default=None)
    assert sorted(str(r["doc_id"]) for r in once.collect()) == sorted(map(str, seen.values()))

    near = stage["SimHash near-dedup"](spark, docs, SF)
    assert near.columns == names
    group = brute_components([brute_fingerprint(t) for _, t, *_ in rows])
    least = {}
    for i, (d, *_) in enumerate(rows):
        known = [x for x in (d, least.get(group[i])) if x is not None]
        least[group[i]] = min(known, default=None)
    assert sorted(str(r["doc_id"]) for r in near.collect()) == sorted(map(str, least.values()))

    more = stage["mixing"](spark, docs, SF)
    assert more.columns == names
    slim = docs.select("doc_id", "source", words(F.col("text")).alias("n"), F.xxhash64(F.coalesce("text", F.lit(""))).cast("string").alias("ident"))
    by_hand = mixing.mix(queries.quality(slim, spark.read.parquet(f"{SF}/labels.parquet"), "w"), F.col("n"), F.col("w"), text="ident")
    assert more.count() == by_hand.agg(F.sum("mix.copies")).first()[0]

    for _, f in corpus_pipeline.STAGES:
        assert f(spark, doc_frame(spark, []), SF).count() == 0


def test_near_dedup_stage_sends_no_crowd_to_the_driver(spark, monkeypatch):
    rng = random.Random(9)
    body = sentence(rng, 400).split()
    rows = [(i, " ".join(w if rng.random() > 0.004 else w + "q" for w in body), "en", "s") for i in range(40)]
    rows += [(100 + i, sentence(rng, 60), "en", "s") for i in range(5)]
    linked, plans = simhash.crowd_links, []

    def watched(*args):
        out = linked(*args)
        plans.append(out._jdf.queryExecution().toString())
        return out

    monkeypatch.setattr(simhash, "CROWD", 3)
    monkeypatch.setattr(simhash, "crowd_links", watched)
    near = corpus_pipeline.near_duplicates(spark, doc_frame(spark, rows), SF)
    group = brute_components([brute_fingerprint(t) for _, t, *_ in rows])
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({rows[g][0] for g in group.values()})
    assert plans and not any("Broadcast" in p for p in plans)


def test_language_stage_rejects_noise_and_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    noise = ["zxqj kvwq xzjq " * 30, "qqq www zzz xxx jjj " * 20, "ab" * 400, "kjh qwpoeiu zmxncb " * 40, "123 456", "!!!"]
    rows = spark.createDataFrame([(10**9 + i, t, None, "src0", len(t)) for i, t in enumerate(noise)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(rows), SF).select("doc_id").collect()}
    letters = {r["doc_id"] for r in docs.filter(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert not any(d >= 10**9 for d in kept)
    assert kept <= letters and len(kept) >= 0.99 * len(letters)
    short = spark.createDataFrame([(10**9, "the", None, "s", 3), (10**9 + 1, "le la", None, "s", 5)], docs.schema)  # too short to tell: they stay
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(short), SF).select("doc_id").collect()}
    assert {10**9, 10**9 + 1} <= kept


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_language_bounds_come_from_all_labelled_texts(spark, monkeypatch):
    """Profiles and bounds of the language stage see every labelled text, with quantiles as ``percentile`` gives them."""
    import numpy as np

    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} " * (1 + i % 3), "en" if i % 2 else "fr", "s")
            for i in range(1500)]  # more than the bound of a sample
    docs = doc_frame(spark, rows + rows[:40])
    whole = langid.train(docs, per_language=None)
    by_hand = langid.train(docs, per_language=10**9)
    assert whole.languages == by_hand.languages and (whole.grams == by_hand.grams).all() and (whole.rank == by_hand.rank).all()
    scores = {}
    for _, label, text in {(0, lang, t) for _, t, lang, *_ in rows}:
        name, score = whole.classify(text)
        scores.setdefault((name, int(math.log2(len(text)))), []).append(score)
    want = {k: (q := np.percentile(v, [10, 50]))[1] - langid.SPREAD * (q[1] - q[0]) for k, v in scores.items() if len(v) >= langid.LEAST_TEXTS}
    got = langid.least_scores(docs, whole)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    seen = []
    monkeypatch.setattr(langid, "train", lambda d, **told: seen.append(told) or whole)
    corpus_pipeline.language_id(spark, docs, SF)
    assert seen == [{"per_language": None}]


def test_quantiles_match_percentile(spark, monkeypatch):
    import random

    rnd = random.Random(3)
    rows = [(k, rnd.choice([rnd.random(), 0.25, 0.2500001, 0.0, 1.0])) for k in "ab" for _ in range(rnd.randint(40, 90))] + [("c", 0.5)]
    frame = spark.createDataFrame(rows, "k string, v double")
    shares = (0.0, 0.1, 0.5, 1.0)
    for steps in (1, 7, 4096):
        monkeypatch.setattr(langid, "_STEPS", steps)
        got = {(r["k"], r["share"]): r["value"] for r in langid.quantiles(frame, ["k"], "v", shares).collect()}
        plain = frame.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).collect()
        want = {(r["k"], s): v for r in plain for s, v in zip(shares, r["p"])}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
