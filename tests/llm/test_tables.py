import base64
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import ann, mixing, queries, sharding, urls, warc
from sluice.llm.common import words

from .helpers import doc_frame, doc_rows


# -- nearest neighbours --------------------------------------------------------
def exact(vectors, k):
    ids = np.array([i for i, _ in vectors])
    v = np.array([x for _, x in vectors], float)
    out = {}
    for i, q in vectors:
        if i % 20 == 0:
            s = (v * np.array(q, float)).sum(axis=1)
            out[i] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def test_hilbert_neighbours_differ_in_one_cell():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = ann.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_search_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((40, 16)) * 3
    good = [(i, (centers[i % 40] + rng.standard_normal(16)).tolist()) for i in range(3000)]
    good += [(4000 + i, good[20][1]) for i in range(60)]  # many copies of a query's vector: ties go by id
    bad = [(5000, None), (5020, [0.0] * 16), (5040, [None] + [1.0] * 15), (5060, [float("nan")] + [1.0] * 15), (5080, [float("inf")] * 16),
           (None, [1.0] * 16), (5120, [])]
    table = spark.createDataFrame([(i, v, 1.0, 2) for i, v in good + bad], "vec_id long, embedding array<double>, score double, rank int")
    got = defaultdict(list)
    for r in ann.search(table, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = exact(good, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in {i for i, _ in found}
    assert got[20] == want[20]


def test_search_small_and_empty(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (1, [0.5, 0.5])], kind)
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [
        (0, 1, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 2, -1.0)]
    # rows that repeat a query's id are neighbours and queries of their own; other lengths have their own search
    rows = [(i, [float(i), 1.0]) for i in range(1, 40)] + [(20, [3.0, 3.0]), (60, [1.0, 2.0, 3.0]), (61, [3.0, 2.0, 1.0]), (80, [2.0, 2.0, 2.0]), (100, [5.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(spark.createDataFrame(rows, kind), F.col("vec_id") % 20 == 0, k=3).collect())
    want = []
    for n, (i, q) in enumerate(rows):
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(rows) if m != n and len(v) == len(q))[:3]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    assert got == sorted(want) and {x[0] for x in got} == {20, 60, 80}
    assert ann.search(spark.createDataFrame([], kind), F.col("vec_id") % 20 == 0).count() == 0


# -- urls -----------------------------------------------------------------------
def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
    path = tail[:min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def test_url_rules(spark):
    made = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://a.www.example.com/en/1", "http://net/es/", "http://x.net/ES/",
            "http://x.net/fr/a?b#c", "http://notexample.com/en/", "http://x.com", "http://x.com?q=/", "http://x.org#/a://b/", "a\nb://c.net/es/x", "://com/", "http://é.com/", "http://x.net/es/" + "y" * 100_000]
    rows = [(i, u, None, "h", "v") for i, u in enumerate(made * 2)] + [(None, made[4], "", "h", "v")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string"), queries.URL_RULES).collect()
    assert len(got) == len(rows)
    want = {(i, *plain_rule(u)) for i, u, *_ in rows}
    assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in got} == want
    assert all(r["verdict"] in ("allow", "block") for r in got)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


def plain_tokens(url):
    """Tokens of a whole url by its parts."""
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return frozenset()
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, _, path = rest.partition("/")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    folders, _, name = ("/" * ("/" in rest) + path).rpartition("/")

    def words(text):
        return re.findall(r"[^\W_]+", text)

    pairs = [x.partition("=") for x in re.split("[&;]", query)]
    out = ["h:" + x for x in host.split(".")] + ["p:" + x for x in words(folders)] + ["n:" + x for x in words(name)]
    out += ["q:" + k for k, _, _ in pairs] + ["v:" + x for _, _, v in pairs for x in words(v)] + ["f:" + x for x in words(fragment)]
    return frozenset(x for x in out if len(x) > 2)


def plain_rules(listed, support, confidence):
    """Every combination that rows have, pruned against all its proper subsets; in order of precedence."""
    least = support * len(listed)
    single = Counter(x for t, _ in listed for x in t)
    total, said = Counter(), Counter()
    for t, v in listed:
        s = sorted(x for x in t if single[x] >= least)
        for k in range(1, len(s) + 1):
            for c in itertools.combinations(s, k):
                total[c] += 1
                said[c, v] += 1
    rules = {(c, v): (n / total[c], n) for (c, v), n in said.items() if n >= least and n / total[c] >= confidence}
    kept = {}
    for (c, v), (share, n) in rules.items():
        smaller = (d for k in range(1, len(c)) for d in itertools.combinations(c, k))
        if not any(rules.get((d, v), (0, 0))[0] >= share for d in smaller):
            kept[c, v] = (share, n)
    return kept, sorted(kept, key=lambda k: (-kept[k][0], -kept[k][1], " ".join(k[0]), k[1]))


def test_tokens_of_whole_urls(spark):
    made = [None, "", "none", "http://x.com/casino-bonus.html", "http://X.com", "http://x.com/free-slots", "http://x.com/es", "https://a.b.c/one/two_three/p%20q.php?k=v w&lang=es;x&=7#top-2",
            "http://x.com?casino=1", "http://x.com#/a://b/", "http://é.com/né/ß?ü=ö", "http://h//a//"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(made)], "i int, url string").select("i", urls.tokens(F.col("url")).alias("t")).collect()
    assert {r["i"]: frozenset(r["t"]) for r in rows} == {i: plain_tokens(u) for i, u in enumerate(made)}
    assert plain_tokens(made[3]) == {"h:x", "h:com", "n:casino", "n:bonus", "n:html"}


def test_association_rules_match_brute_force(spark):
    """Rules of every size over the whole url, and the verdicts they give."""
    got = {r["page_id"]: r for r in queries.op3_url_filter(spark, "/root/testdata/sf0.1").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").collect()
    seen = {r["page_id"]: (plain_tokens(r["url"]), plain_rule(r["url"])[-1]) for r in pages}
    listed = [(t, v) for t, v in seen.values() if v]
    _, order = plain_rules(listed, urls.LEAST_SUPPORT, urls.LEAST_CONFIDENCE)
    alike = defaultdict(list)  # tokens of the same rows stand for each other
    for x in {x for t, _ in listed for x in t}:
        alike[frozenset(i for i, (t, _) in enumerate(listed) if x in t)].append(x)
    same = {x: c for c in alike.values() for x in c}
    for page, (tokens, verdict) in seen.items():
        want = verdict or next((v for c, v in order if all(not tokens.isdisjoint(same[x]) for x in c)), "allow")
        assert got[page]["verdict"] == want, page
    assert any(r["rule"] is None and r["verdict"] == "block" for r in got.values())


def test_rules_are_learned_from_page_names_and_queries(spark):
    """What only the page name or the query tells reaches urls that no listed rule fits."""
    made = [f"http://shop{i}.com/a/{i}-casino.html" for i in range(30)] + [f"http://s{i}.com/b/{i}.php?lang=xx" for i in range(30)]
    made += [f"http://plain{i}.com/c/{i}.html" for i in range(60)]
    listed = [("allow", "com", "/c/"), ("block", "com", "/a/"), ("block", "com", "/b/")]
    fresh = ["http://new.org/99-casino.html", "http://new.org/x/y.php?lang=xx", "http://new.org/x/y.php?lang=yy", "http://new.org/c/1.htm"]
    rows = spark.createDataFrame(list(enumerate(made + fresh)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(rows, listed).collect()}
    assert [got[len(made) + i] for i in range(4)] == ["block", "block", "block", "allow"]


def test_many_independent_tokens(spark):
    """Combinations of 12 independent tokens: k rows for a set of k, not 2^k; the same rules as by brute force."""
    rng = random.Random(6)
    rows = [(sorted(f"t{i:02}" for i in range(12) if rng.random() < 0.5), rng.choice(("allow", "block"))) for _ in range(300)]
    got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.6).collect()
    kept, _ = plain_rules([(frozenset(t), v) for t, v in rows], 0.05, 0.6)
    assert {(tuple(r["tokens"]), r["verdict"]): (r["confidence"], r["support_count"]) for r in got} == kept and kept


def test_rules_of_three_and_more_tokens_match_brute_force(spark):
    made = [("h:www h:foo h:net p:es", "block"), ("h:m h:foo h:com p:es", "allow"), ("h:www h:bar h:com p:es", "allow"), ("h:www h:foo h:com p:de", "allow")]
    rng = random.Random(2)
    some = [(" ".join(["a", "twin"] * rng.randint(0, 1) + rng.sample("bcdef", rng.randint(0, 5))), rng.choice(("allow", "block"))) for _ in range(60)]
    wide = [(" ".join(f"t{i}" for i in range(60)), "block")] * 9  # one much repeated url
    for listed in ([(t, v) for t, v in made for _ in range(5)], some, wide):
        rows = [(sorted(set(t.split())), v) for t, v in listed]
        got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.8).collect()
        got = {(frozenset(r["tokens"]), r["verdict"]): (r["confidence"], r["support_count"]) for r in got}
        if listed is wide:
            assert got == {(frozenset([f"t{i}"]), "block"): (1.0, 9) for i in range(60)}
            continue
        total, said = defaultdict(int), defaultdict(int)
        for t, v in rows:
            for k in range(1, 1 << len(t)):
                c = frozenset(x for i, x in enumerate(t) if k >> i & 1)
                total[c] += 1
                said[c, v] += 1
        rules = {(c, v): (n / total[c], n) for (c, v), n in said.items() if n >= 0.05 * len(rows) and n / total[c] >= 0.8}
        assert got == {(c, v): x for (c, v), x in rules.items() if not any(d < c and w == v and y[0] >= x[0] for (d, w), y in rules.items())}
        if listed[0][0] == made[0][0]:
            assert (frozenset(("h:www", "h:foo", "p:es")), "block") in got


def test_url_filter_runs_no_python(spark):
    plan = queries.op3_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- warc -----------------------------------------------------------------------
def pages(spark):
    rng = random.Random(8)
    big = "".join(rng.choice("abcdef é\r\n") for _ in range(70_000))
    rows = [(3, "http://a/", big), (1, "http://b/ x\r\n", big), (2, None, None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n"), (6, "u", "é"), (6, "u", "é"), (None, "n", "é"), (None, None, None)]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record_type string, last int")


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, tmp_path, least):
    rows, frame = pages(spark)
    archives = warc.write(frame, str(tmp_path / "w"), least=least, chunk=1000)
    assert sum(r["records"] for r in archives.collect()) == len(rows)
    assert {Path(r["archive"]).name for r in archives.collect()} == {p.name for p in (tmp_path / "w").iterdir()}
    got = warc.read_chunks(archives).orderBy("record_id", "chunk_no").collect()
    bodies, ends = defaultdict(bytes), {}
    for r in got:
        bodies[r["record_id"]] += r["data"] or b""
        assert len(r["data"] or b"") <= warc.CHUNK
        if r["last"]:
            ends[r["record_id"]] = r
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    assert len(ends) == len(rows)
    for k, r in ends.items():
        digest = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): h for h in groups}
        h = digest[r["payload_digest"]]
        assert r["payload_bytes"] == len(h.encode())
        if r["record_type"] == "response":
            assert bodies[k] == h.encode()
        else:
            assert len(h.encode()) >= least and r["refers_to"] == min(i for i in groups[h] if i is not None) and not bodies[k]
    for h, ids in groups.items():
        kinds = [r["record_type"] for r in ends.values() if digest[r["payload_digest"]] == h]
        assert kinds.count("response") == (1 if len(h.encode()) >= least else len(ids))


def test_warc_empty_and_damaged(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty, str(tmp_path / "e")).count() == 0
    _, frame = pages(spark)
    archives = warc.write(frame, str(tmp_path / "d"), archives=1)
    name = archives.first()["archive"]
    data = Path(name).read_bytes()
    Path(name).write_bytes(data[:len(data) // 2])
    with pytest.raises(Exception, match="archive ends inside"):
        warc.read_chunks(archives).count()


# -- sharding ---------------------------------------------------------------------
def test_pack_follows_the_dot_product():
    rng = np.random.default_rng(0)
    items = rng.lognormal(size=(400, 3))
    placed = sharding.pack(items, 8)
    loads = np.stack([np.bincount(placed, items[:, j], 8) for j in range(3)], axis=1) / items.sum(axis=0) * 8
    assert np.abs(loads - 1).max() < 0.05
    assert sharding.pack(np.ones((8, 3)), 8).tolist() == list(range(8))


def check_shards(rows, got, shards=8):
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), len((t or "").encode()) + 1) for d, t in rows)
    for s in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert {r["shard"] for r in got} <= set(range(shards))


def test_sharding_is_balanced(spark):
    got = queries.op7_sharding(spark, "/root/testdata/sf0.1").collect()
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    check_shards([tuple(r) for r in docs], got)
    loads = np.bincount([r["shard"] for r in got], [r["size"] for r in got], 8)
    counts = np.bincount([r["shard"] for r in got], minlength=8)
    assert loads.max() / loads.min() < 1.01 and counts.max() / counts.min() < 1.05
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert np.mean([len(s) == 1 for s in where.values()]) > 0.99


def test_sharding_edges(spark):
    rows = doc_rows()
    got = sharding.shard(doc_frame(spark, rows)).collect()
    check_shards([r[:2] for r in rows], got)
    hot = [(i, "same text here", "en", "s") for i in range(3000)] + [(9000 + i, f"other {i}", "en", "s") for i in range(3000)]
    got = sharding.shard(doc_frame(spark, hot)).collect()  # one group with half of all rows is dealt in pieces
    check_shards([r[:2] for r in hot], got)
    loads = np.bincount([r["shard"] for r in got], [r["size"] for r in got], 8)
    assert loads.max() / loads.min() < 1.1
    assert sharding.shard(doc_frame(spark, [])).count() == 0


def plain_pack(items, shards):
    """Largest share first, into the fitting shard of the highest dot product; plain lists."""
    total = [max(sum(x), 1) for x in zip(*items)]
    left = [[1 / shards] * len(total) for _ in range(shards)]
    out = [None] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-max(x / t for x, t in zip(items[i], total)), i)):
        share = [x / t for x, t in zip(items[i], total)]
        fits = [s for s in range(shards) if all(a >= b - 1e-12 for a, b in zip(left[s], share))] or range(shards)
        out[i] = max(fits, key=lambda s: (round(sum(a * b for a, b in zip(left[s], share)), 15), -s))
        left[out[i]] = [a - b for a, b in zip(left[out[i]], share)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pack_matches_a_plain_packer(seed):
    rng = np.random.default_rng(seed)
    items = np.stack([rng.integers(1, 10_000, 300), rng.integers(0, 900, 300), rng.integers(1, 40, 300)], axis=1).astype(float)
    got = sharding.pack(items, 8)
    assert got.tolist() == plain_pack(items.tolist(), 8)
    loads = np.stack([np.bincount(got, items[:, j], 8) for j in range(3)])
    assert (loads.max(axis=1) / loads.min(axis=1) < 1.1).all()


def test_repeated_rows_are_spread_over_shards(spark):
    """A third of the rows is one row again and again."""
    rows = [(7, "abcde", "en", "s")] * 1000 + [(i, f"w{i} some more", "en", "s") for i in range(10, 2010)] + [(None, None, None, None)] * 60
    got = sharding.shard(doc_frame(spark, rows)).collect()
    check_shards([r[:2] for r in rows], got)
    loads = np.bincount([r["shard"] for r in got], [r["size"] for r in got], 8)
    counts = np.bincount([r["shard"] for r in got], minlength=8)
    assert loads.max() / loads.min() < 1.1 and counts.max() / counts.min() < 1.15


# -- mixing -----------------------------------------------------------------------
def test_targets():
    assert mixing.targets({}) == {}
    even = mixing.targets({"a": 100, "b": 100, None: 100})
    assert even == {"a": 200.0, "b": pytest.approx(500 / 3), None: pytest.approx(250 / 3)} or sum(even.values()) == pytest.approx(450)
    got = mixing.targets({"a": 10, "b": 1000, "c": 0})
    assert got["a"] == 20 and got["c"] == 0 and got["b"] == pytest.approx(1515 - 20)


def plain_mix(rows, cut_bits=48):
    """taken by (source) with the same keys, sorted in one list."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    goal = mixing.targets({s: sum(r["n"] for r in x) for s, x in by.items()})
    out = []
    for s, found in by.items():
        total = sum(r["n"] for r in found)
        epochs = int(goal[s] // total) if total else 0
        budget, upto, best = goal[s] - epochs * total, 0, None
        ties = defaultdict(int)
        for r in found:
            ties[r["key"], r["tie"]] += r["n"]
        if budget > 0:
            for k in sorted(ties):
                upto += ties[k]
                if upto - ties[k] / 2 <= budget:
                    best = k
        out += [(r["doc_id"], r["n"], total, goal[s], r["n"] * (epochs + (best is not None and (r["key"], r["tie"]) <= best))) for r in found]
    return out


@pytest.mark.parametrize("sorted_rows", [50_000, 5])
def test_mix_matches_a_plain_prefix_sum(spark, monkeypatch, sorted_rows):
    monkeypatch.setattr(mixing, "SORTED", sorted_rows)  # 5: the histogram is narrowed digit by digit
    once = list(dict.fromkeys(doc_rows()))  # repeated rows have draws of their own, see below
    docs = doc_frame(spark, once).withColumn("w", F.when(F.col("doc_id") % 3 == 0, 2.0).otherwise(1.0))
    n = words(F.col("text"))
    key, tie = mixing.key(F.col("doc_id"), F.col("text"), F.col("w"))
    want = plain_mix(docs.select("doc_id", F.col("source"), n.alias("n"), key.alias("key"), tie.alias("tie")).collect())
    out = mixing.mix(docs, n, F.col("w"))
    got = [tuple(r) for r in out.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert out.columns == [*docs.columns, "mix"]


def test_mix_nears_its_targets_and_repeats(spark):
    runs = [sorted(tuple(r) for r in queries.op9_mixing(spark, "/root/testdata/sf0.1").collect()) for _ in range(2)]
    assert runs[0] == runs[1]
    docs = {r["doc_id"]: r["source"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source").collect()}
    taken, goal, most = defaultdict(int), {}, defaultdict(int)
    for d, size, _, target, got in runs[0]:
        assert got <= 2 * size
        taken[docs[d]] += got
        goal[docs[d]] = target
        most[docs[d]] = max(most[docs[d]], size)
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in goal)


def test_mix_of_repeated_rows_nears_its_targets(spark):
    """A source of 300 equal rows, beside distinct rows; and the awkward rows, twice each."""
    rows = [(5, "a b c", "en", "s0")] * 300 + [(i, "a b c", "en", "s1") for i in range(100, 500)] + [(i, "a b c", "en", "s2") for i in range(1000, 1300)]
    for made in (rows, doc_rows() * 2):
        docs = doc_frame(spark, made).withColumn("mix", F.lit("a name that clashes"))
        runs = [[tuple(r) for r in mixing.mix(docs, words(F.col("text")), F.lit(1.0)).select(
            "doc_id", "source", "mix.size", "mix.target", "mix.taken").collect()] for _ in range(2)]
        assert sorted(runs[0], key=str) == sorted(runs[1], key=str) and len(runs[0]) == len(made)
        for s in {r[1] for r in runs[0]}:
            own = [r for r in runs[0] if r[1] == s]
            assert abs(sum(r[4] for r in own) - own[0][3]) <= max(r[2] for r in own), s
            assert all(r[4] <= 2 * r[2] for r in own)


def test_mix_prefers_quality(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 3).cast("string").alias("source"),
                                    F.when(F.col("id") % 4 < 2, 4.0).otherwise(0.5).alias("w"))
    got = mixing.mix(docs, F.lit(3).cast("long"), F.col("w")).filter("source = '1'").groupBy("w").agg(F.sum("mix.taken").alias("n")).collect()
    by = {r["w"]: r["n"] for r in got}
    assert by[4.0] > by[0.5]


def test_mix_empty(spark):
    assert mixing.mix(doc_frame(spark, []), F.lit(1).cast("long"), F.lit(1.0)).count() == 0
