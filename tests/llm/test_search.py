"""Lexical search, document digests and hard negatives against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import digest, lexical, negatives

from .helpers import doc_frame, doc_rows, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# -- lexical search ------------------------------------------------------------
def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranked(docs, items, k):
    """Every item against every document, straight from the formula."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    N, L = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items.items():
        scores = []
        for d, c, n in counts:
            m = 25 + (75 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def test_terms_of_awkward_texts(monkeypatch):
    monkeypatch.setattr(lexical, "_PIECE", 5)
    for text in ("", "Über-ALLES 12a_b", "x", "  ", "aaaaaaaaaaaaaaaaaaaaa b ccccccc", "日本語 テキスト,AéB" * 9):
        assert lexical.count_text(text.encode()) == Counter(t.encode() for t in terms(text))


@pytest.mark.parametrize("seed", range(6))
def test_walk_finds_the_best(seed):
    """Skipping loses nothing, ties included, and reads less than everything."""
    rng = np.random.default_rng(seed)
    n = 3000
    lists, dense = [], np.zeros(n, np.int64)
    for i in range(8):
        docs = np.flatnonzero(rng.random(n) < (0.6, 0.01)[i % 2])
        values, weight = rng.integers(1, 20, len(docs)), int((1, 400)[i % 2])
        lists.append((docs, values, weight))
        dense[docs] += values * weight
    ids, unknown = rng.permutation(n), np.zeros(n, bool)
    best = lexical._Best(10, int(np.sort(dense)[-10]) if seed % 2 else 0, ids, unknown)
    read = lexical.walk(lists, n, best, window=64)
    want = np.lexsort((ids, -dense))[:10]
    assert best.docs.tolist() == want.tolist() and best.scores.tolist() == dense[want].tolist()
    assert read < sum(len(d) for d, *_ in lists)


@pytest.mark.parametrize("short", [0, 4, 1_000_000])
def test_search_matches_brute_force(spark, short, monkeypatch):
    """Only long lists, both kinds, only short ones: the same ranking."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 20)
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", 2)
    rng = random.Random(3)
    rows = doc_rows()
    asked = [(1, rows[0][1]), (2, "alphaa alphaa betab zzz"), (3, None), (4, ""), (None, "alphaa"), (5, "unseen words"), (6, sentence(rng, 300)),
             (7, "gammac"), (7, "deltad gammac"), (8, rows[5][1])]
    items = {}
    for i, t in asked:
        if i is not None:
            items[i] = f"{items.get(i, '')} {t or ''}"
    docs = doc_frame(spark, rows)
    table = spark.createDataFrame([(i, t, 1.0, 2, "x") for i, t in asked], "item_id long, text string, score double, rank int, value string")
    got = sorted([tuple(r) for r in lexical.search(docs, table, k=10, short=short).select("item_id", "rank", "doc_id", "score").collect()], key=str)
    assert got == ranked([(r[0], r[1]) for r in rows], items, 10)


def test_search_empty_tables(spark):
    none, item = doc_frame(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, item).count() == 0
    assert lexical.search(doc_frame(spark, doc_rows()[:3]), item.limit(0)).count() == 0


# -- digests -------------------------------------------------------------------
def plain_steps(text):
    out = []
    for i in range(len(text) - digest.WINDOW + 1):
        counts = Counter(text[i:i + digest.WINDOW])
        lost = sum(round(c * math.log2(c) * (1 << 16)) for c in counts.values())
        top = round(digest.WINDOW * math.log2(digest.WINDOW) * (1 << 16))
        out.append(int((top - lost) * (digest.STEPS / top)))
    return out


def plain_features(text, ranks):
    """First bytes of the features of one text, by the rule itself."""
    rank = [int(ranks[s]) for s in plain_steps(text)]
    votes = Counter(min(range(i, i + digest.RUN), key=lambda j: (rank[j], j)) for i in range(len(rank) - digest.RUN + 1))
    steps = plain_steps(text)
    found = sorted(i for i, v in votes.items() if v >= digest.VOTES and steps[i] >= digest.WEAK)
    return found or ([min(range(len(rank)), key=lambda j: (rank[j], j))] if rank else [])


def test_features_match_the_rule(monkeypatch):
    monkeypatch.setattr(digest, "_SEGMENT", 100)
    monkeypatch.setattr(digest, "_PIECE", 128)
    rng = random.Random(1)
    texts = [sentence(rng, n).encode() for n in (0, 1, 4, 5, 8, 60, 300)] + [b"a" * 500, b"ab" * 40, "é".encode() * 90, bytes(32), b"x" * 31]
    ranks = np.random.default_rng(2).permutation(digest.STEPS + 1)
    x, ends = digest._joined(texts)
    owner, at = digest.select(x, ends, ranks)
    for i, t in enumerate(texts):
        begin = int(ends[i]) - len(t)
        assert [int(a) - begin for a in at[owner == i]] == plain_features(t, ranks)
    one_by_one = [digest.digests([t], ranks)[0].text() for t in texts]
    assert one_by_one == [d.text() for d in digest.digests(texts, ranks)]


def test_fingerprints_on_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(digest, "BUCKET_BYTES", 40_000)
    rows = doc_rows()
    got = digest.fingerprints(doc_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_print = {}
    for r in got:
        by_print.setdefault((r["doc_id"], r["n_chars"]), r["fingerprint"])
    texts = {(d, len(t or "")): t or "" for d, t, *_ in rows}
    prints = {}
    for key, f in by_print.items():
        assert prints.setdefault(texts[key], f) == f  # equal texts, equal prints
    assert prints[""] == ""
    # known ids in descending order, unique here but for one repeated row, which follows itself
    known = sorted([(d, t or "") for d, t, *_ in rows if d is not None], reverse=True)
    edits = {}
    for (d, t), (_, following) in zip(known, known[1:]):
        edits.setdefault(d, set()).add(hashlib.sha256(digest._edit(t, following).encode()).hexdigest())
    for r in got:
        if r["doc_id"] in edits:
            assert r["edited_sha256"] in edits[r["doc_id"]]
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            assert digest.likeness(digest.parse(r["fingerprint"]), digest.parse(r["edited_fingerprint"])) == r["near_edited"]
    last = [r for r in got if r["doc_id"] is None and r["n_chars"]]
    assert last and digest.fingerprints(doc_frame(spark, [])).count() == 0
    alone = digest.fingerprints(doc_frame(spark, rows[:1])).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(digest._edit(rows[0][1], rows[0][1]).encode()).hexdigest()


def test_likeness_tells_edits_from_others():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 3000))) for _ in range(60)]
    ranks = np.random.default_rng(1).permutation(digest.STEPS + 1)
    own = digest.digests([t.encode() for t in texts], ranks)
    edited = digest.digests([digest._edit(t, u).encode() for t, u in zip(texts, texts[1:] + texts[:1])], ranks)
    near = [digest.likeness(a, b) for a, b in zip(own, edited)]
    other = [digest.likeness(a, b) for a, b in zip(own, own[1:] + own[:1])]
    assert min(near) > 0.25 and max(other) < 0.15
    assert all(digest.likeness(a, b) == digest.likeness(b, a) for a, b in zip(own, edited))
    assert digest.likeness(own[0], own[0]) == 1 and digest.likeness(own[0], digest.digests([b""], ranks)[0]) == 0


# -- hard negatives --------------------------------------------------------------
@pytest.mark.parametrize("size, d", [(300, 64), (10, 3000), (100_000, 7), (2**29, 3), (1, 0)])
def test_residue_product_is_exact(size, d):
    rng = np.random.default_rng(d)
    a, b = rng.integers(-size, size + 1, (5, d)), rng.integers(-size, size + 1, (9, d))
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    bound = max([sum(int(x) ** 2 for x in r) for r in [*a, *b]] or [0])
    moduli = negatives.primes(2 * bound + 1)
    assert math.prod(moduli) > 2 * bound and all(p < 256 for p in moduli)
    assert negatives.residue_product(a, b, moduli).tolist() == want


def mined(rows, positives=5, negatives_=3):
    """Every anchor against every row, straight from the contract."""
    part = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for j, (i, lab, v) in enumerate(part):
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), o, k) for k, (o, _, w) in enumerate(part) if k != j and len(w) == len(v))
        for s, p, _ in [x for x in scored if part[x[2]][1] == lab][:positives]:
            fits = [x for x in scored if part[x[2]][1] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives_]
            out += [(i, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return sorted(out)


def test_mine_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 100)
    monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", 4)
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 3), rng.standard_normal(6).tolist()) for i in range(400)]
    rows += [(1000 + i, 1, rows[50][2]) for i in range(20)] + [(2000 + i, 2, rows[50][2]) for i in range(20)]  # ties
    rows += [(50, 0, rows[50][2]), (50, 1, rows[3][2])]  # an anchor's id again
    rows += [(3000, 1, [1.0, 2.0]), (3050, 1, [2.0, 2.0]), (3051, 2, [1.0, 0.9]), (3100, 1, [])]  # other lengths
    rows += [(3150, None, [1.0] * 6), (None, 1, [1.0] * 6), (3200, 1, None), (3250, 1, [None] + [1.0] * 5), (3300, 2, [float("nan")] * 6), (3350, 2, [float("inf")] * 6),
             (3400, 1, [0.0] * 6)]
    table = spark.createDataFrame([(i, v, lab, 1, "x", 2) for i, lab, v in rows], "vec_id long, embedding array<double>, label int, row int, block string, rank int")
    got = sorted(tuple(r) for r in negatives.mine(table, F.col("vec_id") % 50 == 0).collect())
    assert got == mined(rows) and got
    assert negatives.mine(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
