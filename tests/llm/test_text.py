import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import bpe, langid, queries, toxicity
from sluice.llm.common import held_out

from .helpers import doc_frame, doc_rows

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.01"


def reference_encoding():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.codec(PATH, PATTERN).rank, special_tokens={})


def test_tree_encoding_equals_tiktoken(monkeypatch):
    own, other = bpe.Codec(PATH, PATTERN), reference_encoding()
    rng = random.Random(3)
    parts = ["a", " ", "  ", "\n", "'s", "'", "re", "'re", "é", "ñ", "1", "12", "!!", "\t", "the", "ing", "漢", "🙂", "zz", " \n ", "<|endoftext|>"]
    for leaf in (4, 5, 17, 64):
        monkeypatch.setattr(bpe, "LEAF_CHARS", leaf)
        for _ in range(500):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 90)))
            assert own.encode(text) == other.encode_ordinary(text)
            assert own.decode(own.encode(text)) == text.encode()
    for n in (47, 48, 49, 5000):  # long pieces, through the tree of byte runs
        for text in ("a" * n, " " * n + "x", "ab" * n, "é" * n, "🙂" * n, "".join(rng.choice("abcdehlot") for _ in range(n))):
            assert own.encode(text) == other.encode_ordinary(text)


def test_encode_documents(spark):
    rows = doc_rows()
    got = sorted((tuple(r) for r in queries.encode_documents(doc_frame(spark, rows)).collect()), key=str)
    other, want = reference_encoding(), []
    for d, t, *_ in rows:
        ids = other.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert queries.encode_documents(doc_frame(spark, [])).count() == 0
    parted = doc_frame(spark, rows).select("text", bpe.encode(F.col("text"), PATH, PATTERN).alias("ids")).select("text", bpe.decode(F.col("ids"), PATH, PATTERN).alias("back"))
    assert all((r["text"] or "").encode() == bytes(r["back"]) for r in parted.collect())


def test_grams_are_counted_over_blocks(monkeypatch):
    text = "Déjà vu, 12 foo-bar  baz! " * 50 + "x"
    want = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        want.update(ord(c) for c in word)
        want.update((ord(a) << 21) | ord(b) for a, b in zip(padded, padded[1:]))
        want.update((ord(a) << 42) | (ord(b) << 21) | ord(c) for a, b, c in zip(padded, padded[1:], padded[2:]))
    for block in (3, 7, 1 << 18):
        monkeypatch.setattr(langid, "_BLOCK", block)
        codes, counts = langid.count_grams(text)
        assert dict(zip(codes.tolist(), counts.tolist())) == want
    assert langid.ranked(text, 5).tolist() == [g for g, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:5]]


def test_out_of_place_distance_matches_a_plain_one():
    texts = {"a": "the cat and the dog and the bird " * 3, "b": "der hund und die katze und der vogel " * 3}
    size = 50
    ranks = {k: langid.ranked(t, size).tolist() for k, t in texts.items()}
    import numpy as np

    grams = np.array(sorted({g for r in ranks.values() for g in r}), np.int64)
    table = np.array([[ranks[k].index(g) if g in ranks[k] else size for k in sorted(texts)] for g in grams.tolist()])
    profiles = langid.Profiles(tuple(sorted(texts)), grams, table, size)
    for text in ("the dog", "und der hund", "zzz", "a b c the"):
        own = langid.ranked(text, size).tolist()
        far = {k: sum(abs(ranks[k].index(g) - i) if g in ranks[k] else size for i, g in enumerate(own)) for k in texts}
        best = min(sorted(far), key=far.get)
        assert profiles.classify(text) == (best, 1 - far[best] / (size * len(own)))
    assert profiles.classify(None) == profiles.classify("") == profiles.classify(" 12 !") == ("und", 0.0)


def test_language_accuracy_on_held_out_documents(spark):
    found = queries.op6_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "lang")
    right = found.join(docs, found["doc_id"] == docs["id"]).filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    assert found.filter("score < 0 or score > 1").isEmpty()


def test_language_edge_rows(spark):
    docs = doc_frame(spark, doc_rows())
    profiles = langid.train(docs)
    got = {r["doc_id"]: r["f"] for r in docs.select("doc_id", langid.identify(F.col("text"), profiles).alias("f")).collect()}
    assert got[101]["lang"] == got[110]["lang"] == "und" and got[107]["lang"] == "en"
    none = langid.train(doc_frame(spark, []))
    assert none.classify("abc") == ("und", 0.0)


def test_copies_of_a_text_do_not_thin_the_profile(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(80)) for _ in range(200)]
    once = spark.createDataFrame([(t, "xx") for t in texts] + [("zq zq", "xx")], "text string, lang string")
    copied = once.unionAll(spark.range(20_000).select(F.lit("zq zq").alias("text"), F.lit("xx").alias("lang")))
    got, want = langid.train(copied, per_language=1000), langid.train(once, per_language=1000)
    counts = Counter()
    for t in [*texts, "zq zq"]:
        codes, n = langid.count_grams(t)
        counts.update(dict(zip(codes.tolist(), n.tolist())))
    plain = sorted(counts, key=lambda g: (-counts[g], g))[:langid.PROFILE_SIZE]
    for p in (got, want):
        assert p.languages == ("xx",) and [g for _, g in sorted(zip(p.rank[:, 0].tolist(), p.grams.tolist()))] == plain


def test_short_documents_of_a_large_alphabet_are_kept(spark):
    rng = random.Random(10)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    rows = [(i, "".join(rng.choices(letters, weights, k=rng.choice((5, 20, 100, 200)))), "zh") for i in range(300)]
    rows += [(1000, "12 !", "zh"), (1001, None, "zh"), (1002, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(300))


def test_held_out_rule(spark):
    got = spark.range(50).select("id", held_out(F.col("id"), 3, 1).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)


def test_folding():
    assert toxicity.fold("St0pid, ІDІОТ! l@ser é\u0301 x\u200by") == " stopid idiot laser e xy "
    assert toxicity.fold("") == "  "


def naive_hits(lexicon, folded):
    words = folded.split()
    out = []
    for i, w in enumerate(words):
        stems = [s for s, _ in lexicon.stems if w.startswith(s)]
        around = {" ".join(words[max(0, i - 1):i + 1]), " ".join(words[i:i + 2])}
        if stems and not around & set(lexicon.exceptions):
            out.append(max(stems, key=len))
    return out


def test_automaton_matches_a_plain_search():
    lexicon = toxicity.Lexicon((("idiot", 2.0), ("scum", 1.0), ("scumbag", 3.0), ("clown", 1.0)), ("clown fish", "no scum"), (1.0, 0.0, 0.0))
    rng = random.Random(4)
    words = ["idiot", "1diots", "scum", "scumbags", "no", "fish", "clown", "the", "ascum", "clowns"]
    for _ in range(300):
        folded = toxicity.fold(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))))
        assert [s for _, s in lexicon.hits(folded)] == naive_hits(lexicon, folded)
    assert lexicon.score(None) == lexicon.score("") == lexicon.score("the no fish") == 0.0
    assert lexicon.score("idiot " * 100_000) <= 1


def test_lexicon_learns_stems_and_exceptions(spark):
    rng = random.Random(6)
    def text(extra):
        w = [rng.choice("lorem ipsum dolor sit amet elit sed quia".split()) + rng.choice("abcdefgh") for _ in range(60)]
        for e in extra:
            w.insert(rng.randrange(len(w)), e)
        return " ".join(w)
    rows = [(i, text(["vilefoo", "vilebar"]), 1) for i in range(150)] + [(1000 + i, text(["vilefoo fish"] if i % 3 == 0 else []), 0) for i in range(300)]
    rows += [(5000, None, 1), (5001, "x", None), (5002, "", 0)]
    lexicon = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert any("vile".startswith(s[:3]) for s, _ in lexicon.stems)
    assert "vilefoo fish" in lexicon.exceptions
    assert lexicon.score(text(["V1LEFOO", "vileb4r"])) >= toxicity.CUT > lexicon.score(text(["vilefoo fish"]))
    assert toxicity.train(spark.createDataFrame([], "text string, toxic int")).score("vile") == 0.0


def test_lexicon_learns_a_tail_of_rare_words(spark):
    rng = random.Random(9)
    filler = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(300)]
    rare = ["q" + "".join(rng.choice("nopqrstuvwxyz") for _ in range(7)) for _ in range(150)]  # each in about 1.3% of the toxic texts
    def text(extra):
        w = [rng.choice(filler) for _ in range(30)]
        for e in extra:
            w.insert(rng.randrange(len(w)), e)
        return " ".join(w)
    rows = [(text(rng.sample(rare, 2)), 1) for _ in range(3000)] + [(text([]), 0) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "text string, toxic int")
    copies = spark.range(20_000).select(F.lit(text([])).alias("text"), F.lit(1).alias("toxic"))
    for labelled in (frame, frame.unionAll(copies)):
        lexicon = toxicity.train(labelled)
        assert all(s[0] == "q" for s, _ in lexicon.stems)  # no filler
        assert sum(lexicon.score(text([w, w])) >= toxicity.CUT for w in rare) > 0.95 * len(rare)
        assert all(lexicon.score(text([])) < toxicity.CUT for _ in range(200))


def test_toxicity_on_held_out_documents(spark):
    found = queries.op4_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select(F.col("doc_id").alias("id"), "toxic")
    t = {(r["toxic"], r["predicted"]): r["count"] for r in found.join(labels, found["doc_id"] == labels["id"]).filter("held_out").groupBy("toxic", "predicted").count().collect()}
    hit, missed, wrong = t.get((1, 1), 0), t.get((1, 0), 0), t.get((0, 1), 0)
    assert hit / (hit + missed) > 0.9 and hit / (hit + wrong) > 0.9, t


def test_decode_goes_up_the_tree(monkeypatch):
    import public_tokenizers as P

    from sluice.llm import bpe

    codec = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "decoding joins neighbours, level by level: é 日本 \U0001f600 " * 40
    ids = codec.encode(text)
    for leaf in (1, 2, 7, 4096):
        monkeypatch.setattr(bpe, "LEAF_IDS", leaf)
        for n in (0, 1, 2, 3, 5, 8, len(ids)):
            assert codec.decode(ids[:n]) == b"".join(codec.piece[i] for i in ids[:n])
    assert codec.decode(ids).decode() == text


def test_bpe_merges_a_met_piece_once(monkeypatch):
    """Pieces of a large vocabulary stay known: a second pass over 250,000 merges few of them again."""
    own = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    pieces = [f"{i:x}" for i in range(1 << 20, (1 << 20) + 250_000)]
    first = [own.encode_piece(p) for p in pieces]
    calls = []
    monkeypatch.setattr(own, "merge", lambda data: calls.append(data) or [])
    assert [own.encode_piece(p) for p in pieces] == first and not calls
