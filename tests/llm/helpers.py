"""Small tables with the awkward rows every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, mark string, kept string, tokens string, row_id string, shard string, fp string"
_CLASH = ("s", "c", "m", "k", "t", "r", "h", "f")


def sentence(rng: random.Random, n: int, words=("alpha", "beta", "gamma", "delta", "omega", "nu", "xi", "rho")) -> str:
    return " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(n))


def doc_rows(rng: random.Random | None = None):
    """(doc_id, text, lang, source): nulls, empties, a very long text, ties, copies and repeated rows."""
    rng = rng or random.Random(5)
    base = [sentence(rng, 60) for _ in range(12)]
    long = sentence(rng, 60_000)
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(base)]
    rows += [
        (100, None, None, None), (101, "", "en", "s0"), (102, " ", "en", "s1"), (103, "\t \n", None, None), (104, "One", "en", "s2"),
        (105, base[0].replace(" ", "\n\t"), "en", "s1"), (106, base[0], "en", "s1"), (106, base[0], "en", "s1"), (None, base[0], None, "s2"),
        (None, None, None, None), (107, long, "en", "s3"), (108, long + " tail", "en", "s3"), (109, long, "en", None),
        (110, "12345 !!! ...", "en", "s0"), (111, base[3] + "x", "en", "s2"), (112, base[3].upper(), "en", "s2"), (113, "é" * 50_000, "en", "s1"),
    ]
    rows += [(200 + i, base[5], "en", "hot") for i in range(40)]
    return rows


def doc_frame(spark, rows):
    return spark.createDataFrame([(a, b, c, d, len(b or ""), *_CLASH) for a, b, c, d in rows], DOCS)
