"""Toxicity by a weighted lexicon and Aho-Corasick matching (operator 4).

Texts are folded (case, accents, homoglyphs, digits and signs that stand for
letters) and matched with an automaton of word stems. A stem's weight is its
log-odds between toxic and other labelled documents. Exception phrases, stems
in a neighbourhood that is usual in harmless documents, are patterns too and
cancel the hits they cover. The sum and the sum per word of the text make the
score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import exp, log, log1p

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct_texts, share_of, values

#: Bounds of the training sample: documents per label.
SAMPLE_PER_LABEL = 6_000
STEM = range(3, 13)
#: A stem needs so many different left neighbours (of 64 classes) in toxic texts,
#: which the words of one much copied text don't have, and this precision.
LEAST_CONTEXTS = 8
LEAST_PRECISION = 0.74
#: Share of the stems taken that may be no more frequent in toxic texts than in others (false discovery rate).
FALSE_SHARE = 0.05
CUT = 0.7

# Letters of other scripts that look like Latin ones, and digits and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d", "ß": "ss",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}


class _Folding(dict):
    """Code point to its folded text; filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = unicodedata.normalize("NFKD", c).lower()
        folded = "".join(HOMOGLYPHS.get(x, LEET.get(x, x)) for x in base if not unicodedata.combining(x))
        if unicodedata.category(c) in ("Cf", "Mn", "Me"):  # invisible joiners and loose accents
            folded = ""
        elif not folded or not folded.isalpha():
            folded = " "
        self[code] = folded
        return folded


_FOLDING = _Folding()


def fold(text: str) -> str:
    """Folded words, joined and bracketed by single spaces."""
    return " " + " ".join(text.lower().translate(_FOLDING).split()) + " "


@dataclass(frozen=True)
class Lexicon:
    """Stems with weights, exception phrases, and the two scales of the score."""

    stems: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    slope: tuple[float, float, float]  # of log(1 + sum), of log(1 + 1000 sum per word), constant

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("stems", "exceptions", "slope")}

    def __setstate__(self, state):
        self.__dict__.update(state)

    @cached_property
    def weights(self) -> dict[str, float]:
        return dict(self.stems)

    @cached_property
    def automaton(self):
        out = ahocorasick.Automaton()
        for stem, _ in self.stems:
            out.add_word(" " + stem, (" " + stem, False))
        for phrase in self.exceptions:
            out.add_word(f" {phrase} ", (f" {phrase} ", True))
        out.make_automaton()
        return out

    def hits(self, folded: str) -> list[tuple[int, str]]:
        """(place, stem) of each word that starts with a stem (the longest one), exceptions taken out."""
        best: dict[int, str] = {}
        spared: list[tuple[int, int]] = []
        for end, (word, phrase) in self.automaton.iter(folded):
            start = end - len(word) + 1
            if phrase:
                spared.append((start, end))
            elif len(word) > len(best.get(start, "")):
                best[start] = word
        return [(at, w[1:]) for at, w in sorted(best.items()) if not any(a <= at and at + len(w) - 1 <= b for a, b in spared)]

    def features(self, text: str | None) -> tuple[float, float]:
        if not text or not self.stems:
            return 0.0, 0.0
        folded = fold(text)
        total = sum(self.weights[s] for _, s in self.hits(folded))
        return log1p(total), log1p(1000 * total / max(1, folded.count(" ") - 1))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        if a == 0:
            return 0.0
        z = self.slope[0] * a + self.slope[1] * b + self.slope[2]
        return 1 / (1 + exp(-min(max(z, -500.0), 500.0)))


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``stem, toxic, clean, contexts, spots``: documents by label, classes of left neighbours in toxic ones, and their number summed over these documents."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for body, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parts = fold(body).split()
            seen: dict[str, int] = {}
            for left, word in zip(["", *parts], parts):
                bit = 1 << (sum(left.encode()) * 31 + len(left)) % 64 if toxic else 0
                if word in seen and not toxic:
                    continue
                for n in {*STEM, len(word)}:
                    if n <= len(word) and n >= STEM[0]:
                        seen[word[:n]] = seen.get(word[:n], 0) | bit
            for stem, bits in seen.items():
                row = counts.setdefault(stem, [0, 0, 0, 0])
                row[0 if toxic else 1] += 1
                row[2] |= bits
                row[3] += bits.bit_count()
        if counts:
            t, c, x, s = np.array(list(counts.values()), dtype=object).T
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(t.tolist(), pa.int64()), pa.array(c.tolist(), pa.int64()),
                                              pa.array([int(v) - (1 << 64) if int(v) >> 63 else int(v) for v in x], pa.int64()),
                                              pa.array(s.tolist(), pa.int64())], names=["stem", "toxic", "clean", "contexts", "spots"])


def _phrases(lexicon: Lexicon, toxic: bool, text: str) -> Iterator[tuple[str, bool]]:
    folded = fold(text)
    found = set()
    for at, _ in lexicon.hits(folded):
        right = folded[at + 1:].split(" ", 2)[:2]
        left = folded[:at].rsplit(" ", 1)[-1]
        if left:
            found.add(f"{left} {right[0]}")
        if len(right) > 1 and right[1]:
            found.add(f"{right[0]} {right[1]}")
    return ((p, toxic) for p in found)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on two features, balanced; the best cut of the sample gets score ``CUT``."""
    design = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (weight * (p - y)) + 1e-3 * w
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(3)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    z = design @ w
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    f1[:-1][z[order][:-1] == z[order][1:]] = -1  # no cut inside a tie
    best = int(f1.argmax())
    cut = (z[order][best] + z[order][best + 1]) / 2 if best + 1 < len(z) else z[order][best] - 1
    return float(w[0]), float(w[1]), float(w[2] - cut + log(CUT / (1 - CUT)))


def train(labelled: DataFrame, text: str = "text", toxic: str = "toxic", per_label: int = SAMPLE_PER_LABEL) -> Lexicon:
    """Learn stems, weights, exception phrases and scales from labelled texts (0 or 1).

    Uses about ``per_label`` different texts of each label (the documented
    bound), chosen by hash, whole; copies of a text count once. A stem is taken
    on evidence, not on a share of the sample: the one-sided binomial test that
    it is no more frequent in toxic texts, by Chernoff's bound and corrected
    for the number of stems (Benjamini and Hochberg), must fail. Near copies
    count as far as their contexts differ. Rows with a null text or label are ignored. Without
    documents of both labels the lexicon is empty and every score 0.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(toxic).cast("int").alias("toxic")).filter("text is not null and toxic in (0, 1)")
    different = rows.select("toxic", F.xxhash64("text").alias("mark")).distinct()
    totals = {r["toxic"]: r["n"] for r in different.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Lexicon((), (), (0.0, 0.0, 0.0))
    share = F.when(F.col("toxic") == 1, min(1.0, per_label / totals[1])).otherwise(min(1.0, per_label / totals[0]))
    sample = distinct_texts(rows.filter(share_of(F.xxhash64("text"), share)), "toxic").select("text", "toxic").cache()
    counted = (sample.mapInArrow(_count_stems, "stem string, toxic long, clean long, contexts long, spots long").groupBy("stem")
               .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("contexts").alias("contexts"), F.sum("spots").alias("spots")).cache())
    try:
        n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if len(n) < 2:
            return Lexicon((), (), (0.0, 0.0, 0.0))
        t, c = F.col("toxic"), F.col("clean")
        # rates, so that the sample's shares of the labels don't matter
        precision = (t / n[1]) / (t / n[1] + (c + 0.5) / n[0])
        even = n[1] / (n[0] + n[1])
        # near copies repeat their contexts: documents count as far as the contexts they bring are new (classes met by linear counting)
        met = F.bit_count("contexts")
        new = F.when(met < 64, F.least(F.lit(1.0), 64 * F.log(F.lit(64.0) / (64 - met)) / F.col("spots"))).otherwise(1.0)
        evidence = new * (t * F.log(t / ((t + c) * even)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - even)))).otherwise(0.0))
        evidence = F.when(t > (t + c) * even, evidence).otherwise(0.0)
        # stems too rare to be told at all are no tests; tenths of evidence, so that the driver sees few rows
        tested = counted.filter(-log(even) * (t + c) >= -log(FALSE_SHARE))
        level, above, tests = float("inf"), 0, tested.groupBy(F.floor(10 * evidence).alias("tenth")).count().orderBy(F.desc("tenth")).collect()
        for r in tests:
            above += r["count"]
            if r["tenth"] / 10 >= log(sum(x["count"] for x in tests) / (FALSE_SHARE * above)):
                level = r["tenth"] / 10
        stems = (tested.filter("toxic > 0").filter((met >= LEAST_CONTEXTS) & (precision >= LEAST_PRECISION) & (evidence >= level))
                 .orderBy(F.desc("toxic"), "stem").collect())  # words of the sample, which is bounded
        known = {r["stem"]: r for r in stems}
        kept = {}
        for s, r in known.items():
            # a shorter stem that is as telling replaces s; a longer one with the same documents does, too
            shorter = any(s[:k] in known and known[s[:k]]["clean"] <= r["clean"] and known[s[:k]]["toxic"] > 1.05 * r["toxic"] for k in range(STEM[0], len(s)))
            kept[s] = not shorter
        chosen = [s for s in known if kept[s]]
        same = {}
        for s in sorted(chosen, key=len):  # idiot rather than idio
            for k in range(STEM[0], len(s)):
                if same.get(s[:k]) == (known[s]["toxic"], known[s]["clean"]):
                    del same[s[:k]]
            same[s] = (known[s]["toxic"], known[s]["clean"])
        weights = tuple(sorted((s, log((a + 0.5) / (n[1] + 1)) - log((b + 0.5) / (n[0] + 1))) for s, (a, b) in same.items()))
        draft = Lexicon(tuple((s, w) for s, w in weights if w > 0), (), (1.0, 1.0, 0.0))

        def phrases(batches):
            for batch in batches:
                found = [p for body, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in _phrases(draft, bool(label), body)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found]), pa.array([int(x) for _, x in found], pa.int64())], names=["phrase", "toxic"])

        usual = (sample.mapInArrow(phrases, "phrase string, toxic long").groupBy("phrase")
                 .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
                 .filter((F.col("clean") >= 5) & (F.col("clean") / n[0] > 4 * (F.col("toxic") + 0.5) / n[1]))
                 .orderBy(F.desc("clean"), "phrase").collect())
        draft = Lexicon(draft.stems, tuple(sorted(r["phrase"] for r in usual)), draft.slope)

        def measure(batches):
            for batch in batches:
                f = [draft.features(x) for x in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), batch.column(1)], names=["a", "b", "toxic"])

        seen = sample.mapInArrow(measure, "a double, b double, toxic int").collect()  # 3 numbers a sampled document
        x, y = np.array([[r["a"], r["b"]] for r in seen]), np.array([r["toxic"] for r in seen], float)
        some = x[:, 0] > 0  # the others have score 0 by definition
        if len(set(y[some].tolist())) < 2:  # nothing harmless is hit: one hit of the least weight in a long text decides
            low = x[some].min(axis=0) if some.any() else np.ones(2)
            return Lexicon(draft.stems, draft.exceptions, (2.0, 0.0, log(CUT / (1 - CUT)) - 2.0 * 0.9 * float(low[0])))
        x, y = np.vstack([x[some], np.zeros((int((~some & (y == 0)).sum() > 0), 2))]), np.concatenate([y[some], [0.0] * int((~some & (y == 0)).sum() > 0)])
        return Lexicon(draft.stems, draft.exceptions, _fit(x, y))
    finally:
        counted.unpersist()
        sample.unpersist()


def sample_labels(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """About ``per_label`` distinct (mark, label) rows of each label; ``mark`` is a text's xxhash64, which draws it.

    ``docs`` and ``labels`` meet on ``doc_id`` without their texts. The result
    is small enough to be broadcast to the documents, so that training moves
    no texts but those of the sample.
    """
    marks = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("mark"))
    told = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    rows = marks.join(told, "doc_id").select("mark", "toxic").distinct()
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, per_label / totals.get(1, 1))).otherwise(min(1.0, per_label / totals.get(0, 1)))
    return rows.filter(share_of(F.xxhash64("mark", F.lit("label")), share))


def score(text: Column, lexicon: Lexicon) -> Column:
    """Score of each whole text from 0 to 1; null, empty and unhit texts have 0.

    A text is folded and searched whole, however long; equal texts score alike.
    A lexicon learned from nothing scores everything 0.
    """

    @F.arrow_udf("double")
    def compute(column: pa.Array) -> pa.Array:
        return pa.array([lexicon.score(x) for x in values(column)], pa.float64())

    return compute.asNondeterministic()(text)
