"""Language identification by rank-order n-gram profiles (operator 6).

Each language has a profile: its ``size`` most frequent letter n-grams (1 to 3
letters, words padded with a blank), in order of frequency. A document gets the
language whose profile its own ranked n-grams are least out of place with.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import distinct_texts, share_of, values

PROFILE_SIZE = 400
#: Bound of the training sample: about this many documents per language.
SAMPLE_PER_LANGUAGE = 600
#: Profiles are held by every task; more labels than this are refused.
MAX_LANGUAGES = 2000
UNKNOWN = "und"
#: How far below the median a text of a language may score, in distances from the median to the lowest tenth; texts that tell it.
SPREAD, LEAST_TEXTS = 6.0, 20
_BLOCK = 1 << 18
#: n-gram counts that a training task holds of a language before it adds them up.
_HELD = 1 << 20
#: Steps of the scores in which the rows next to a wanted rank are looked for.
_STEPS = 1 << 12


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(x: np.ndarray) -> np.ndarray:
    """Codes of the n-grams that start in ``x[:-2]``; 32 stands for a blank."""
    a, b, c = x[:-2], x[1:-1], x[2:]
    letter = a != 32
    inner = b != 32
    return np.concatenate([
        a[letter],
        ((a << 21) | b)[letter | inner],
        ((a << 42) | (b << 21) | c)[inner],
    ])


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a whole text and their counts.

    The text is counted in blocks, so memory follows the block and the number
    of distinct n-grams, not the text.
    """
    letters = _letters()
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    carry = np.array([32], np.int64)
    for at in range(0, len(text), _BLOCK):
        part = text[at:at + _BLOCK].lower()
        cp = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.concatenate([carry, np.where(letters[cp], cp, 32).astype(np.int64)])
        x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
        if at + _BLOCK >= len(text):
            x = np.concatenate([x, [32, 32]])
        carry = x[-2:]
        if len(x) > 2:
            u, n = np.unique(_codes(x), return_counts=True)
            if len(codes):
                u, where = np.unique(np.concatenate([codes, u]), return_inverse=True)
                n = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
            codes, counts = u, n
    return codes, counts


def ranked(text: str, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first, ties by code."""
    codes, counts = count_grams(text)
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


@dataclass(frozen=True)
class Profiles:
    """``rank[i, j]`` is the rank of n-gram ``grams[i]`` in language j, ``size`` if absent."""

    languages: tuple[str, ...]
    grams: np.ndarray
    rank: np.ndarray
    size: int

    def classify(self, text: str | None) -> tuple[str, float]:
        own = ranked(text, self.size) if text else ()
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        out = np.full((len(own), len(self.languages)), self.size, np.int64)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        hit = self.grams[at] == own
        rank = self.rank[at[hit]]
        out[hit] = np.where(rank < self.size, np.abs(rank - np.arange(len(own))[hit, None]), self.size)
        distance = out.sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (self.size * len(own)))


def draw(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int | None = SAMPLE_PER_LANGUAGE) -> DataFrame | None:
    """``lang, text`` of about ``per_language`` different texts of each label, chosen by hash, or of all (None); None without any."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    different = rows.select("lang", F.xxhash64("text").alias("mark")).distinct()
    totals = {r["lang"]: r["n"] for r in different.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not totals:
        return None
    if per_language is None:
        return distinct_texts(rows, "lang")
    share = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, per_language / n))])
    return distinct_texts(rows.filter(share_of(F.xxhash64("text", "lang"), share[F.col("lang")])), "lang")


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of counts, as ``(codes, counts)``."""
    u, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return u, np.bincount(where, np.concatenate([n for _, n in found])).astype(np.int64)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE,
          per_language: int | None = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Learn one profile per non-null value of ``lang``.

    Counts cover the whole texts of a sample of about ``per_language``
    different texts of each language (the documented bound), or all it has
    (always with None), chosen by hash; copies of a text count once, in the share and in the
    profile. Rows with a null text or language are ignored; no rows at all
    give profiles without languages, which classify everything as ``und``.
    """
    sample = draw(docs, text, lang, per_language)
    if sample is None:
        return Profiles((), np.empty(0, np.int64), np.empty((0, 0), np.int64), size)

    def count(batches):
        held: dict[str, list] = {}
        size_of: dict[str, int] = {}

        def sums(name):
            u, n = _added(held.pop(name))
            del size_of[name]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(u, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for name, body in zip(values(batch.column(0)), values(batch.column(1))):
                codes, counts = count_grams(body)
                held.setdefault(name, []).append((codes, counts))
                size_of[name] = size_of.get(name, 0) + len(codes)
                if size_of[name] > _HELD:  # a task holds sums, not the counts of all its texts
                    held[name] = [_added(held[name])]
                    size_of[name] = len(held[name][0][0])
                    if size_of[name] > _HELD // 2:
                        yield sums(name)
            if sum(size_of.values()) > 2 * _HELD:
                for name in list(held):
                    yield sums(name)
        for name in list(held):
            yield sums(name)

    top = (sample.mapInArrow(count, "lang string, gram long, n long")
           .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
           .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1)
           .filter(F.col("rank") < size).select("lang", "gram", "rank").collect())  # size x languages rows at most
    languages = tuple(sorted({r["lang"] for r in top}))
    grams = np.array(sorted({r["gram"] for r in top}), np.int64)
    rank = np.full((len(grams), len(languages)), size, np.int64)
    column = {name: j for j, name in enumerate(languages)}
    for r in top:
        rank[np.searchsorted(grams, r["gram"]), column[r["lang"]]] = r["rank"]
    return Profiles(languages, grams, rank, size)


def length_class(text: Column) -> Column:
    """Texts of one class differ by a factor of two in length."""
    return F.floor(F.log2(F.greatest(F.length(text), F.lit(1)))).cast("int")


def least_scores(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang", found: Column | None = None) -> dict[tuple[str, int], float]:
    """By predicted language and length class, the score below which a text is none of that language.

    Scores are comparable within one script and length only, so the bound comes
    from all labelled texts of the class, copies once for each label: as far
    below their median as ``SPREAD`` times the distance of their lowest tenth.
    Labelled texts that are noise themselves don't move a median. Classes of
    fewer than ``LEAST_TEXTS`` texts get no bound. ``found`` is what
    ``identify`` gave, if ``docs`` holds it. At most (languages x some 30
    classes) rows reach the driver.
    """
    found = identify(F.col(text), profiles) if found is None else found
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    scored = labelled.select(F.col(lang).alias("label"), F.xxhash64(text).alias("mark"), length_class(F.col(text)).alias("size"), found.alias("found"))
    once = scored.filter(F.col("found.lang") != UNKNOWN).groupBy("label", "mark").agg(F.first("size").alias("size"), F.first("found").alias("found"))
    at = quantiles(once.select("found.lang", "size", "found.score"), ["lang", "size"], "score", (0.1, 0.5)).filter(F.col("n") >= LEAST_TEXTS)
    found_at: dict[tuple[str, int], dict[float, float]] = {}
    for r in at.collect():
        found_at.setdefault((r["lang"], r["size"]), {})[r["share"]] = r["value"]
    return {key: q[0.5] - SPREAD * (q[0.5] - q[0.1]) for key, q in found_at.items()}


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """``keys, n, share, value``: exact quantiles of a value from 0 to 1, interpolated like ``percentile``.

    Rows are counted in steps of the value first; only the steps that hold a
    wanted rank are sorted, so no task gets the whole of a group.
    """
    stepped = rows.withColumn("step", F.floor(F.col(value) * _STEPS))
    below = Window.partitionBy(*keys).orderBy("step")
    steps = stepped.groupBy(*keys, "step").agg(F.count("*").alias("many"))
    steps = steps.withColumn("n", F.sum("many").over(Window.partitionBy(*keys))).withColumn("start", F.sum("many").over(below) - F.col("many"))
    rank = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), (F.lit(s) * (F.col("n") - 1)).alias("at")) for s in shares]))
    wanted = steps.select(*keys, "step", "n", "start", "many", rank.alias("w")).select("*", "w.*").drop("w").filter(
        (F.floor("at") < F.col("start") + F.col("many")) & (F.ceil("at") >= F.col("start")))
    near = stepped.join(F.broadcast(wanted.select(*keys, "step", "start").distinct()), [*keys, "step"])
    tied = near.groupBy(*keys, "step", "start", value).agg(F.count("*").alias("ties"))
    ends = tied.withColumn("last", F.col("start") + F.sum("ties").over(Window.partitionBy(*keys, "step").orderBy(value)) - 1)
    met = ends.withColumn("first", F.col("last") - F.col("ties") + 1).join(F.broadcast(wanted.drop("start", "many")), [*keys, "step"])
    part = F.col("at") - F.floor("at")

    def here(place: Column) -> Column:
        return F.max(F.when(place.between(F.col("first"), F.col("last")), F.col(value)))

    found = met.groupBy(*keys, "n", "share", "at").agg(here(F.floor("at")).alias("low"), here(F.ceil("at")).alias("high"))
    return found.select(*keys, "n", "share", ((1 - part) * F.col("low") + part * F.col("high")).alias("value"))


def identify(text: Column, profiles: Profiles) -> Column:
    """Struct ``(lang, score)`` of each whole text.

    ``score`` is 1 minus the out-of-place distance over its maximum. A null
    text, and one without a letter, is ``und`` with score 0; a tie goes to the
    first language by code point.
    """

    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def classify(column: pa.Array) -> pa.Array:
        found = [profiles.classify(x) for x in values(column)]
        return pa.array([{"lang": a, "score": b} for a, b in found], kind)

    return classify.asNondeterministic()(text)  # so that a filter on it doesn't evaluate it twice
