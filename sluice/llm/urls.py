"""URL filtering by association rules (operator 3); DataFrame functions only.

Listed rules (a host with its subdomains, and a path prefix) judge what they
fit; the longest wins. They also label the urls that Spark's FP-growth mines
for token combinations. Combinations that speak for one verdict with enough
support and confidence become association rules, redundant ones are pruned,
and an index from each rule's rarest token matches them to the other urls.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ALLOW, BLOCK = "allow", "block"
LEAST_SUPPORT, LEAST_CONFIDENCE = 0.005, 0.8
_LABEL = "verdict="


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest listed rule that fits and its verdict, null where none does.

    ``rules`` holds (verdict, host, path). Of rules of one length the first wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == at) | host_.endswith("." + at)) & path_.startswith(start)
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a whole url, as its parts have them.

    The labels of its host (``h:``), the words of its folders (``p:``) and of
    its page name (``n:``), the keys (``q:``) and the words of the values
    (``v:``) of its query, and the words of its fragment (``f:``). Words are
    runs of letters and digits; case counts.
    """
    def named(kind: str, words: Column) -> Column:
        return F.transform(words, lambda x: F.concat(F.lit(kind), x))

    def words(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"))

    def part(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))

    whole = path(url)
    folders, name = F.regexp_extract(whole, r"(?s)^(.*/)", 1), F.regexp_extract(whole, r"(?s)([^/]*)$", 1)
    pairs = F.split(part(r"(?s)^.*?://[^?#]*\?([^#]*)"), r"[&;]")
    keys = F.transform(pairs, lambda x: F.regexp_extract(x, r"(?s)^([^=]*)", 1))
    values = F.flatten(F.transform(pairs, lambda x: words(F.regexp_extract(x, r"(?s)^[^=]*=(.*)", 1))))
    every = F.concat(named("h:", F.split(host(url), r"\.")), named("p:", words(folders)), named("n:", words(name)),
                     named("q:", keys), named("v:", values), named("f:", words(part(r"(?s)^.*?://[^#]*#(.*)"))))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: F.length(x) > 2)))


class Names:
    """Names of the tokens that stand in enough rows; tokens of exactly the same rows share one.

    Such tokens stand for each other in a rule: mined once for all, a much
    repeated url costs one item and not every subset of its tokens. There are
    at most (tokens of a row on average) / support of them, so they fit the
    driver and a literal.
    """

    def __init__(self, labelled: DataFrame, support: float):
        rows = labelled.select("tokens", F.monotonically_increasing_id().alias("row"))
        least = labelled.count() * support
        parts = rows.select(F.explode("tokens").alias("token"), F.xxhash64("row").alias("a"), F.xxhash64("row", F.lit(1)).alias("b"))
        found = (parts.groupBy("token").agg(F.count("*").alias("total"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
                 .filter(F.col("total") >= least).collect())
        classes: dict[tuple, list[str]] = {}
        for r in found:
            classes.setdefault((r["total"], r["a"], r["b"]), []).append(r["token"])
        self.alike = {min(c): sorted(c) for c in classes.values()}
        self.total = {min(c): k[0] for k, c in classes.items()}

    def of(self, tokens_: Column) -> Column:
        """The sorted names of a row's tokens."""
        known = sorted(t for c in self.alike.values() for t in c)
        if not known:
            return F.array().cast("array<string>")
        held = F.array_intersect(tokens_, F.lit(known))
        other = [F.lit(x) for name, c in self.alike.items() for t in c if t != name for x in (t, name)]
        if other:
            held = F.transform(held, lambda t: F.coalesce(F.try_element_at(F.create_map(*other), t), t))
        return F.array_sort(F.array_distinct(held))


def _sets(items: DataFrame, support: float) -> DataFrame:
    """``names, verdict, freq, total``: every combination of names with a verdict that has enough support (FP-growth)."""
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.0).fit(items).freqItemsets
    with_label = F.filter("items", lambda x: x.startswith(_LABEL))
    sets = found.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(_LABEL))).alias("names"),
                        F.get(with_label, F.lit(0)).alias("label"), "freq").filter(F.size("names") > 0)
    whole = sets.filter("label is null").select("names", F.col("freq").alias("total"))
    return sets.filter("label is not null").join(whole, "names").select(
        "names", F.substring("label", len(_LABEL) + 1, 100).alias("verdict"), "freq", "total")


_RULE = "names array<string>, verdict string, confidence double, support_count long"


def _mined(labelled: DataFrame, names: Names, support: float, confidence: float) -> DataFrame:
    """Rules ``names, verdict, confidence, support_count`` that no smaller rule makes redundant.

    Sizes go up one at a time. A combination hears from those with one name
    less, which have heard from theirs, the best confidence of any rule inside
    it: k rows for a combination of k names, never its 2^k subsets.
    """
    spark = labelled.sparkSession
    label = F.concat(F.lit(_LABEL), "verdict")
    sets = materialize(_sets(labelled.select(F.array_append(names.of(F.col("tokens")), label).alias("items")), support)
                       .withColumn("confidence", F.col("freq") / F.col("total")), "sets")
    largest = sets.agg(F.max(F.size("names"))).first()[0] or 0
    rules, below = spark.createDataFrame([], _RULE), None
    for k in range(1, largest + 1):
        here = sets.filter(F.size("names") == k)
        if below is None:
            here = here.withColumn("best", F.lit(None).cast("double"))
        else:
            parts = here.select("names", "verdict", F.explode(F.transform("names", lambda x: F.array_remove("names", x))).alias("part"))
            heard = (parts.join(below, (F.col("part") == F.col("smaller")) & (F.col("verdict") == F.col("same")))
                     .groupBy("names", "verdict").agg(F.max("top").alias("best")))
            here = here.join(heard, ["names", "verdict"], "left")
        here = materialize(here, "level")
        good = F.col("confidence") >= confidence
        new = here.filter(good & (F.col("best").isNull() | (F.col("best") < F.col("confidence"))))
        rules = rules.unionByName(new.select("names", "verdict", "confidence", F.col("freq").alias("support_count")))
        below = here.select(F.col("names").alias("smaller"), F.col("verdict").alias("same"),
                            F.greatest("best", F.when(good, F.col("confidence"))).alias("top"))
    return rules


def mine(labelled: DataFrame, support: float = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Association rules ``tokens, verdict, confidence, support_count`` from ``tokens, verdict`` rows, written out.

    Combinations of any size are mined. Support and confidence are counted over
    all rows. A rule is redundant, and dropped, if one with a proper subset of
    its tokens has the same verdict and no less confidence. Tokens that share a
    name give a row each here; ``judge`` matches names and never writes them out.
    """
    if labelled.isEmpty():
        return labelled.sparkSession.createDataFrame([], _RULE.replace("names", "tokens"))
    names = Names(labelled, support)
    alike = labelled.sparkSession.createDataFrame([(k, v) for k, v in names.alike.items()], "name string, alike array<string>")
    rules = _mined(labelled, names, support, confidence)
    choices = (rules.select("*", F.explode("names").alias("name")).join(alike, "name")
               .groupBy("names", "verdict", "confidence", "support_count").agg(F.collect_list("alike").alias("alike")))
    none = F.array(F.array().cast("array<string>"))
    every = F.reduce("alike", none, lambda done, some: F.flatten(F.transform(done, lambda d: F.transform(some, lambda x: F.array_append(d, x)))))
    return choices.select(F.explode(every).alias("tokens"), "verdict", "confidence", "support_count").withColumn("tokens", F.array_sort("tokens"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row.

    The longest listed rule that fits decides; else, of the association rules
    whose tokens the whole url has, the one with the highest confidence, then
    support, then first tokens; else ``allow``. A null url, and one without
    ``://``, has empty host and path and is allowed. Repeated rows give
    repeated rows; an empty table gives an empty result; other columns are
    ignored.

    Urls are matched once per distinct names of their tokens, by the rarest
    name of a rule, so a url with a third of all rows costs one row; the join
    back is an equi-join that Spark can split.
    """
    address = F.col(url)
    rows = pages.select(F.col(page_id).alias("page_id"), host(address).alias("host"), path(address).alias("path"), address.alias("url"))
    rule, says = listed(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", "url", rule.alias("rule"), says.alias("listed"))
    labelled = materialize(rows.filter("listed is not null").select(tokens(F.col("url")).alias("tokens"), F.col("listed").alias("verdict")), "labelled")
    if labelled.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("listed", F.lit(ALLOW)).alias("verdict"))
    names = Names(labelled, LEAST_SUPPORT)
    totals = pages.sparkSession.createDataFrame(list(names.total.items()), "name string, total long")
    # a rule is found by its rarest name; its place in the order is the key itself, not a number
    found = _mined(labelled, names, LEAST_SUPPORT, LEAST_CONFIDENCE).withColumn(
        "order", F.struct(-F.col("confidence"), -F.col("support_count"), F.array_join("names", " "), F.col("verdict")))
    learned = materialize(
        found.select("names", "verdict", "order", F.explode("names").alias("name")).join(totals, "name")
        .groupBy(F.col("names").alias("needed"), F.col("verdict").alias("v"), "order").agg(F.min_by("name", F.struct("total", "name")).alias("name")), "rules")
    asked = rows.withColumn("key", names.of(tokens(F.col("url")))).withColumn("key", F.when(F.col("listed").isNull(), F.col("key")))
    matched = (asked.filter("listed is null").select("key").distinct().select("key", F.explode("key").alias("name"))
               .join(learned, "name").filter(F.size(F.array_except("needed", "key")) == 0)
               .groupBy(F.col("key").alias("met")).agg(F.min_by("v", "order").alias("learned")))
    return (asked.join(matched, asked["key"] == matched["met"], "left")
            .select("page_id", "host", "path", "rule", F.coalesce("listed", "learned", F.lit(ALLOW)).alias("verdict")))
