"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 9).

A document's key is an exponential draw from a hash of its id and text, divided
by its quality weight. Each source repeats whole epochs while its target holds
them; the rest is filled in key order until the token budget is used. The cut
in that order is found by narrowing a histogram of the keys, so no source is
ever sorted whole, and choosing is a comparison with the source's cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Sources whose sums may come to the driver; more are refused.
MAX_SOURCES = 100_000
WEIGHTS = (5, 2, 1)
SHARE, REPEATS = 1.5, 2
_BITS, _DIGIT = 48, 12
#: Rows of a source's last histogram bin that one task sorts.
SORTED = 5_000


def key(doc_id: Column, text: Column, weight: Column, again: Column | None = None) -> tuple[Column, Column]:
    """Order of the draw: a key of 48 bits, and a hash for ties.

    -ln(u)/w is exponential; a fixed rising function of it makes it a long.
    ``again`` tells rows that repeat with id and text apart; null for others.
    """
    ident = (doc_id.cast("string"), F.coalesce(text, F.lit("")), *([] if again is None else [again]))
    u = (F.pmod(F.xxhash64(F.lit("draw"), *ident), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    draw = -F.log(u) / F.greatest(weight, F.lit(1e-6))
    return F.floor((draw / (draw + 1)) * float((1 << _BITS) - 1)).cast("long"), F.xxhash64(F.lit("tie"), *ident)


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Tokens each source should give: by weight, at most ``REPEATS`` times its size.

    Sources in code point order, null last, weigh 5, 2, 1 in turn and share
    ``SHARE`` of all sizes; what a source cannot take is shared again by weight
    until none is above its limit.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    limit = {s: float(REPEATS * sizes[s]) for s in names}
    rest, open_, out = SHARE * sum(sizes.values()), list(names), {}
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > limit[s]]
        if not over:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in over:
            out[s] = limit[s]
            rest -= limit[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _cuts(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source_id, cut_key, cut_tie``: the last row of each source that the budget holds.

    ``rows`` has source_id, key, tie, size; ``budgets`` source_id, budget. Each
    round sums the open bin of every source by the next digit of the key (a
    partial aggregate) and keeps the bin where the budget ends. A bin of few
    rows, or of rows with one key, is summed in order; the row on the edge is
    taken if that comes nearer to the budget.
    """
    frontier = materialize(budgets.select("source_id", "budget", F.lit(0).cast("long").alias("base")), "budgets")
    done, bits = [], _BITS
    while True:
        inside = rows.join(F.broadcast(frontier), "source_id").filter(F.shiftright("key", bits) == F.shiftright("base", bits))
        if bits:
            heavy = inside.groupBy("source_id").agg(F.count("*").alias("n")).filter(F.col("n") > SORTED).select("source_id")
            heavy = materialize(heavy, "heavy")
        else:
            heavy = None
        ready = inside if heavy is None else inside.join(F.broadcast(heavy), "source_id", "left_anti")
        order = Window.partitionBy("source_id").orderBy("key", "tie")
        # rows equal in key and tie (a hash clash) are taken together
        summed = (ready.groupBy("source_id", "key", "tie", "budget").agg(F.sum("size").alias("size"))
                  .withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))))
        done.append(materialize(summed.filter(F.col("upto") - F.col("size") / 2 <= F.col("budget"))
                                .groupBy("source_id").agg(F.max(F.struct("key", "tie")).alias("cut"))
                                .select("source_id", F.col("cut.key").alias("cut_key"), F.col("cut.tie").alias("cut_tie")), "cuts"))
        # a source whose open bin gives no row is cut just below that bin
        open_ = frontier if heavy is None else frontier.join(F.broadcast(heavy), "source_id", "left_anti")
        none = open_.join(F.broadcast(done[-1]), "source_id", "left_anti").select(
            "source_id", (F.col("base") - 1).alias("cut_key"), F.lit((1 << 63) - 1).alias("cut_tie"))
        done.append(none)
        if heavy is None or heavy.isEmpty():
            break
        bits -= _DIGIT
        bins = (inside.join(F.broadcast(heavy), "source_id").groupBy("source_id", "budget", F.shiftright("key", bits).alias("bin"))
                .agg(F.sum("size").alias("size")))
        bins = bins.withColumn("upto", F.sum("size").over(Window.partitionBy("source_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        bins = bins.withColumn("last", F.max("bin").over(Window.partitionBy("source_id")))
        at = bins.filter((F.col("upto") > F.col("budget")) | (F.col("bin") == F.col("last"))).groupBy("source_id").agg(
            F.min(F.struct("bin", (F.col("budget") - F.col("upto") + F.col("size")).alias("budget"))).alias("at"))
        frontier = materialize(at.select("source_id", F.col("at.budget").alias("budget"), F.shiftleft("at.bin", bits).alias("base")), "budgets")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return materialize(out, "cuts")


def _told_apart(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, Column | None]:
    """``docs`` with a number for rows that repeat with id and text, and that column; as they are if none does.

    Repeats are found by hashes, combined before the shuffle. Where there are
    some the rows are written once with their row numbers, so that every later
    reading draws the same.
    """
    same = F.xxhash64(F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")))
    repeated = docs.select(same.alias("_same")).groupBy("_same").agg(F.count("*").alias("n")).filter("n > 1").select("_same")
    repeated = materialize(repeated, "repeats")
    if repeated.isEmpty():
        return docs, None
    numbered = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), same.alias("_id"),
                                       F.monotonically_increasing_id().alias("_number")), "rows")
    told = numbered.join(repeated, numbered["_id"] == repeated["_same"], "left")
    return told.select("_row.*", F.when(F.col("_same").isNotNull(), F.col("_number")).alias("_again")), F.col("_again")


def mix(docs: DataFrame, size: Column, weight: Column, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with a struct column ``mix`` (size, source_size, target, copies, taken).

    ``copies`` is how often the mix takes a row: the whole epochs of its
    source, plus 1 if the fractional selection takes it; ``taken`` is copies
    times size. Reruns agree: draws are hashes of id and text, and of the row's
    number where both repeat, so that repeated rows are drawn each by itself. A
    null id or text draws like any other value; rows of size 0 add nothing and
    follow their key; a source without any words has target 0 and gives
    nothing. Long texts count whole. An empty table gives an empty result. A
    column ``mix`` of ``docs`` gives way to the new one; ``size`` and
    ``weight`` may still use it, ``_again`` is a name of this function's own.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "mix"]
    docs, again = _told_apart(docs.select("*", size.alias("_size"), weight.alias("_weight")), doc_id, text)
    size = F.col("_size")
    order, tie = key(F.col(doc_id), F.col(text), F.col("_weight"), again)
    slim = materialize(docs.select(F.col(source).alias("source"), order.alias("key"), tie.alias("tie"), size.alias("size")), "draws")
    sizes = {r["source"]: r["n"] for r in slim.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = targets(sizes)
    plan = spark.createDataFrame(
        [(i, s, sizes[s], goal[s], int(goal[s] // sizes[s]) if sizes[s] else 0) for i, s in enumerate(goal)],
        "source_id int, name string, source_size long, target double, epochs int")
    plan = plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    same_source = slim["source"].eqNullSafe(plan["name"])
    cuts = _cuts(slim.join(F.broadcast(plan), same_source).filter("budget > 0").select("source_id", "key", "tie", "size"),
                 plan.filter("budget > 0").select("source_id", "budget"))
    plan = plan.join(cuts, "source_id", "left")
    plan = materialize(plan, "mix-plan")  # MAX_SOURCES rows at most
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), order.alias("key"), tie.alias("tie"), size.alias("size"), F.col(source).alias("source"))
    joined = inner.join(F.broadcast(plan), inner["source"].eqNullSafe(plan["name"]))
    picked = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("tie") <= F.col("cut_tie")))
    copies = (F.col("epochs") + F.coalesce(picked, F.lit(False)).cast("int")).alias("copies")
    out = joined.select("row", "size", "source_size", "target", copies)
    return out.select("row.*", F.struct("size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")).alias("mix"))
