"""Hard-negative mining with integer scores from a residue-number-system GEMM (operator 13).

Vectors are integers. Their products are taken modulo several small primes, one
float32 matrix product for each prime: with centred residues every partial sum
stays below 2^24, where float32 counts exactly. Chinese remaindering, as
mixed-radix digits, gives back the signed score; there are as many primes as the
largest vector needs. Anchors are a stated set that meets all rows in blocks:
once for the positives, and once more for the negatives inside each positive's
window of scores. Blocks keep the few best rows of each anchor, which a window
function merges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Largest prime of the residue system; centred residues of smaller ones are at most half of it.
LARGEST_PRIME = 251
#: Rows of a block, and anchors that meet it in one task.
BLOCK_ROWS, ANCHORS_AT_ONCE = 8192, 1024
#: Anchors that are scored at once within a task.
_STEP = 128
#: Squared lengths beyond this have scores that a long cannot hold.
_LONGEST = float(1 << 61)


def primes(above: int) -> list[int]:
    """Primes from ``LARGEST_PRIME`` down whose product exceeds ``above``."""
    out, product, p = [], 1, LARGEST_PRIME
    while product <= above:
        if all(p % d for d in range(2, int(p ** 0.5) + 1)):
            out.append(p)
            product *= p
        p -= 1
        if p < 3:
            raise ValueError("scores are too large for the residue system")
    return out


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    r = x % p
    return np.where(r > p // 2, r - p, r)


def residue_product(a: np.ndarray, b: np.ndarray, moduli: list[int]) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact where twice its size is below the product of ``moduli``.

    Each component product is a float32 GEMM; long vectors are cut so that no
    sum leaves the integers that float32 holds.
    """
    span = max(1, (1 << 24) // (max(moduli) // 2) ** 2)
    digits: list[np.ndarray] = []
    for i, p in enumerate(moduli):
        ra, rb = _centred(a, p).astype(np.float32), _centred(b, p).astype(np.float32)
        part = np.zeros((len(a), len(b)), np.int64)
        for at in range(0, a.shape[1], span):
            part += (ra[:, at:at + span] @ rb[:, at:at + span].T).astype(np.int64)
        # mixed radix: part = d0 + d1*p0 + d2*p0*p1 + ... modulo p
        known, radix = np.zeros_like(part), 1
        for q, d in zip(moduli, digits):
            known, radix = (known + d * radix) % p, radix * q % p
        digits.append(_centred((part - known) % p * pow(radix, -1, p), p))
    total, radix = np.zeros((len(a), len(b)), np.int64), 1
    # centred digits give the signed value; it fits a long, so sums that wrap on the way come back
    for p, d in zip(moduli, digits):
        total += d * np.int64((radix + (1 << 63)) % (1 << 64) - (1 << 63))
        radix *= p
    return total


def vectors(table: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """``vec_id, label, v`` (longs) of the rows that take part: floor(256 x) of each component."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    square = F.aggregate(x, F.lit(0.0), lambda a, c: a + F.floor(c * 256).cast("double") * F.floor(c * 256).cast("double"))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), x.alias("x"), finite.alias("finite"), square.alias("square"))
    rows = rows.filter("vec_id is not null and label is not null and x is not null and finite").filter(F.col("square") < _LONGEST)
    return rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * 256).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), d).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, keep: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores among ``keep``, ties to the smaller id."""
    if len(keep) > k:
        least = np.partition(score[keep], len(keep) - k)[len(keep) - k]
        keep = keep[score[keep] >= least]
    return keep[np.lexsort((ids[keep], -score[keep]))[:k]]


_FOUND = "anchor_row long, positive_row long, row long, vec_id long, score long"


def _scan(moduli: list[int], pick):
    """A block of rows (``right``) against a portion of the anchors (``left``)."""

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in ("anchor_row", "positive_row", "row", "vec_id", "score")}
        if left.num_rows and right.num_rows:
            d = left["d"][0].as_py()
            a, b = _matrix(left["v"], d), _matrix(right["their_v"], d)
            ids, labels, rows = (right[f"their_{c}"].to_numpy() for c in ("id", "label", "row"))
            anchors = left.drop_columns(["v"]).to_pylist()
            for at in range(0, len(anchors), _STEP):
                scores = residue_product(a[at:at + _STEP], b, moduli)
                for anchor, score in zip(anchors[at:at + _STEP], scores):
                    for positive, places in pick(anchor, score, ids, labels, rows):
                        out["anchor_row"] += [anchor["row"]] * len(places)
                        out["positive_row"] += [positive] * len(places)
                        out["row"] += rows[places].tolist()
                        out["vec_id"] += ids[places].tolist()
                        out["score"] += score[places].tolist()
        return pa.table(out, pa.schema([(c, pa.int64()) for c in out]))

    return scan


def mine(table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
         vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``vec_id``. A row's score is its integer
    inner product with the anchor. An anchor's positives are its ``positives``
    best other rows of the same label; a positive's negatives are its
    ``negatives`` best rows of other labels whose score lies between ``least``
    and ``most`` percent of the positive's. Ties go to the smaller vec_id; rank
    counts from 1. Rows without an id or a label, and vectors that are null,
    hold a null or non-finite component or have scores beyond a long take no
    part. Rows that repeat an id are rows of their own, also as anchors. Only
    vectors of the same length are compared. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = materialize(vectors(table, vec_id, vector, label).withColumn("row", F.monotonically_increasing_id())
                       .withColumn("d", F.size("v")), "vectors")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0))).first()
    anchors = rows.filter(is_anchor)
    moduli = primes(2 * longest + 1)  # Cauchy-Schwarz: no score is larger than the longest vector's own
    blocks, portions = max(1, -(-n // BLOCK_ROWS)), max(1, -(-anchors.count() // ANCHORS_AT_ONCE))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    block, portion = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(portions)).cast("int")
    # names of their own: both sides of the cogroup come from one table
    theirs = ["their_d", "their_block", "their_portion", "their_row", "their_id", "their_label", "their_v"]
    all_rows = rows.select("d", block, every(portions), "row", "vec_id", "label", "v").toDF(*theirs)

    def meet(asking: DataFrame, pick) -> DataFrame:
        asking = asking.withColumn("portion", portion).withColumn("block", every(blocks))
        return asking.groupBy("d", "block", "portion").cogroup(all_rows.groupBy(*theirs[:3])).applyInArrow(_scan(moduli, pick), _FOUND)

    def first(found: DataFrame, k: int, *by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row"))
        return found.withColumn("rank", place).filter(F.col("rank") <= k)

    def same_label(anchor, score, ids, labels, places):
        yield None, _best(score, ids, np.flatnonzero((labels == anchor["label"]) & (places != anchor["row"])), positives)

    near = materialize(first(meet(anchors, same_label), positives, "anchor_row").select(
        "anchor_row", F.col("row").alias("positive_row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    def in_window(anchor, score, ids, labels, places):
        other = np.flatnonzero(labels != anchor["label"])
        for p in anchor["asks"]:
            # whole numbers between the percentages, rounded inwards, so that nothing overflows
            low, high = -(-least * p["positive_score"] // 100), most * p["positive_score"] // 100
            yield p["positive_row"], _best(score, ids, other[(score[other] >= low) & (score[other] <= high)], negatives)

    asks = near.groupBy("anchor_row").agg(F.collect_list(F.struct("positive_row", "positive_score")).alias("asks"))
    found = first(meet(anchors.join(asks, anchors["row"] == asks["anchor_row"]).drop("anchor_row"), in_window), negatives, "anchor_row", "positive_row")
    named = found.join(near, ["anchor_row", "positive_row"]).join(anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
