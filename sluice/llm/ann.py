"""Approximate nearest neighbours on shifted space-filling curves (operator 1).

Vectors are lifted so that the largest inner product becomes the smallest
distance, rotated at random, shifted and put on a Hilbert curve, once per
curve. Spark range-partitions each ordering; a row's place in it is its rank.
A query looks at the ranks within ``reach`` of its own on every curve; the
windows merge and exact scores rerank them.

``reach`` is measured, not guessed: for a bounded sample of queries the true
neighbours are found by brute force over all rows, and ``reach`` is what brings
the wanted share of them into a window of one of the curves. It is small where
neighbours lie close on a curve, and the fewer of the curves are used for which
that takes the least comparing. On vectors without structure it grows with the
table, up to a scan in blocks, and the result stays right.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, share_of

CURVES = 4
DIMENSIONS = 8
BITS = 7
#: Bounds of the samples: vectors that fit the grid, queries that measure reach.
FIT_ROWS = 5_000
PROBES = 64
#: Share of the probes' true neighbours that must lie in a window.
RECALL = 0.95
BLOCK = 4096
QUERIES_AT_ONCE = 2048
_SEED = 7


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells (rows x dimensions), dimensions * bits <= 63."""
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations of each quadrant, from the coarsest
        low = np.uint32(q - 1)
        for i in range(n):
            turned = (x[i] & np.uint32(q)) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(turned, low, swap).astype(np.uint32)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & np.uint32(q), np.uint32(q - 1), np.uint32(0)).astype(np.uint32)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> np.uint32(b)) & 1).astype(np.int64)
    return key


@dataclass(frozen=True)
class Grid:
    """Rotations and the box of each projected axis, for every curve."""

    rotations: np.ndarray  # curves x dimensions x (d + 1)
    low: np.ndarray
    step: np.ndarray
    norm: float  # the largest norm

    def lift(self, v: np.ndarray, query: bool) -> np.ndarray:
        """On the sphere of radius ``norm``, where the nearest point has the largest product."""
        size = np.sqrt((v * v).sum(axis=1, keepdims=True))
        if query:
            return np.hstack([v * (self.norm / size), np.zeros_like(size)])
        return np.hstack([v, np.sqrt(np.maximum(self.norm ** 2 - size ** 2, 0))])

    def keys(self, v: np.ndarray, query: bool) -> np.ndarray:
        top = (1 << BITS) - 1
        lifted = self.lift(v, query)
        return np.stack([hilbert(np.clip((lifted @ r.T - lo) / st, 0, top).astype(np.int64), BITS)
                         for r, lo, st in zip(self.rotations, self.low, self.step)])


def usable(vec_id: Column, vector: Column) -> Column:
    """Rows that take part: an id, and a vector that is not null, zero or partly null or not finite."""
    def finite(x):
        return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))

    return vec_id.isNotNull() & vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def clean(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, v`` of the usable rows; rows that repeat an id are rows of their own."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.filter(usable(F.col("vec_id"), F.col("v")))


def _matrix(column, d: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()].reshape(-1, d)


def fit(rows: DataFrame, d: int, curves: int) -> Grid:
    """Rotations at random; boxes from at most about ``FIT_ROWS`` vectors; the norm from all."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, norm = rows.agg(F.count("*"), F.max(F.sqrt(square))).first()
    sample = rows.filter(share_of(F.xxhash64("row"), F.lit(min(1.0, FIT_ROWS / n)))).select("v").collect()
    points = np.array([r["v"] for r in sample] or [np.ones(d)], float)
    rng = np.random.default_rng(_SEED)
    m = min(DIMENSIONS, d + 1)
    rotations = np.stack([np.linalg.qr(rng.standard_normal((d + 1, d + 1)))[0][:m] for _ in range(curves)])
    grid = Grid(rotations, np.zeros((curves, m)), np.ones((curves, m)), norm)
    lifted = grid.lift(points, False)
    spread = np.stack([np.quantile(lifted @ r.T, [0.005, 0.995], axis=0) for r in rotations])
    low, width = spread[:, 0], np.maximum(spread[:, 1] - spread[:, 0], 1e-12)
    shift = rng.random(low.shape) / 3  # of the box, which grows by as much
    return Grid(rotations, low - shift * width, width * 4 / 3 / (1 << BITS), norm)


def place(rows: DataFrame, queries: Column, grid: Grid, d: int) -> DataFrame:
    """``curve, kind, row, vec_id, v, rank``: every row on every curve (kind 1), queries once more (kind 0).

    Rank counts along all orderings. It comes from the places inside the
    range partitions and the partitions' sizes, which are all that the driver
    sees; copies of one vector spread over partitions by their row.
    """
    curves = len(grid.rotations)

    def put(batches):
        for batch in batches:
            v = _matrix(batch.column(2), d)
            for query, kind in ((False, 1), (True, 0)):
                own = batch if not query else batch.filter(batch.column(3))
                if not own.num_rows:
                    continue
                keys = grid.keys(v if not query else _matrix(own.column(2), d), query)
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(own.num_rows, c, np.int32)), pa.array(np.full(own.num_rows, kind, np.int32)),
                        pa.array(keys[c]), own.column(0), own.column(1), own.column(2)], names=["curve", "kind", "key", "row", "vec_id", "v"])

    keyed = rows.select("row", "vec_id", "v", queries.alias("query")).mapInArrow(
        put, "curve int, kind int, key long, row long, vec_id long, v array<double>")
    order = ["curve", "key", "kind", "row"]
    placed = materialize(keyed.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("seat", F.monotonically_increasing_id()), "curves")
    part = F.shiftright("seat", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts = np.concatenate([[0], np.cumsum([r["n"] for r in sizes])]).tolist()
    begin = rows.sparkSession.createDataFrame([(r["part"], s) for r, s in zip(sizes, starts)], "part long, begin long")  # a row a partition
    return placed.withColumn("part", part).join(F.broadcast(begin), "part").select(
        "curve", "kind", "row", "vec_id", "v", (F.col("begin") + F.col("seat").bitwiseAND((1 << 33) - 1)).alias("rank"))


_FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def _best(rows: np.ndarray, ids: np.ndarray, v: np.ndarray, query_rows: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int,
          least: np.ndarray | None = None) -> pd.DataFrame:
    """The k best of ``v`` for each query, by exact score and id, without the query's own row.

    ``least`` holds, per query, a score below which nothing can be in the result.
    """
    rough = q @ v.T
    rough[query_rows[:, None] == rows[None, :]] = -np.inf
    out = []
    for i in range(len(q)):
        line = rough[i]
        floor = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else -np.inf
        # the rough product may differ in its last bits from block to block: all that may tie are scored anew
        margin = 1e-12 * float(np.sqrt((q[i] * q[i]).sum())) * float(np.abs(line[np.isfinite(line)]).max(initial=1.0)) + 1e-12
        if least is not None:
            floor = max(floor, least[i])
        near = np.flatnonzero((line >= floor - margin) & (line > -np.inf))
        score = (v[near] * q[i]).sum(axis=1)
        if least is not None:
            near, score = near[score >= least[i]], score[score >= least[i]]
        pick = np.lexsort((rows[near], ids[near], -score))[:k]
        out.append(pd.DataFrame({"query_row": query_rows[i], "query_id": query_ids[i], "row": rows[near][pick], "vec_id": ids[near][pick], "score": score[pick]}))
    return pd.concat(out) if out else _nothing()


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in ("query_row", "query_id", "row", "vec_id", "score")})


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def brute_force(rows: DataFrame, probes: list, d: int, k: int) -> DataFrame:
    """The true neighbours of at most about ``PROBES`` queries, over all rows in blocks."""
    own, ids = (np.array([p[c] for p in probes], np.int64) for c in ("row", "vec_id"))
    q = np.array([p["v"] for p in probes], float).reshape(-1, d)

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                best = _best(batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), d), own, ids, q, k)
                yield pa.RecordBatch.from_pandas(best.astype({c: "float64" if c == "score" else "int64" for c in best}), preserve_index=False)

    return _top(rows.select("row", "vec_id", "v").mapInArrow(scan, _FOUND), k)


def measure_reach(rows: DataFrame, placed: DataFrame, is_query: Column, d: int, k: int, recall: float, curves: int) -> tuple[int, int]:
    """``(curves, reach)``: how many curves, and the half-width in ranks, for the least comparing that holds ``recall`` of the probes' true neighbours."""
    n = rows.filter(is_query).count()
    probes = rows.filter(is_query & share_of(F.xxhash64("row", F.lit(1)), F.lit(min(1.0, PROBES / max(n, 1))))).collect()
    if not probes:
        probes = rows.filter(is_query).orderBy("row").limit(1).collect()
    truth = brute_force(rows, probes, d, k).select("query_row", "row")
    here = placed.filter("kind = 0").select("curve", F.col("row").alias("query_row"), F.col("rank").alias("at"))
    there = placed.filter("kind = 1").select("curve", "row", "rank")
    apart = (truth.join(here, "query_row").join(there, ["curve", "row"])
             .select("query_row", "row", "curve", F.abs(F.col("rank") - F.col("at")).alias("apart")).collect())
    if not apart:
        return 1, 1
    pairs = {p: i for i, p in enumerate(sorted({(r["query_row"], r["row"]) for r in apart}))}
    gaps = np.full((len(pairs), curves), np.iinfo(np.int64).max)
    for r in apart:
        gaps[pairs[r["query_row"], r["row"]], r["curve"]] = r["apart"]
    at = min(len(gaps) - 1, int(np.ceil(recall * len(gaps))) - 1)
    reach = [int(np.sort(gaps[:, :m].min(axis=1))[at]) + 1 for m in range(1, curves + 1)]
    total = rows.count()
    work = [m * min(2 * r + BLOCK, total) for m, r in enumerate(reach, 1)]
    m = int(np.argmin(work)) + 1
    return m, reach[m - 1]


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def other_lengths(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """Neighbours among the vectors of rare lengths, length by length: all of them, in blocks."""
    n, asked = rows.count(), rows.filter(is_query).count()
    blocks, portions = max(1, -(-n // BLOCK)), max(1, -(-asked // QUERIES_AT_ONCE))
    left = rows.filter(is_query).select(F.size("v").alias("d"), F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"),
                                        F.pmod(F.xxhash64("row"), F.lit(portions)).alias("portion"), _every(blocks).alias("block"))
    right = rows.select(F.size("v").alias("dim"), "row", "vec_id", "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("in_block"), _every(portions).alias("for_portion"))

    def compare(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return _nothing()
        return _best(held["row"].to_numpy(), held["vec_id"].to_numpy(), np.stack(held["v"].to_numpy()), asking["query_row"].to_numpy(),
                     asking["query_id"].to_numpy(), np.stack(asking["q"].to_numpy()), k)

    found = left.groupBy("d", "block", "portion").cogroup(right.groupBy("dim", "in_block", "for_portion")).applyInPandas(compare, _FOUND)
    return _top(found, k)


def search(table: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
           curves: int = CURVES, recall: float = RECALL) -> DataFrame:
    """The ``k`` rows with the largest inner product to each query row, of those found.

    ``is_query`` is a condition on ``vec_id``. Returns ``query_id, rank,
    vec_id, score``: rank from 1, ties to the smaller id, scores in double
    precision on the original vectors. A query is not its own neighbour; with
    fewer than ``k`` others all are returned. Rows that repeat an id are rows of
    their own, also as queries. Only vectors of one length have a product; those
    of other lengths than the commonest are searched whole, length by length.
    Rows without an id, and vectors that are null, zero or hold a null or
    non-finite component take no part; an empty table gives an empty result;
    other columns are ignored.
    """
    spark = table.sparkSession
    all_rows = materialize(clean(table, vec_id, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = all_rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = lengths[0]["d"]
    rows = all_rows.filter(F.size("v") == d)
    parts = [] if rows.filter(is_query).isEmpty() else [_on_curves(rows, is_query, d, k, curves, recall)]
    if len(lengths) > 1:
        parts.append(other_lengths(all_rows.filter(F.size("v") != d), is_query, k))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _on_curves(rows: DataFrame, is_query: Column, d: int, k: int, curves: int, recall: float) -> DataFrame:
    grid = fit(rows, d, curves)
    placed = place(rows, is_query, grid, d)
    used, reach = measure_reach(rows, placed, is_query, d, k, recall, curves)
    placed = placed.filter(F.col("curve") < used)
    asked = placed.filter("kind = 0")
    total, wanted = rows.count(), rows.filter(is_query).count()
    # queries that look at one block, in portions of bounded size
    portions = max(1, -(-int(wanted * min(1.0, (2 * reach + BLOCK) / total)) // QUERIES_AT_ONCE))
    home = F.floor(F.col("rank") / BLOCK)
    asked = materialize(asked.select("curve", F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), home.alias("home"),
                         F.floor((F.col("rank") - reach) / BLOCK).alias("from"), F.floor((F.col("rank") + reach) / BLOCK).alias("to"),
                         F.pmod(F.xxhash64("row"), F.lit(portions)).alias("portion")), "asked")
    there = placed.filter("kind = 1").select("curve", "row", "vec_id", "v", home.alias("block"), _every(portions).alias("portion"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _nothing()
        v = np.stack(right["v"].to_numpy())
        held, ids = right["row"].to_numpy(), right["vec_id"].to_numpy()
        own, names, least = (left[c].to_numpy() for c in ("query_row", "query_id", "least"))
        q = np.stack(left["q"].to_numpy())
        return pd.concat([_best(held, ids, v, own[i:i + 256], names[i:i + 256], q[i:i + 256], k, least[i:i + 256]) for i in range(0, len(q), 256)])

    def look(queries: DataFrame) -> DataFrame:
        keys = ["curve", "block", "portion"]
        return queries.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(compare, _FOUND)

    def once(found: DataFrame) -> DataFrame:
        return found.groupBy("query_row", "row").agg(F.max("score").alias("score"), F.first("query_id").alias("query_id"), F.first("vec_id").alias("vec_id"))

    # first the query's own block on every curve; its k-th score is a floor for all others
    near = _top(once(look(asked.withColumn("block", F.col("home")).withColumn("least", F.lit(float("-inf"))))), k)
    near = materialize(near.select("query_row", "query_id", "row", "vec_id", "score"), "near")
    least = near.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select("query_row", "least")
    others = (asked.join(least, "query_row", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
              .withColumn("block", F.explode(F.sequence("from", "to"))).filter("block <> home"))
    return _top(once(near.unionByName(look(others))), k)
