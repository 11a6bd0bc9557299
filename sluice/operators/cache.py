"""Cache operators over ``cache_entries(id, cache_key, cache_type, value,
vec_id | embedding, ttl_hours, hit_count, created_at, expires_at)``.

The table keeps several writes per key; the live table has one entry per
key, the newest write (ties broken on the larger id).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import ROWS_A_BUCKET, Buckets, last_before, micros


def _ts(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def cache_upsert(writes: DataFrame) -> DataFrame:
    """H2: one entry per key, the newest write wins.

    ``max_by`` over ``(created_at, id)`` is a partial aggregate: each map task
    keeps one candidate per key before the shuffle, so a key holding a third
    of all writes still sends one row per task.
    """
    cols = [c for c in writes.columns if c != "cache_key"]
    order = F.struct("created_at", "id")
    best = F.max_by(F.struct(*cols), order).alias("e")
    return writes.groupBy("cache_key").agg(best).select("cache_key", "e.*")


def cache_lookup(requests: DataFrame, entries: DataFrame, as_of: str) -> DataFrame:
    """H1: each request with the live entry of its key (``expires_at > as_of``).

    ``requests(request_id, cache_key)``; ``entries`` one row per key (H2).
    Output: request_id, cache_key, hit, entry_id, value.
    """
    live = (entries.where(F.col("expires_at") > _ts(as_of))
            .select("cache_key", F.col("id").alias("entry_id"), "value"))
    return (requests.select("request_id", "cache_key")
            .join(live, "cache_key", "left")
            .select("request_id", "cache_key", F.col("entry_id").isNotNull().alias("hit"),
                    "entry_id", "value"))


def cache_lookup_at(requests: DataFrame, writes: DataFrame, bucket_hours: float = 24,
                    rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """H1 in time: each request with the entry of its key that was live at the request's own time.

    That is the newest write at or before it (of one instant: the largest id),
    if it has not expired by then (``expires_at > requested_at``); an older
    write never comes back. ``requests(request_id, cache_key, requested_at)``,
    ``writes(id, cache_key, value, created_at, expires_at)``. Output:
    request_id, cache_key, requested_at, hit, entry_id, value. A request
    without a key or a time has no entry.

    An interval as-of join by buckets of time (``timeline``): neither a hot key
    nor a hot hour of it is one task.
    """
    asked = requests.select("request_id", "cache_key", "requested_at", micros("requested_at").alias("t"))
    timed = F.col("cache_key").isNotNull() & F.col("t").isNotNull()
    events = writes.select("cache_key", micros("created_at").alias("t"), F.col("id").alias("tie"),
                           "id", "value", "expires_at").where(timed)
    dealt = Buckets(asked.where(timed).select("cache_key", "t").unionByName(events.select("cache_key", "t")),
                    "cache_key", int(bucket_hours * 3600 * 1_000_000), rows_a_bucket)
    found = last_before(asked, events, "cache_key", F.struct("id", "value", "expires_at"), dealt, ["request_id", "requested_at"])
    live = F.col("found.expires_at") > F.col("requested_at")
    return found.select("request_id", "cache_key", "requested_at", F.coalesce(live, F.lit(False)).alias("hit"),
                        F.when(live, F.col("found.id")).alias("entry_id"), F.when(live, F.col("found.value")).alias("value"))


def cache_hits(lookups: DataFrame, entries: DataFrame) -> DataFrame:
    """H3: hits per key added to each entry's ``hit_count``.

    Hits are counted with a partial aggregate before the join, so the join
    sees one row per key.
    """
    hits = lookups.where(F.col("hit")).groupBy("cache_key").agg(F.count(F.lit(1)).alias("hits"))
    base = F.coalesce(F.col("hit_count"), F.lit(0)) if "hit_count" in entries.columns else F.lit(0)
    return (entries.join(hits, "cache_key", "left")
            .select("cache_key", F.col("id").alias("entry_id"),
                    (base + F.coalesce(F.col("hits"), F.lit(0))).cast("bigint").alias("hit_count")))


def cache_evict(entries: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """H4: ``(kept, counts)``: entries still live at ``as_of``, and per
    cache type the number of live and expired entries."""
    live = F.col("expires_at") > _ts(as_of)
    kept = entries.where(live)
    counts = entries.groupBy("cache_type").agg(
        F.count_if(live).cast("bigint").alias("live"),
        F.count_if(~live).cast("bigint").alias("expired"))
    return kept, counts


# Rows of a block of entries, queries that meet it in one task, and queries scored at once.
ENTRIES_A_BLOCK, QUERIES_A_PORTION, QUERIES_AT_ONCE = 8192, 2048, 128
_FOUND = "query_id long, entry_id long, score double"


def _unit_vectors(df: DataFrame, key: str) -> DataFrame:
    """``key, v``: the vectors that have a cosine, scaled to length 1.

    One that is null, zero, or holds a null, NaN or infinite component has none.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.select(F.col(key), v.alias("v")).where(F.col("v").isNotNull() & F.col(key).isNotNull())
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    def bind(value: Column, use) -> Column:
        """``use(value)`` with the value computed once, not for each component."""
        return F.transform(F.array(value), use)[0]

    # divided by the largest component first, so that no square overflows
    unit = bind(F.array_max(F.transform("v", F.abs)), lambda m: bind(
        F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / m) * (x / m))), lambda n: F.transform("v", lambda x: x / m / n)))
    return rows.select(key, unit.alias("v"))


def _score_block(k: int, digits: int):
    """The ``k`` best entries of a block for each query, by rounded score and id."""

    def score(queries, entries):
        import numpy as np
        import pyarrow as pa

        out = {"query_id": [], "entry_id": [], "score": []}
        if queries.num_rows and entries.num_rows:
            def matrix(column):
                return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

            ids, q_ids = entries["entry_id"].to_numpy(), queries["query_id"].to_numpy()
            e, q = matrix(entries["e"]), matrix(queries["q"])
            for at in range(0, len(q), QUERIES_AT_ONCE):
                scores = np.round(q[at:at + QUERIES_AT_ONCE] @ e.T, digits)
                for q_id, row in zip(q_ids[at:at + QUERIES_AT_ONCE], scores):
                    near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
                    near = near[np.lexsort((ids[near], -row[near]))[:k]]
                    out["query_id"].append(np.full(len(near), q_id))
                    out["entry_id"].append(ids[near])
                    out["score"].append(row[near])
        cut = {c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()}
        return pa.table({"query_id": pa.array(cut["query_id"].astype("int64")), "entry_id": pa.array(cut["entry_id"].astype("int64")),
                         "score": pa.array(cut["score"].astype("float64"))})

    return score


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("entry_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def similar_entries(queries: DataFrame, entries: DataFrame, k: int = 5, digits: int = 9) -> DataFrame:
    """H5: the ``k`` entries nearest by cosine to each query vector, exact.

    ``queries(query_id, embedding)``, ``entries(entry_id, embedding)``. Entries
    are dealt into blocks and queries into portions of bounded size by hash;
    each (block, portion) is one score matrix on an executor and gives ``k``
    rows a query, which a window merges: no (query, entry) pair becomes a row
    and nothing passes the driver but two counts. Order: score (rounded to
    ``digits``) descending, then entry id. Vectors that are null, zero or hold
    a null, NaN or infinite component take no part; only vectors of the same
    length are compared. The work is queries times entries; ``similar_entries_lsh``
    looks at a few entries only.
    """
    asked = _unit_vectors(queries, "query_id").withColumnRenamed("v", "q")
    held = _unit_vectors(entries, "entry_id").withColumnRenamed("v", "e")
    blocks = max(1, -(-held.count() // ENTRIES_A_BLOCK))
    portions = max(1, -(-asked.count() // QUERIES_A_PORTION))
    left = asked.select("query_id", "q", F.size("q").alias("d"), F.pmod(F.xxhash64("query_id"), F.lit(portions)).cast("int").alias("portion"),
                        _every(blocks).alias("block"))
    right = held.select("entry_id", "e", F.size("e").alias("dim"), F.pmod(F.xxhash64("entry_id"), F.lit(blocks)).cast("int").alias("in_block"),
                        _every(portions).alias("for_portion"))
    found = (left.groupBy("d", "block", "portion").cogroup(right.groupBy("dim", "in_block", "for_portion"))
             .applyInArrow(_score_block(k, digits), _FOUND))
    return _ranked(found, k)


#: Width of a hash bucket in standard deviations of a projection; entries wanted in a bucket; most tables and bits.
BUCKET_WIDTH, ENTRIES_IN_BUCKET, MOST_TABLES, MOST_BITS = 1.2, 256, 96, 24
#: Queries whose true neighbours tell how near neighbours are.
PROBES = 64


def collision(distance: float, width: float) -> float:
    """Chance that two points ``distance`` apart share a bucket of one projection (both in the same unit)."""
    if distance <= 0:
        return 1.0
    t = width / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def hash_tables(n: int, near: float, recall: float) -> tuple[int, int] | None:
    """``(tables, bits)`` that find neighbours at distance ``near`` with chance ``recall``.

    Bits grow with the logarithm of the number of entries, so that a bucket
    holds ``ENTRIES_IN_BUCKET`` unrelated ones whatever the table; where
    neighbours are too far for that, fewer bits keep the recall and buckets
    grow. None where the tables together would look at as much as a scan does:
    neighbours that are hardly nearer than strangers cannot be told by hashing.
    """
    far = collision(math.sqrt(2), BUCKET_WIDTH)
    for bits in range(min(MOST_BITS, max(1, math.ceil(math.log(max(n / ENTRIES_IN_BUCKET, 1)) / -math.log(far)))), 0, -1):
        found = collision(near, BUCKET_WIDTH) ** bits
        tables = 1 if found >= recall else math.ceil(math.log(1 - recall) / math.log(1 - found))
        if tables <= MOST_TABLES:
            return (tables, bits) if tables * far ** bits < 1 else None
    return None


def similar_entries_lsh(queries: DataFrame, entries: DataFrame, k: int = 5, digits: int = 9, recall: float = 0.95,
                        shape: tuple[int, int] | None = None, seed: int = 17) -> DataFrame:
    """H5 at scale: the nearest of the entries that share a hash bucket with the query.

    ``BucketedRandomProjectionLSH`` hashes the unit vectors; several of its
    projections together are the key of a table. How many tables and
    projections the wanted ``recall`` needs follows from the number of entries
    and from the true neighbours of at most about ``PROBES`` queries, unless
    ``shape`` (tables, bits) gives them. Equal entries are one candidate with
    their ``k`` smallest ids, and a bucket of many entries or queries is dealt
    into pieces, so that no bucket is one task and no pair becomes a row. Edge
    rows as in ``similar_entries``; each length of vectors has tables of its
    own. A query finds fewer than ``k`` entries if its buckets hold fewer.
    Where hashing would look at as much as a scan, the exact search answers.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    from ..session import checkpoint_dir

    checkpoint_dir(queries.sparkSession)
    asked = _unit_vectors(queries, "query_id").withColumnRenamed("v", "q").checkpoint()
    held = _unit_vectors(entries, "entry_id").withColumnRenamed("v", "e")
    # of equal entries only the first k by id can be in a result
    first = F.row_number().over(Window.partitionBy("e").orderBy("entry_id"))
    held = held.withColumn("place", first).where(F.col("place") <= k).drop("place").checkpoint()
    found = None
    for row in asked.groupBy(F.size("q").alias("d")).count().collect():  # lengths, not vectors
        n = held.where(F.size("e") == row["d"]).count()
        if not n:
            continue
        plan = shape or hash_tables(n, _nearness(asked.where(F.size("q") == row["d"]), row["count"], held, k), recall)
        if plan is None:
            scanned = similar_entries(asked.where(F.size("q") == row["d"]).withColumnRenamed("q", "embedding"),
                                      held.withColumnRenamed("e", "embedding"), k, digits).drop("rank")
            found = scanned if found is None else found.unionByName(scanned)
            continue
        tables, bits = plan
        hasher = BucketedRandomProjectionLSH(inputCol="_vector", outputCol="_hashes", numHashTables=tables * bits,
                                             bucketLength=BUCKET_WIDTH / math.sqrt(row["d"]), seed=seed)
        # draws the projections; of the data only the length counts
        model = hasher.fit(held.where(F.size("e") == row["d"]).limit(1).withColumn("_vector", array_to_vector("e")))

        def hashed(df: DataFrame, vector: str) -> DataFrame:
            """One row a table, with the key of its bucket."""
            own = df.where(F.size(vector) == row["d"]).withColumn("_vector", array_to_vector(vector))
            keys = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.xxhash64(t, F.slice("_hashes", t * bits + 1, F.lit(bits))))
            return model.transform(own).select(f"{'query' if vector == 'q' else 'entry'}_id", vector, F.explode(keys).alias("key"))

        part = _search_buckets(hashed(asked, "q"), hashed(held, "e"), k, digits)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.sparkSession.createDataFrame([], _FOUND + ", rank int")
    return _ranked(found.groupBy("query_id", "entry_id").agg(F.max("score").alias("score")), k)


def _nearness(asked: DataFrame, n: int, held: DataFrame, k: int) -> float:
    """Distance within which nine of ten true neighbours of a sample of the queries lie."""
    share = min(1.0, PROBES / n)
    probes = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    if share < 1 and probes.isEmpty():
        probes = asked.orderBy("query_id").limit(1)
    near = similar_entries(probes.withColumnRenamed("q", "embedding"), held.withColumnRenamed("e", "embedding"), k)
    cosine = near.agg(F.percentile_approx("score", 0.1, 1000)).first()[0]
    return math.sqrt(max(0.0, 2 - 2 * (1.0 if cosine is None else cosine)))


def _search_buckets(asked: DataFrame, held: DataFrame, k: int, digits: int) -> DataFrame:
    """The ``k`` best entries of each bucket for each query in it (``key`` on both sides)."""
    def pieces(df: DataFrame, most: int, name: str) -> DataFrame:
        return (df.groupBy(F.col("key").alias(f"{name}_key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
                .select(f"{name}_key", F.ceil(F.col("n") / most).cast("int").alias(name)))

    large, crowded = pieces(held, ENTRIES_A_BLOCK, "blocks"), pieces(asked, QUERIES_A_PORTION, "portions")

    def dealt(df: DataFrame) -> DataFrame:
        out = df.join(large, F.col("key") == F.col("blocks_key"), "left").join(crowded, F.col("key") == F.col("portions_key"), "left")
        return out.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("portions", F.coalesce("portions", F.lit(1)))

    def mine(id_column: str, count: str) -> Column:
        return F.pmod(F.xxhash64(id_column), F.col(count)).cast("int")

    def all_of(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = dealt(asked).select("query_id", "q", "key", mine("query_id", "portions").alias("portion"), all_of("blocks").alias("block"))
    right = dealt(held).select("entry_id", "e", F.col("key").alias("of_key"), mine("entry_id", "blocks").alias("in_block"), all_of("portions").alias("for_portion"))
    return (left.groupBy("key", "block", "portion").cogroup(right.groupBy("of_key", "in_block", "for_portion"))
            .applyInArrow(_score_block(k, digits), _FOUND))


# ------------------------------------------------------------------ H6

def _next_fill_candidates(req: DataFrame, ttl_us: int, dealt: Buckets) -> DataFrame:
    """For every request r: the first request s of the same key (by time, id)
    with ``t_s >= t_r + ttl``, as columns ``next_id``.

    An as-of lookup split by buckets of time so no key is handled whole by one
    task: (1) inside the target's bucket, probes and requests share a window
    partitioned by (key, bucket), walked newest first with a running
    ``last(ignorenulls)``; (2) otherwise the first request of the first later
    non-empty bucket, from a per-(key, bucket) minimum — one row per bucket.
    """
    cand = F.struct("t", "id")
    probes = req.select("cache_key", F.col("id").alias("probe_of"),
                        (F.col("t") + F.lit(ttl_us)).alias("t"), F.lit(0).alias("kind"),
                        F.lit(None).cast("bigint").alias("id"))
    rows = req.select("cache_key", F.lit(None).cast("bigint").alias("probe_of"), "t",
                      F.lit(1).alias("kind"), "id")
    both = dealt.put(probes.unionByName(rows))
    w = (Window.partitionBy("cache_key", "bucket")
         .orderBy(F.col("t").desc(), F.col("kind").desc(), F.col("id").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    in_bucket = (both.withColumn("hit", F.last(F.when(F.col("kind") == 1, cand), ignorenulls=True).over(w))
                 .where(F.col("kind") == 0)
                 .select("cache_key", "bucket", "probe_of", F.col("hit.id").alias("same_bucket_id")))
    all_buckets = both.groupBy("cache_key", "bucket").agg(F.min(F.when(F.col("kind") == 1, cand)).alias("first"))
    wb = (Window.partitionBy("cache_key").orderBy(F.col("bucket").desc())
          .rowsBetween(Window.unboundedPreceding, -1))
    later = all_buckets.withColumn("later", F.min("first").over(wb)) \
        .select("cache_key", "bucket", F.col("later.id").alias("later_id"))
    return (in_bucket.join(later, ["cache_key", "bucket"], "left")
            .select(F.col("probe_of").alias("id"),
                    F.coalesce("same_bucket_id", "later_id").alias("next_id")))


def ttl_replay(requests: DataFrame, ttl_hours: int = 24, bucket_hours: float | None = None,
               checkpoint_rounds: bool = True, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """H6: replay each key's requests in time order against a TTL cache.

    The first request of a key misses and fills the entry; a request before
    ``fill + ttl`` hits; the first one at or after it misses and refills.
    ``requests(id, cache_key, created_at)`` → adds ``hit``.

    Fills form a chain ``head → next(head) → …`` where ``next(r)`` is the
    first request at or after ``t_r + ttl``. ``next`` comes from a bucketed
    as-of lookup; chain membership from pointer doubling: after round k the
    reached set holds every chain node within 2^(k+1) - 1 steps of a head, so
    O(log n) joins on the request id (never on the key) finish the walk.
    Each round is checkpointed to the session's checkpoint folder. Buckets of
    more than ``rows_a_bucket`` requests are cut at quantiles of their times.
    """
    from ..session import checkpoint_dir

    ttl_us = int(ttl_hours * 3600 * 1_000_000)
    bucket_us = int((bucket_hours if bucket_hours else ttl_hours) * 3600 * 1_000_000)
    spark = requests.sparkSession
    if checkpoint_rounds:
        checkpoint_dir(spark)

    def cut(df):
        return df.checkpoint(eager=True) if checkpoint_rounds else df

    req = requests.select("id", "cache_key",
                          F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"))
    dealt = Buckets(req.select("cache_key", "t"), "cache_key", bucket_us, rows_a_bucket)
    jump = cut(_next_fill_candidates(req, ttl_us, dealt))            # (id, next_id)
    heads = req.groupBy("cache_key").agg(F.min(F.struct("t", "id")).alias("h")) \
        .select(F.col("h.id").alias("id"))
    reach = cut(heads)
    while True:
        live = jump.where(F.col("next_id").isNotNull())
        if live.isEmpty():
            break
        step = reach.join(live, "id").select(F.col("next_id").alias("id"))
        reach = cut(reach.unionByName(step).distinct())
        nxt = live.alias("a").join(live.alias("b"), F.col("a.next_id") == F.col("b.id")) \
            .select(F.col("a.id").alias("id"), F.col("b.next_id").alias("next_id"))
        jump = cut(nxt)
    fills = reach.withColumn("_fill", F.lit(True))
    return (requests.join(fills, "id", "left")
            .withColumn("hit", F.col("_fill").isNull()).drop("_fill"))
