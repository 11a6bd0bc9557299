"""Cache upsert and exact top-k cosine search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from sluice.operators import cache as H


def test_upsert_newest_write_wins_ties_on_id(spark):
    rows = [(1, "k", "v1", "2024-01-01 00:00:00"), (2, "k", "v2", "2024-01-02 00:00:00"),
            (3, "k", "v3", "2024-01-02 00:00:00"), (4, "j", "w", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id long, cache_key string, value string, created_at string") \
        .selectExpr("id", "cache_key", "value", "CAST(created_at AS TIMESTAMP_NTZ) AS created_at")
    got = {r.cache_key: r.value for r in H.cache_upsert(df).collect()}
    assert got == {"k": "v3", "j": "w"}


def test_similar_entries_equals_brute_force(spark):
    rnd = np.random.default_rng(3)
    ent = rnd.normal(size=(300, 8)).astype(np.float32)
    ent[50:60] = ent[10]                      # exact ties, broken by id
    qs = rnd.normal(size=(40, 8)).astype(np.float32)
    qs[0] = ent[10]
    e_df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(ent)],
                                 "entry_id long, embedding array<float>").repartition(7)
    q_df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(qs)],
                                 "query_id long, embedding array<float>")
    got = {}
    for r in H.similar_entries(q_df, e_df, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.entry_id))
    e = ent.astype(np.float64) / np.linalg.norm(ent.astype(np.float64), axis=1, keepdims=True)
    for qi, q in enumerate(qs.astype(np.float64)):
        s = np.round(e @ (q / np.linalg.norm(q)), 9)
        order = sorted(range(len(s)), key=lambda i: (-s[i], i))[:5]
        assert sorted(got[qi]) == [(k + 1, i) for k, i in enumerate(order)], qi
    assert [i for _, i in sorted(got[0])] == [10, 50, 51, 52, 53]


def _walk(rows, ttl):
    """Python restatement of the TTL walk: rows (id, key, t_hours) → {id: hit}."""
    out, fill = {}, {}
    for rid, key, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if key in fill and t < fill[key] + ttl:
            out[rid] = True
        else:
            fill[key] = t
            out[rid] = False
    return out


def test_ttl_replay_matches_walk_for_any_bucket_width(spark):
    import datetime as dt
    import random

    rnd = random.Random(5)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 20)}"     # one key holds a third
        rows.append((i, key, rnd.randint(0, 24 * 20) + rnd.choice([0, 0.5])))
    rows.append((600, "k1", 10.0))
    rows.append((601, "k1", 10.0))                                  # tie on time, broken by id
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, k, base + dt.timedelta(hours=h)) for i, k, h in rows],
                               "id long, cache_key string, created_at timestamp_ntz")
    want = _walk(rows, 24)
    for bucket, rows_a_bucket in ((None, 200_000), (1, 200_000), (7.5, 5), (100, 9)):
        got = {r.id: r.hit for r in H.ttl_replay(df, 24, bucket_hours=bucket, rows_a_bucket=rows_a_bucket).collect()}
        assert got == want, bucket


def test_similar_entries_keep_all_neighbours_beside_infinite_vectors(spark):
    kind = "entry_id long, embedding array<double>"
    rows = [(i, [1.0, i / 10]) for i in range(7)] + [(7, [float("inf"), 1.0]), (8, [1e300, 1e300]), (9, [1.0])]
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("-inf"), 0.0]), (3, [2.0])], "query_id long, embedding array<double>")
    got = [(r.query_id, r.entry_id) for r in H.similar_entries(queries, spark.createDataFrame(rows, kind), k=5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (3, 9)]
    assert H.similar_entries(queries, spark.createDataFrame([], kind)).count() == 0
    assert H.similar_entries_lsh(queries, spark.createDataFrame([], kind)).count() == 0


def test_similar_entries_in_blocks_equal_one_block(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rnd.integers(-2, 3, (200, 3)).astype(float))], "entry_id long, embedding array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rnd.integers(-2, 3, (50, 3)).astype(float))], "query_id long, embedding array<double>")
    want = sorted(map(tuple, H.similar_entries(q, e, k=7).collect()))
    monkeypatch.setattr(H, "ENTRIES_A_BLOCK", 23)
    monkeypatch.setattr(H, "QUERIES_A_PORTION", 11)
    assert sorted(map(tuple, H.similar_entries(q, e, k=7).collect())) == want


def _clustered(n, seed, size=20, d=32):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(n // size, d))
    return centres[np.arange(n) % len(centres)] + 0.15 * rnd.normal(size=(n, d))


def test_hash_tables_follow_size_and_nearness():
    shapes = [H.hash_tables(n, 0.3, 0.95) for n in (10**3, 10**6, 10**9)]
    assert [b for _, b in shapes] == sorted({b for _, b in shapes})          # bits grow with the logarithm of the table
    for n, (tables, bits) in zip((10**3, 10**6, 10**9), shapes):
        assert 1 - (1 - H.collision(0.3, H.BUCKET_WIDTH) ** bits) ** tables >= 0.95
        assert n * H.collision(2 ** 0.5, H.BUCKET_WIDTH) ** bits <= H.ENTRIES_IN_BUCKET
    assert H.hash_tables(10**9, 0.6, 0.95)[1] < shapes[2][1]                  # far neighbours: fewer bits, larger buckets
    assert H.hash_tables(10**9, 1.3, 0.95) is None                            # hardly nearer than strangers: a scan
    # the chance itself, against draws
    rnd = np.random.default_rng(1)
    x, shift = rnd.normal(size=200_000) * 0.7, rnd.random(200_000) * 1.2
    assert abs(np.mean(np.floor((x + shift) / 1.2) == 0) - H.collision(0.7, 1.2)) < 0.01


def test_lsh_recall_and_candidates(spark, monkeypatch):
    """On clustered vectors: recall of 0.9 or more, and looked-at entries a query that do not grow with the table."""
    import pyarrow as pa

    looked = {}
    for n in (1000, 4000):
        v = _clustered(n, n)
        e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "entry_id long, embedding array<double>")
        q = e.where("entry_id % 20 = 0").withColumnRenamed("entry_id", "query_id")
        want = {(r.query_id, r.entry_id) for r in H.similar_entries(q, e, k=5).collect()}
        monkeypatch.setattr(H, "ENTRIES_IN_BUCKET", 32)
        got = {(r.query_id, r.entry_id) for r in H.similar_entries_lsh(q, e, k=5).collect()}
        assert len(got & want) >= 0.9 * len(want), n

        def count(k, digits):
            def pairs(queries: pa.Table, entries: pa.Table) -> pa.Table:
                return pa.table({"query_id": [0], "entry_id": [0], "score": [float(queries.num_rows * entries.num_rows)]})
            return pairs

        shape = H.hash_tables(n, H._nearness(H._unit_vectors(q, "query_id").withColumnRenamed("v", "q"), n // 20, H._unit_vectors(e, "entry_id").withColumnRenamed("v", "e"), 5), 0.95)
        with monkeypatch.context() as patch:
            patch.setattr(H, "_score_block", count)
            patch.setattr(H, "_ranked", lambda found, k: found)
            patch.setattr(H, "_search_buckets", lambda a, h, k, digits, f=H._search_buckets: f(a, h, k, digits).groupBy("query_id", F.monotonically_increasing_id().alias("entry_id")).agg(F.sum("score").alias("score")))
            looked[n] = H.similar_entries_lsh(q, e, k=5, shape=shape).agg({"score": "sum"}).first()[0] / (n // 20)
    assert looked[4000] <= 2.5 * looked[1000], looked
    assert looked[4000] <= 0.5 * 4000, looked


def test_lsh_hot_bucket_is_dealt_out(spark, monkeypatch):
    """A third of the entries are one vector, another third lie in its bucket: the same result in pieces."""
    rnd = np.random.default_rng(2)
    v = np.vstack([np.ones((100, 8)), np.ones((100, 8)) + 0.01 * rnd.normal(size=(100, 8)), rnd.normal(size=(100, 8))])
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "entry_id long, embedding array<double>")
    q = e.where("entry_id % 5 = 0").withColumnRenamed("entry_id", "query_id")
    whole = sorted(map(tuple, H.similar_entries_lsh(q, e, k=5, shape=(6, 3)).collect()))
    monkeypatch.setattr(H, "ENTRIES_A_BLOCK", 10)
    monkeypatch.setattr(H, "QUERIES_A_PORTION", 7)
    assert sorted(map(tuple, H.similar_entries_lsh(q, e, k=5, shape=(6, 3)).collect())) == whole
    exact = {(r.query_id, r.rank, r.entry_id) for r in H.similar_entries(q, e, k=5).collect() if r.query_id < 100}
    assert exact <= {(r[0], r[3], r[1]) for r in whole}


def _lookup_at(requests, writes):
    out = {}
    for rid, key, t in requests:
        before = [w for w in writes if w[1] == key and key is not None and t is not None and w[3] <= t]
        w = max(before, key=lambda w: (w[3], w[0]), default=None)
        out[rid] = w[0] if w and w[4] > t else None
    return out


def test_lookup_at_matches_plain_walk_for_any_bucket(spark):
    import datetime as dt
    import random

    rnd = random.Random(9)
    base = dt.datetime(2024, 1, 1)

    def at(h):
        return base + dt.timedelta(hours=h)

    def key(i):
        return "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c", "d", "e"])

    writes = [(i, key(i), f"v{i}", at(x := rnd.randint(0, 300) / 2), at(x + rnd.choice([1, 5, 30]))) for i in range(300)]
    requests = [(i, key(i), at(rnd.randint(-10, 400) / 2)) for i in range(400)] + [(900, None, at(1)), (901, "hot", None), (902, "never", at(5))]
    r = spark.createDataFrame(requests, "request_id long, cache_key string, requested_at timestamp_ntz")
    w = spark.createDataFrame(writes, "id long, cache_key string, value string, created_at timestamp_ntz, expires_at timestamp_ntz")
    want = _lookup_at(requests, writes)
    for hours, rows in ((24, 200_000), (24, 7), (3, 20), (10_000, 11)):
        got = {x.request_id: x.entry_id for x in H.cache_lookup_at(r, w, bucket_hours=hours, rows_a_bucket=rows).collect()}
        assert got == want, (hours, rows)
    assert H.cache_lookup_at(r, w.limit(0)).where("hit").count() == 0 and H.cache_lookup_at(r.limit(0), w).count() == 0


def test_hot_key_is_cut_into_buckets(spark):
    """One key and one hour with all rows: no (key, bucket) holds more than a few times the limit."""
    from sluice.operators.timeline import Buckets

    rows = spark.range(20_000).selectExpr("'hot' AS k", "id * 7 % 20000 AS t")
    dealt = Buckets(rows, "k", 3_600_000_000, 500).put(rows)
    sizes = [r["count"] for r in dealt.groupBy("k", "bucket").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) >= 30 and max(sizes) < 1500
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
