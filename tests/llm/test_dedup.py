import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest
import xxhash

from sluice.llm import exact_dedup, simhash
from sluice.llm.components import connected

from .helpers import doc_frame, doc_rows, sentence


def brute_fingerprint(text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance=3):
    """Smallest index of each index's component, by flooding."""
    left, out = set(range(len(prints))), {}
    while left:
        start = min(left)
        left.discard(start)
        todo = [start]
        while todo:
            i = todo.pop()
            out[i] = start
            near = [j for j in left if bin(prints[i] ^ prints[j]).count("1") <= distance]
            left.difference_update(near)
            todo += near
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("crowd", [64, 3])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    prints = [0, (1 << 64) - 1]
    for _ in range(12):
        seed = rng.getrandbits(64)
        prints.append(seed)
        for _ in range(30):  # clusters with distances around the limit, and within one block
            prints.append(rng.choice(prints[-5:]) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
        prints += [seed ^ sum(1 << b for b in rng.sample(range(20), 3)) for _ in range(10)]
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(3)
    # the module is imported by name in the workers, so the crowd limit goes along as data
    found = simhash.links(frame).collect()
    edges = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in found]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in edges)
    at = {p: i for i, p in enumerate(prints)}
    reach = list(range(len(prints)))

    def root(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for a, b in edges:
        x, y = sorted((root(at[a]), root(at[b])))
        reach[y] = x
    want = brute_components(prints)
    assert [root(i) for i in range(len(prints))] == [want[i] for i in range(len(prints))]


def test_crowds_are_linked_without_pairs(spark):
    seed = 0x0123456789ABCDEF
    rng = random.Random(2)
    # one crowd: a cube of 9 bits inside one block
    cube = sorted({seed ^ sum(1 << b for b in range(9) if v >> b & 1) for v in range(512)} | {rng.getrandbits(64) for _ in range(20)})
    frame = spark.createDataFrame([(signed(p),) for p in cube], "fp long")
    roots = connected(simhash.links(frame))
    sizes = sorted(r["count"] for r in roots.groupBy("root").count().collect())
    assert sizes == [512]


def crowd_of(rng):
    """Fingerprints far and near: a seed with its neighbours at one to four bits, and strangers."""
    prints = {0, (1 << 64) - 1} | {rng.getrandbits(64) for _ in range(10)}
    for _ in range(3):
        seed = rng.getrandbits(64)
        prints |= {seed ^ sum(1 << b for b in rng.sample(range(64), n)) for n in (0, 1, 2, 3, 4) for _ in range(6)}
    return sorted(prints)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_crowd_links_are_stars_on_the_nearest(spark, distance):
    prints = crowd_of(random.Random(distance))
    far, near = (distance + 1) // 2, distance // 2
    met = defaultdict(list)
    for p in prints:
        for n in range(far + 1):
            for bits in itertools.combinations(range(64), n):
                met[p ^ sum(1 << b for b in bits)].append((n, signed(p)))
    want = set()
    for runs in met.values():
        least, hub = min(runs)
        if least <= near:
            want |= {(hub, p) for _, p in runs if p != hub}
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(5)
    found = [(r["a"], r["b"]) for r in simhash.crowd_links(frame, distance).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_crowd_links_run_on_over_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    frame = spark.createDataFrame([(signed(p),) for p in crowd_of(random.Random(4))], "fp long").repartition(5)
    want = {tuple(r) for r in simhash.crowd_links(frame).collect()}
    try:
        spark.conf.set(name, "500")
        assert want and {tuple(r) for r in simhash.crowd_links(frame).collect()} == want
    finally:
        spark.conf.set(name, before)


def test_crowds_are_not_broadcast(spark, tmp_path):
    """A crowd is a small file; its balls are 2,081 times as many rows and must not go to the driver."""
    prints = crowd_of(random.Random(6))
    spark.createDataFrame([(signed(p),) for p in prints], "fp long").write.parquet(str(tmp_path / "crowd"))
    links = simhash.crowd_links(spark.read.parquet(str(tmp_path / "crowd")))
    assert links.count()
    assert "Broadcast" not in links._jdf.queryExecution().toString()


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(9)
    rows = doc_rows()
    body = sentence(rng, 400)
    rows += [(300 + i, " ".join(w if rng.random() > 0.004 else w + "q" for w in body.split()), "en", "s") for i in range(30)]
    got = [(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"], r["row_id"] == r["keep_row"])
           for r in simhash.near_duplicates(doc_frame(spark, rows)).collect()]
    prints = [brute_fingerprint(t) for _, t, _, _ in rows]
    group = brute_components(prints)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[group[i]] = min(d, least.get(group[i], d))
    want = [(rows[i][0], prints[i], least.get(group[i])) for i in range(len(rows))]
    order = lambda x: (x[1], x[0] is None, x[0] or 0)
    assert sorted((g[:3] for g in got), key=order) == sorted(want, key=order)
    assert sum(g[3] for g in got) == len(set(group.values()))


def test_chunks_rebuild_texts_and_resync():
    rng = random.Random(1)
    data = " ".join(sentence(rng, 20000).split()).encode()
    parts = exact_dedup.chunks(data)
    assert b"".join(parts) == data and len(parts) > 10
    assert max(map(len, parts)) <= exact_dedup.MOST
    moved = exact_dedup.chunks(b"some words in front " + data)
    assert len(set(parts) & set(moved)) >= len(parts) - 2
    assert exact_dedup.chunks(b"") == [] and exact_dedup.chunks(b"x") == [b"x"]
    flat = b"a" * 200_000
    assert b"".join(exact_dedup.chunks(flat)) == flat


@pytest.mark.parametrize("clash", [False, True])
def test_exact_dedup_matches_brute_force(spark, monkeypatch, clash):
    if clash:  # every chunk gets one of two hashes, so only the verified ordinals tell texts apart
        monkeypatch.setattr(exact_dedup, "hashed", lambda chunk: exact_dedup.F.pmod(exact_dedup.F.xxhash64(chunk), exact_dedup.F.lit(2)))
    rows = doc_rows()
    got = [tuple(r)[:5] for r in exact_dedup.deduplicate(doc_frame(spark, rows)).collect()]
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    want, kept = [], 0
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = min(known) if known else None
        want += [(d, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    order = lambda x: (x[-1], x[0] is None, x[0] or 0)
    assert sorted(((a, b, c, e) for a, b, c, _, e in got), key=order) == sorted(want, key=order)
    kept = [(a, b, e) for a, b, _, k, e in got if k]
    assert len(kept) == len({e for *_, e in kept}) == len(groups) and all(a == b for a, b, _ in kept)


def test_empty_tables(spark):
    empty = doc_frame(spark, [])
    assert exact_dedup.deduplicate(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
