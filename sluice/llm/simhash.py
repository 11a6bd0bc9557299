"""SimHash near-deduplication by meet-in-the-middle ball hashing (operator 2).

Two fingerprints at distance 3 or less differ in one of ``blocks`` blocks of
bits at least, if they differ at all. With that block left out, at most two
differing bits remain, so the two balls of half that radius, one bit, share a
variant. Every distinct fingerprint therefore emits, for each block left out,
all variants within one bit of the rest; the shuffle brings equal variants
together and full distances verify what collides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, values
from .components import connected

SHINGLE = 3
DISTANCE = 3
#: Blocks of which one is left out: 3 give 129 variants of 42 or 43 bits.
BLOCKS = 3
#: Fingerprints that share a variant are compared directly up to this many;
#: larger crowds go through ``crowd_links``, which is exact as well.
CROWD = 64
_BATCH = 4096


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash, unsigned: bit b is 1 if set in over half the shingle hashes."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both ASCII only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(parts) - shingle + 1)
    stops = ends[min(shingle, len(parts)) - 1:][:n] - 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts[at:at + (1 << 16)].tolist(), stops[at:at + (1 << 16)].tolist())), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long; null and wordless texts have 0."""

    @F.arrow_udf("long")
    def compute(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(x, shingle) for x in values(column)], np.uint64).view(np.int64))

    return compute(text)


def _masks(blocks: int) -> list[np.uint64]:
    """For each block, the bits that remain when it is left out."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    full = (1 << 64) - 1
    return [np.uint64(full & ~(((1 << (hi - lo)) - 1) << lo)) for lo, hi in zip(edges, edges[1:])]


def _variants(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for batch in batches:
        all_fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(all_fp), _BATCH):
            fp = all_fp[at:at + _BATCH]
            for block, mask in enumerate(_masks(blocks)):
                flips = np.concatenate([[np.uint64(0)], bits[(bits & mask) != 0]])
                keys = (fp & mask)[:, None] ^ flips[None, :]
                n = keys.size
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, block, np.int8)), pa.array(keys.reshape(-1).view(np.int64)),
                    pa.array(np.repeat(fp, len(flips)).view(np.int64))], names=["block", "variant", "fp"])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _runs(batches: Iterator[pa.RecordBatch], distance: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by (block, variant, fp), one run per variant.

    A run of up to ``limit`` rows gives its verified pairs. A longer run gives
    its rows back with ``b`` null. Only the batch and one run's first rows are
    in memory; a crowd is streamed.
    """
    held = np.empty((0, 3), np.int64)  # rows of the last, unfinished run
    crowded = None  # key of a run that is being streamed as a crowd

    def table(a, b, whole):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=np.full(len(a), not whole))], names=["a", "b"])

    def finish(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        run = np.cumsum(new) - 1
        length = np.bincount(run)[run]
        crowd = rows[length > limit, 2]
        if len(crowd):
            yield table(crowd, np.zeros(len(crowd), np.int64), False)
        keep = (length > 1) & (length <= limit)
        fp, run, length = rows[keep, 2].view(np.uint64), run[keep], length[keep]
        for step in range(1, int(length.max(initial=1))):
            if len(fp) <= step:
                break
            hit = (run[step:] == run[:-step])
            x, y = fp[:-step][hit], fp[step:][hit]
            near = _popcount(x ^ y) <= distance
            if near.any():
                yield table(x[near].view(np.int64), y[near].view(np.int64), True)

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        if not len(rows):
            continue
        if crowded is not None:
            more = (rows[:, :2] == crowded).all(axis=1)
            if more.any():
                yield table(rows[more, 2], np.zeros(int(more.sum()), np.int64), False)
            rows = rows[~more]
            if not len(rows):
                continue
            crowded = None
        rows = np.concatenate([held, rows])
        last = (rows[:, :2] == rows[-1, :2]).all(axis=1)
        done, held = rows[~last], rows[last]
        yield from finish(done)
        if len(held) > limit:
            crowded = held[0, :2].copy()
            yield table(held[:, 2], np.zeros(len(held), np.int64), False)
            held = held[:0]
    yield from finish(held)


def crowd_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``a, b`` that connect whatever is within ``distance`` in ``prints`` (fp).

    Every fingerprint emits its ball of radius ceil(distance/2), each variant
    with its own radius. If some fingerprint lies within floor(distance/2) of a
    variant, everything that reaches the variant is within ``distance`` of that
    one, so a star on it is exact: links are linear in the variants, with no
    pairs inside a crowd. The balls are thousands of times their fingerprints,
    which Spark's estimate of their size leaves out; so they are sorted and
    streamed, not joined, and never broadcast. A variant meets as many
    fingerprints as a ball has variants at most.
    """
    far, near = (distance + 1) // 2, distance // 2

    def ball(batches):
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        levels = [np.zeros(1, np.uint64)]
        for _ in range(far):
            low = np.unique(np.concatenate([(levels[-1][:, None] ^ bits[None, :]).reshape(-1)]))
            levels.append(low[_popcount(low) == len(levels)])
        flips = np.concatenate(levels)
        radius = _popcount(flips).astype(np.int8)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 64):
                part = fp[at:at + 64]
                keys = part[:, None] ^ flips[None, :]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64)),
                    pa.array(np.tile(radius, len(part)))], names=["variant", "fp", "radius"])

    def stars(batches):
        at, held, reached = None, 0, False  # variant of the last run, its hub, and whether that is near
        for batch in batches:
            variant, radius, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            new = np.concatenate([[at is None or variant[0] != at], variant[1:] != variant[:-1]])
            run = np.cumsum(new)  # 0: the last batch's run goes on
            hub = np.concatenate([[np.int64(held)], fp[new]])[run]
            whole = np.concatenate([[reached], radius[new] <= near])[run]
            at, held, reached = variant[-1], hub[-1], whole[-1]
            linked = whole & (hub != fp)
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(hub[linked]), pa.array(fp[linked])], names=["a", "b"])

    balls = prints.select("fp").mapInArrow(ball, "variant long, fp long, radius byte").select("variant", "radius", "fp")
    return (balls.repartition("variant").sortWithinPartitions("variant", "radius", "fp")
            .mapInArrow(stars, "a long, b long").distinct())


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Verified links ``a, b`` among distinct fingerprints (column ``fp``).

    Exact for the connected components at ``distance`` (3 or less): fewer than
    ``CROWD`` fingerprints on a variant are compared pair by pair, the members
    of larger crowds are linked by ``crowd_links``.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be between 0 and 3")
    limit = CROWD
    emitted = prints.select("fp").mapInArrow(lambda b: _variants(b, blocks), "block byte, variant long, fp long")
    met = (emitted.repartition("block", "variant").sortWithinPartitions("block", "variant", "fp")
           .mapInArrow(lambda b: _runs(b, distance, limit), "a long, b long").distinct())
    met = materialize(met, "simhash-links")
    crowd = met.filter("b is null").select(F.col("a").alias("fp"))
    pairs = met.filter("b is not null")
    return pairs if crowd.isEmpty() else pairs.union(crowd_links(crowd, distance)).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, mark: Column | None = None) -> DataFrame:
    """``doc_id, fp, component_id, row_id, keep_row`` for every row.

    ``fp`` is the SimHash of the whole text's word shingles, ``component_id``
    the smallest document id reachable over links of ``distance`` bits or less.
    A null or empty text has fingerprint 0 and is linked like any other; null
    ids are passed over for ``component_id`` (null if there is no other).
    ``keep_row`` is the ``row_id`` of the component's representative: the row
    with the smallest id, one of them if rows repeat. An empty table gives an
    empty result; other columns are ignored. A ``mark`` is returned with its
    row under that name, to find the row again.
    """
    marks = [] if mark is None else [mark.alias("mark")]
    rows = docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp"), *marks)
    rows = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_id")
    prints = materialize(rows.groupBy("fp").agg(F.min(first).alias("first")), "prints")
    roots = connected(links(prints, distance))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first")
    leaders = rooted.groupBy("root").agg(F.min("first").alias("leader"))
    classes = rooted.join(leaders, "root").select(
        F.col("fp").alias("class_fp"), F.col("leader.doc_id").alias("component_id"), F.col("leader.row_id").alias("keep_row"))
    return rows.join(classes, rows["fp"] == classes["class_fp"]).select("doc_id", "fp", "component_id", "row_id", "keep_row", *(["mark"] if marks else []))
