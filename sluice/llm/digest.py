"""Document fingerprints from improbable features (operator 12).

A feature is a window of bytes. Its Shannon entropy, in fixed steps, tells how
improbable it is: the rarer a step is among all windows of all documents, the
better its rank. In each run of neighbouring windows the best-ranked, leftmost
one gets a vote; windows with enough votes are the document's features. Their
hashes fill a chain of Bloom filters, a new one after a fixed number of
features. Two digests are compared filter by filter, by the bits they share
beyond chance, relative to the most they could share.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cpu_partitions

#: Bytes of a window; windows that compete for a vote; votes that make a feature.
WINDOW, RUN, VOTES = 32, 32, 8
#: Steps of entropy; windows below ``WEAK`` of them (runs of few different bytes) are no features.
STEPS, WEAK = 1000, 100
#: Bits of a filter, bits set by a feature, features of a filter.
FILTER_BITS, FEATURE_BITS, FEATURES = 2048, 5, 128
#: Standard deviations of a chance overlap that count as nothing.
MARGIN = 2.0
#: Bytes of text in a bucket of neighbouring documents, about.
BUCKET_BYTES = 32 << 20
_SEGMENT, _PIECE, _BATCH = 1 << 15, 1 << 20, 1 << 22

_COUNTS = np.arange(WINDOW + 1)
_TERM = np.round(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * (1 << 16)).astype(np.int64)
_LOSS = (_TERM[:-1] - _TERM[1:]).astype(np.int64)  # of one occurrence more


def entropy_steps(x: np.ndarray) -> np.ndarray:
    """Step of the entropy of each window of the bytes ``x``, by its first byte.

    From a window to the next one byte leaves and one comes. What that changes
    depends on how often each stands in the bytes between, which comparing ``x``
    with itself at every distance counts for all places at once.
    """
    n = len(x) - WINDOW + 1
    out = np.empty(max(n, 0), np.int16)
    top = int(_TERM[WINDOW])
    for start in range(0, n, _SEGMENT):
        stop = min(n, start + _SEGMENT)
        part = x[start:stop + WINDOW - 1]
        before, after = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint8)
        for d in range(1, WINDOW):
            same = (part[d:] == part[:-d]).view(np.uint8)
            before[d:] += same
            after[:-d] += same
        total = np.empty(stop - start, np.int64)
        total[0] = _TERM[np.bincount(part[:WINDOW], minlength=256)].sum()
        k = stop - start - 1
        total[1:] = _LOSS[after[:k]] - _LOSS[before[WINDOW:WINDOW + k]]
        out[start:stop] = (top - np.cumsum(total)) * (STEPS / top)
    return out


def _places(ends: np.ndarray, n: int, width: int) -> np.ndarray:
    """True where ``width`` bytes from here lie within one text."""
    begins = np.concatenate([[0], ends[:-1]])
    change = np.zeros(n + 1, np.int32)
    fits = ends - begins >= width
    np.add.at(change, begins[fits], 1)
    np.add.at(change, ends[fits] - width + 1, -1)
    return np.cumsum(change[:n]) > 0


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def _votes(rank: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Votes of each window: in each run that lies in one text, the best and leftmost gets one."""
    votes = np.zeros(len(rank), np.int32)
    n = len(rank) - RUN + 1
    for start in range(0, n, _PIECE):
        stop = min(n, start + _PIECE)
        key = rank[start:stop + RUN - 1].astype(np.int64) * (2 * _PIECE) + np.arange(stop - start + RUN - 1)
        blocks = -(-len(key) // RUN)
        padded = np.full(blocks * RUN, np.iinfo(np.int64).max)
        padded[:len(key)] = key
        grid = padded.reshape(blocks, RUN)
        head = np.minimum.accumulate(grid, axis=1).ravel()
        tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(tail[:stop - start], head[RUN - 1:RUN - 1 + stop - start])
        won = (least % (2 * _PIECE))[whole[start:stop]] + start
        votes += np.bincount(won, minlength=len(rank)).astype(np.int32)
    return votes


def select(x: np.ndarray, ends: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``text number, first byte`` of the features of the texts joined in ``x``, in order."""
    begins = np.concatenate([[0], ends[:-1]])
    if len(x) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    steps = entropy_steps(x)
    rank = ranks[steps]
    votes = np.zeros(len(rank), np.int32)
    if len(rank) >= RUN:
        votes = _votes(rank, _places(ends, len(rank), WINDOW + RUN - 1))
    at = np.flatnonzero((votes >= VOTES) & (steps >= WEAK))
    owner = np.searchsorted(ends, at, "right")
    # texts with windows but no feature yet (short, or of few different bytes): their best window
    bare = (ends - begins >= WINDOW)
    bare[owner] = False
    more = [b + int(np.argmin(rank[b:e - WINDOW + 1])) for b, e in zip(begins[bare], ends[bare])]
    at, owner = np.concatenate([at, np.array(more, np.int64)]), np.concatenate([owner, np.flatnonzero(bare)])
    order = np.lexsort((at, owner))
    return owner[order], at[order]


def _mix(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of 64-bit words."""
    h = np.full(len(words), 0x243F6A8885A308D3, np.uint64)
    for column in words.T:
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class Digest:
    """``counts``: features of each filter; ``filters``: their bits, packed."""

    counts: np.ndarray
    filters: np.ndarray

    def text(self) -> str:
        body = b"".join(int(c).to_bytes(1, "big") + f.tobytes() for c, f in zip(self.counts, self.filters))
        return base64.b64encode(body).decode()


def parse(text: str) -> Digest:
    body = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 1 + FILTER_BITS // 8)
    return Digest(body[:, 0].astype(np.int64), body[:, 1:])


def digests(texts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    """The digest of each text; an empty text has no filter, one shorter than a window is its own feature."""
    x, ends = _joined(texts)
    owner, at = select(x, ends, ranks)
    hashes = _mix(x[at[:, None] + np.arange(WINDOW)].view(np.uint64)) if len(at) else np.zeros(0, np.uint64)
    short = [(i, t) for i, t in enumerate(texts) if 0 < len(t) < WINDOW]
    if short:
        own = np.array([int.from_bytes(hashlib.sha1(t).digest()[:8], "big") for _, t in short], np.uint64)
        owner, hashes = np.concatenate([owner, [i for i, _ in short]]), np.concatenate([hashes, own])
    # each feature once in a text, in order of its first place
    order = np.lexsort((hashes, owner))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (owner[order[1:]] == owner[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
    owner, hashes = owner[~again], hashes[~again]
    if short:
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
    counts = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(counts) - counts
    chain = (np.arange(len(owner)) - begin[owner]) // FEATURES
    lengths = -(-counts // FEATURES)
    base = np.cumsum(lengths) - lengths
    at_filter = base[owner] + chain
    bits = np.zeros((int(lengths.sum()), FILTER_BITS), bool)
    width = FILTER_BITS.bit_length() - 1
    for j in range(FEATURE_BITS):
        bits[at_filter, (hashes >> np.uint64(j * width)).astype(np.int64) & (FILTER_BITS - 1)] = True
    packed, held = np.packbits(bits, axis=1), np.bincount(at_filter, minlength=len(bits))
    return [Digest(held[b:b + n], packed[b:b + n]) for b, n in zip(base, lengths)]


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: each filter of the shorter chain against its best partner, weighed by its features.

    Two empty digests are alike (1), an empty and another one are not (0).
    """
    if not len(a.counts) or not len(b.counts):
        return float(len(a.counts) == len(b.counts))
    if (len(b.counts), int(b.counts.sum()), b.filters.tobytes()) < (len(a.counts), int(a.counts.sum()), a.filters.tobytes()):
        a, b = b, a
    if len(a.counts) == len(b.counts) and np.array_equal(a.filters, b.filters):
        return 1.0
    right = np.unpackbits(b.filters, axis=1).astype(np.float32)
    size_b = right.sum(axis=1).astype(float)
    best = np.zeros(len(a.counts))
    for at in range(0, len(a.counts), 256):
        left = np.unpackbits(a.filters[at:at + 256], axis=1).astype(np.float32)
        size_a = left.sum(axis=1).astype(float)[:, None]
        shared, most = (left @ right.T).astype(float), np.minimum(size_a, size_b)
        density = np.maximum(size_a, size_b) / FILTER_BITS
        chance = most * density
        nothing = np.minimum(chance + MARGIN * np.sqrt(chance * (1 - density)), most - 0.5)
        best[at:at + 256] = np.clip((shared - nothing) / (most - nothing), 0, 1).max(axis=1)
    return float((best * a.counts).sum() / a.counts.sum())


def _pieces(texts: Iterator, limit: int = _BATCH) -> Iterator[list]:
    """Texts in lists of about ``limit`` bytes; a longer text is alone."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def rarity(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """The rank of each step of entropy, rarest first, over all windows of all texts; and all bytes.

    Tasks count their own windows, so that at most ``STEPS`` + 2 rows a task are
    summed. Steps that never occur come last, weak ones after all others.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = np.zeros(STEPS + 1, np.int64), 0
        for batch in batches:
            for texts in _pieces(v.as_py() or b"" for v in batch.column(0)):
                x, ends = _joined(texts)
                size += len(x)
                if len(x) >= WINDOW:
                    steps = entropy_steps(x)
                    seen += np.bincount(steps[_places(ends, len(steps), WINDOW)], minlength=STEPS + 1)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array([size, *seen[used].tolist()], pa.int64())], names=["step", "n"])

    rows = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    found = {r["step"]: r["n"] for r in rows}
    counts = np.array([found.get(s, 0) for s in range(STEPS + 1)], np.int64)
    steps = np.arange(STEPS + 1)
    ranks = np.empty(STEPS + 1, np.int32)
    ranks[np.lexsort((steps, counts, counts == 0, steps < WEAK))] = steps
    return ranks, found.get(-1, 0)


def _edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's digest, its edited text's, and its likeness to that and to the next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The next document is the one after it by
    descending doc_id, null ids last, rows of one id by a hash of their texts;
    the first follows the last (a single document follows itself). The edited
    text has the last half of the code points, rounded down, replaced by the
    first as many of the next document. A null text counts as empty. Equal
    texts have equal digests; that of an empty text is the empty string.
    Texts are read whole; a task holds some 20 bytes for each byte of its
    longest text. An empty table gives an empty result; other columns are
    ignored. Rows equal in id and text share a bucket of neighbours.

    Texts move once, into buckets of neighbours; the first row of a bucket goes
    to the one before as a guest too, as the next document of its last row.
    """
    spark = docs.sparkSession
    ranks, size = rarity(docs, text)
    body = F.coalesce(F.col(text), F.lit(""))
    # ascending order of these three: doc_id descending, null last, then the text's hash
    rows = docs.select(F.col(doc_id).isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not(F.col(doc_id).cast("long")), F.lit(0).cast("long")).alias("down"),
                       F.xxhash64(body).alias("mark"), body.alias("text"))
    order = ["none", "down", "mark"]
    buckets = max(cpu_partitions(spark), -(-size // BUCKET_BYTES))
    firsts = (rows.select(*order).repartitionByRange(buckets, *order).select(F.spark_partition_id().alias("part"), *order)
              .groupBy("part").agg(F.min(F.struct(*order)).alias("first")).collect())
    starts = sorted(tuple(r["first"]) for r in firsts)  # one for each bucket

    @F.pandas_udf("bucket int, first boolean")
    def place(none: pd.Series, down: pd.Series, mark: pd.Series) -> pd.DataFrame:
        keys = list(zip(none.tolist(), down.tolist(), mark.tolist()))
        found = [bisect_right(starts, k) - 1 for k in keys]
        return pd.DataFrame({"bucket": found, "first": [starts[b] == k for b, k in zip(found, keys)]})

    n = max(len(starts), 1)
    placed = rows.withColumn("place", place(*order))
    own = F.struct(F.col("place.bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.pmod(F.col("place.bucket") - 1, F.lit(n)).alias("bucket"), F.lit(1).alias("guest"))
    dealt = placed.select(*order, "text", F.explode(F.when(F.col("place.first"), F.array(own, guest)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("to.bucket", "to.guest", *order, "text").repartition(n, "bucket").sortWithinPartitions("bucket", "guest", *order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before: bucket, guest, doc_id, text, digest
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                bucket, guest, none, down = (part.column(c).to_pylist() for c in range(4))
                texts = [v.as_py() for v in part.column(5)]
                own_digests = (d for piece in _pieces(t.encode() for t in texts) for d in digests(piece, ranks))
                pairs = []
                for b, g, o, i, t, d in zip(bucket, guest, none, down, texts, own_digests):
                    if last and last[0] == b and not last[1]:
                        pairs.append((last, t, d))
                    last = (b, g, None if o else ~i, t, d)
                edited = [_edit(row[3], t).encode() for row, t, _ in pairs]
                edited_digests = [d for piece in _pieces(edited) for d in digests(piece, ranks)]
                out = [(row[2], len(row[3]), hashlib.sha256(e).hexdigest(), row[4].text(), ed.text(), likeness(row[4], ed), likeness(row[4], d))
                       for (row, _, d), e, ed in zip(pairs, edited, edited_digests)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (
                        pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))],
                        names=[c.split()[0] for c in _OUT.split(", ")])

    return dealt.mapInArrow(compare, _OUT)
