"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 8).

Both levels work the same way. A text is halved down to leaves; leaves are
split into pieces by the pattern; neighbours are joined by splitting again from
the last piece on the left that cannot change until a piece start on the right
is met again. A long piece is halved down to short byte runs; neighbours are
joined by encoding a growing window around the seam until the tokens at the
window's edges are unaffected by their outer neighbours. Decoding goes up the
same kind of tree: runs of ids become bytes, and neighbours are concatenated
level by level.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import slices, values

LEAF_CHARS = 1 << 14
LEAF_BYTES = 48
LEAF_IDS = 4096
#: The longest look ahead of an alternative that is fixed text, in characters.
LOOK_AHEAD = 3
#: Encoded pieces of a generation, and seams, that a worker keeps; two generations of pieces take some 150 MB.
_CACHE, _SEAMS = 300_000, 100_000
_NONE = 1 << 62


class Codec:
    """Ranks and split pattern of one vocabulary; pure and immutable but for caches."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.piece = {r: t for t, r in self.rank.items()}
        self.byte = [self.rank[bytes([b])] for b in range(256)]
        self.made = {self.rank[t[:i]] << 32 | self.rank[t[i:]]: r for t, r in self.rank.items()
                     for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank}
        self.first = [self.made.get(a << 32 | b, _NONE) for a in self.byte for b in self.byte]
        self.split = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}  # two generations bound the memory
        self.older: dict[str, tuple[int, ...]] = {}
        self.seams: dict[tuple[int, int], bool] = {}

    # -- one piece ---------------------------------------------------------
    def merge(self, data: bytes) -> list[int]:
        """Byte-pair merges of a short run, lowest rank first, leftmost on ties.

        An id is its token's rank, so the lowest id that a pair makes is next.
        """
        made = self.made.get
        byte, first = self.byte, self.first
        parts = [byte[x] for x in data]
        pairs = [first[a << 8 | b] for a, b in zip(data, data[1:])]
        while pairs:
            low = min(pairs)
            if low == _NONE:
                break
            i = pairs.index(low)
            parts[i:i + 2] = [low]
            del pairs[i]
            if i:
                pairs[i - 1] = made(parts[i - 1] << 32 | low, _NONE)
            if i < len(pairs):
                pairs[i] = made(low << 32 | parts[i + 1], _NONE)
        return parts

    def fits(self, a: int, b: int) -> bool:
        """True if no merge crosses the seam between two tokens.

        Merges run by rising rank, and a token's rank is above that of its
        parts, so a row of tokens is the encoding of its bytes exactly when
        each two neighbours are the encoding of theirs.
        """
        found = self.seams.get((a, b))
        if found is None:
            if len(self.seams) > _SEAMS:
                self.seams.clear()
            found = self.seams[a, b] = self.merge(self.piece[a] + self.piece[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the joined bytes of two encodings."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join(self.piece[t] for t in left[len(left) - i:] + right[:j]))
            ok_left = i == len(left) or self.fits(left[-i - 1], window[0])
            ok_right = j == len(right) or self.fits(window[-1], right[j])
            if ok_left and ok_right:
                return left[:len(left) - i] + window + right[j:]
            i, j = i if ok_left else 2 * i, j if ok_right else 2 * j

    def reduce(self, data: bytes) -> list[int]:
        """Level by level: leaves, then neighbours joined until one is left."""
        level = [self.merge(data[i:i + LEAF_BYTES]) for i in range(0, len(data), LEAF_BYTES)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def encode_piece(self, text: str) -> tuple[int, ...]:
        found = self.known.get(text) or self.older.get(text)
        if found is None:
            data = text.encode("utf-8", "surrogatepass")
            one = self.rank.get(data)
            found = (one,) if one is not None else tuple(self.reduce(data))
        if len(text) <= 64:
            if len(self.known) >= _CACHE:
                self.older, self.known = self.known, {}
            self.known[text] = found
        return found

    # -- one text ----------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """What the pattern matches in the whole text, by halving it."""
        if len(text) <= LEAF_CHARS:
            return self.split.findall(text)
        level = [(i, [m.span() for m in self.split.finditer(text[i:i + LEAF_CHARS])]) for i in range(0, len(text), LEAF_CHARS)]
        level = [[(a + i, b + i) for a, b in spans] for i, spans in level]
        size = LEAF_CHARS
        while len(level) > 1:
            level = [self._seam(text, level[k], level[k + 1], (k + 1) * size, min((k + 2) * size, len(text)))
                     if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
            size *= 2
        return [text[a:b] for a, b in level[0]]

    def _seam(self, text: str, left: list[tuple[int, int]], right: list[tuple[int, int]], cut: int, end: int) -> list[tuple[int, int]]:
        """Spans of both halves, split again around ``cut``.

        A left span is final if it ended before the cut and no fixed
        alternative tried at its start could have reached over it. Matching
        from a given start depends on later text only, so the first new span
        that starts where a right span does is followed by the right spans.
        """
        keep = len(left)
        while keep and (left[keep - 1][1] >= cut or left[keep - 1][0] + LOOK_AHEAD > cut):
            keep -= 1
        at = left[keep - 1][1] if keep else left[0][0] if left else cut
        starts = {a: k for k, (a, _) in enumerate(right[:64])}
        new: list[tuple[int, int]] = []
        known = min(64, len(right))
        for m in self.split.finditer(text, at, end):
            a, b = m.span()
            if a >= cut:
                while known < len(right) and right[known - 1][0] < a:
                    starts.update({s: k for k, (s, _) in enumerate(right[known:2 * known], known)})
                    known = min(2 * known, len(right))
                if a in starts:
                    return left[:keep] + new + right[starts[a]:]
            new.append((a, b))
        return left[:keep] + new

    def encode(self, text: str) -> list[int]:
        """Token ids of a whole text, without special tokens."""
        out: list[int] = []
        for p in self.pieces(text):
            out += self.known.get(p) or self.encode_piece(p)
        return out

    def decode(self, ids) -> bytes:
        """Bytes of a row of ids, up a tree: runs of ``LEAF_IDS`` ids are joined, then neighbours, level by level."""
        level = [b"".join(map(self.piece.__getitem__, ids[at:at + LEAF_IDS])) for at in range(0, len(ids), LEAF_IDS)]
        while len(level) > 1:
            level = [b"".join(level[at:at + 2]) for at in range(0, len(level), 2)]
        return level[0] if level else b""


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker and vocabulary."""
    return Codec(path, pattern)


def _encode(column: pa.Array, path: str, pattern: str) -> pa.ListArray:
    own = codec(path, pattern)
    rows = [np.array(own.encode(x or ""), np.int32) for x in values(column)]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def _decode(ids: pa.ListArray, path: str, pattern: str) -> pa.Array:
    own = codec(path, pattern)
    ends = ids.offsets.to_numpy()
    flat = ids.values.to_numpy(zero_copy_only=False)
    return pa.array([own.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.binary())


def encode(text: Column, path: str, pattern: str) -> Column:
    """Array of token ids of each whole text; null counts as empty.

    A long text is held once with its ids; a long piece is halved, so time
    stays near linear. Equal texts give equal ids.
    """

    @F.arrow_udf("array<int>")
    def compute(column: pa.Array) -> pa.Array:
        return _encode(column, path, pattern)

    return compute.asNondeterministic()(text)  # evaluated once, however often it is used


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that an array of ids stands for; null ids give empty bytes."""

    @F.arrow_udf("binary")
    def compute(column: pa.Array) -> pa.Array:
        return _decode(column.fill_null(pa.scalar([], column.type)) if column.null_count else column, path, pattern)

    return compute(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """Struct of the ``ids`` of each whole text and the bytes ``decoded`` from them.

    One Python worker a task does both, where ``decode(encode(...))`` keeps two
    with a vocabulary each. Results leave it a slice of a batch at a time. A
    null text counts as empty: no ids, empty bytes.
    """

    @F.arrow_udf("ids array<int>, decoded binary")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in slices(batches):
            ids = _encode(column, path, pattern)
            yield pa.StructArray.from_arrays([ids, _decode(ids, path, pattern)], names=["ids", "decoded"])

    return compute.asNondeterministic()(text)
