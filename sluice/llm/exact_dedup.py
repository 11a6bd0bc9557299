"""Exact deduplication by content-defined chunk recipes (operator 10).

A text is cut where a rolling hash over its last 16 bytes says so, so equal
texts have equal chunks. Every distinct chunk gets a verified identifier: its
64-bit hash, plus an ordinal where different contents share a hash. Two texts
are equal when their ordered identifier lists are; long texts move through one
shuffle at most (as distinct chunks), the lists do the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, materialize, slices, values

#: Chunk sizes in bytes: least, mean beyond the least (a power of two), most.
LEAST, MEAN, MOST = 1024, 4096, 32768
_BLOCK = 1 << 20


def normalized(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of the windows of 16 bytes whose hash picks a boundary, in blocks."""
    found = []
    for at in range(0, len(data), _BLOCK):
        lo = max(0, at - 15)
        h = (data[lo:at + _BLOCK].astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        for step, factor in ((1, 0x01000193), (2, 0x26544357), (4, 0x4F1BBCDD), (8, 0x85EBCA6B)):
            if len(h) > step:
                h = np.concatenate([h[:step], h[step:] + np.uint32(factor) * h[:-step]])
        picked = np.flatnonzero((h >> np.uint32(8)) % np.uint32(MEAN) == 0) + lo + 1
        found.append(picked[(picked > at) & (picked >= 16)])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks of ``data``, in order; none for empty data."""
    out, start = [], 0
    points = _cut_points(np.frombuffer(data, np.uint8)).tolist() if len(data) > LEAST else []
    for end in [*points, len(data)]:
        while end - start > MOST:
            out.append(data[start:start + MOST])
            start += MOST
        if end - start >= LEAST or end == len(data) > start:
            out.append(data[start:end])
            start = end
    return out


def hashed(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _chunk_list(text: Column) -> Column:
    @F.arrow_udf("array<binary>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in slices(batches):
            yield pa.array([chunks(x or b"") for x in values(column.cast(pa.binary()))], pa.list_(pa.binary()))

    return cut(text)


def chunk_hash_clashes(normal: Column, docs: DataFrame) -> DataFrame:
    """Distinct chunks whose hash another content shares: ``chunk_hash, chunk, ordinal``.

    Every chunk's content is compared here: the distinct contents of the
    corpus are grouped by hash. The result is almost always empty.
    """
    contents = (docs.select(F.explode(_chunk_list(normal)).alias("chunk"))
                .select(hashed(F.col("chunk")).alias("chunk_hash"), "chunk").distinct())
    shared = contents.groupBy("chunk_hash").agg(F.count("*").alias("contents")).filter("contents > 1")
    return (contents.join(shared.select("chunk_hash"), "chunk_hash", "left_semi")
            .withColumn("ordinal", F.row_number().over(Window.partitionBy("chunk_hash").orderBy("chunk"))))


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``row_id, doc_id, text_sha256, recipe``.

    ``recipe`` is the ordered list of verified chunk identifiers as text-free
    longs. ``row_id`` tells repeated rows apart. The table is written to the
    shared folder, so later steps neither move nor cut texts again.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalized(F.col(text)).alias("normal"))
    clashes = materialize(chunk_hash_clashes(F.col("normal"), rows), "chunk-clashes")
    slim = rows.select("doc_id", F.sha2("normal", 256).alias("text_sha256"),
                       F.transform(_chunk_list(F.col("normal")), hashed).alias("recipe"), "normal")
    if clashes.isEmpty():
        slim = slim.drop("normal")
    else:
        # the ordinals of the contents that share a hash, in the order of the text
        parts = slim.withColumn("row", F.monotonically_increasing_id())
        parts = materialize(parts.select("row", "doc_id", "text_sha256", "recipe", "normal"), "clash-rows")
        told = (parts.select("row", F.posexplode(_chunk_list(F.col("normal"))).alias("pos", "chunk"))
                .join(F.broadcast(clashes.select("chunk", "ordinal")) if clashes.count() < 10_000 else clashes.select("chunk", "ordinal"), "chunk")
                .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "ordinal"))).alias("told")))
        slim = (parts.join(told, "row", "left").select("doc_id", "text_sha256", F.concat(
            "recipe", F.coalesce(F.flatten(F.transform("told", lambda t: F.array(t["pos"].cast("long"), t["ordinal"].cast("long")))), F.array().cast("array<long>"))).alias("recipe")))
    return materialize(slim.withColumn("row_id", F.monotonically_increasing_id()), "recipes")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, row_id`` for every row.

    Texts are equal when identical after replacing each run of ASCII white
    space by one space; null counts as empty. Of equal texts the row with the
    smallest id stays (null ids last); among repeated rows with that id exactly
    one is ``kept``. An empty table gives an empty result; other columns of
    ``docs`` are ignored.

    Groups are summed with partial aggregation, so a group of copies with a
    third of all rows costs one row per task in the shuffle; the join back is
    an inner equi-join with one row per group, which Spark can split.
    """
    rows = recipes(docs, doc_id, text)
    groups = rows.groupBy("recipe").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_id")).alias("first"),
        F.count("*").alias("group_size"))
    groups = groups.select(F.col("recipe").alias("group"), F.col("first.doc_id").alias("keep_id"),
                           F.col("first.row_id").alias("keep_row"), "group_size")
    return rows.join(groups, rows["recipe"] == groups["group"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256", "row_id")
