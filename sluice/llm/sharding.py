"""Sharding by vector bin packing over bytes, tokens and rows (operator 7).

Groups (equal texts) are what is placed. Small groups are gathered by hash into
a fixed number of bins, so what is packed is bounded whatever the corpus; a
group too large for one bin is packed alone, in pieces if it must be. Each item
goes where the dot product of its size vector with the residual capacity is
highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words

#: Bins of small groups for each shard; also the share of a shard from which a group is packed alone.
BINS_PER_SHARD = 256


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of ``items``: one size per dimension).

    Largest item first; among shards where it fits in every dimension, or all
    if there is none, the one with the highest dot product of item and residual
    capacity, relative to the totals; ties to the smaller shard.
    """
    total = np.maximum(items.sum(axis=0), 1)
    share = items / total
    left = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -share.max(axis=1))):
        fits = (left >= share[i] - 1e-12).all(axis=1)
        worth = left @ share[i]
        out[i] = int(np.where(fits, worth, -np.inf).argmax()) if fits.any() else int(worth.argmax())
        left[out[i]] -= share[i]
    return out


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, tokens, shard, slot`` for every row; law ``bytes``.

    ``size`` is the text's UTF-8 bytes plus 1; a null text counts as empty.
    Shards come out near equal in bytes, tokens and rows. Equal texts share a
    shard unless together they outweigh 1/``BINS_PER_SHARD`` of one, where
    pieces of the group are dealt by row number, rows that repeat with id and
    text included. ``slot`` numbers a shard's rows without gaps from 0;
    repeated rows and ties get slots of their own. Texts are read whole, however
    long; only their sizes move. An empty table gives an empty result; other
    columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), words(F.col(text)).alias("tokens"),
                       F.xxhash64(body).alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "shard-sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return rows.select("doc_id", "size", "text_crc32", "tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    bins = shards * BINS_PER_SHARD
    most = {k: total[k] / bins for k in ("bytes", "tokens", "rows")}
    groups = rows.groupBy("text_hash").agg(*sums)
    # a group that fills a bin alone: at most 3 * bins of them, as each holds over 1/bins of the bytes, the tokens or the rows
    pieces: Column = F.ceil(F.greatest(*[F.col(k) / max(v, 1) for k, v in most.items()]))
    large = groups.filter(pieces > 1).select("text_hash", pieces.cast("int").alias("pieces"))
    dealt = rows.join(F.broadcast(large), "text_hash", "left")
    # a bin is a piece of one large group (alone), or a share of all small ones
    alone = F.col("pieces").isNotNull()
    dealt = dealt.select("doc_id", "size", "text_crc32", "tokens", "row", alone.alias("alone"), F.when(alone, F.col("text_hash")).otherwise(0).alias("part"),
                         F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.pmod(F.xxhash64("text_hash", F.lit(2)), F.lit(bins))).cast("long").alias("bin"))
    dealt = materialize(dealt, "shard-bins")
    where = ["alone", "part", "bin"]
    items = dealt.groupBy(*where).agg(*sums).orderBy(*where).collect()  # 7 * bins at most
    placed = pack(np.array([[r["bytes"], r["tokens"], r["rows"]] for r in items], float), shards)
    begins, used = [], [0] * shards
    for r, s in zip(items, placed.tolist()):
        begins.append(used[s])
        used[s] += r["rows"]
    plan = docs.sparkSession.createDataFrame(
        [(r["alone"], r["part"], r["bin"], s, b) for r, s, b in zip(items, placed.tolist(), begins)], "alone boolean, part long, bin long, shard int, begin long")
    order = Window.partitionBy(*where).orderBy("doc_id", "row")
    return (dealt.withColumn("at", F.row_number().over(order) - 1).join(F.broadcast(plan), where)
            .select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("begin") + F.col("at")).alias("slot")))
