"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a``, ``b``, longs).

    ``root`` is the smallest node of the component. Large-star and small-star
    steps alternate until a step changes nothing; each is a grouped minimum
    (partial aggregation) and an equi-join, its result goes to the shared
    folder, and only a row count and a checksum come to the driver.
    """
    now = materialize(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
                      .filter("lo <> hi").distinct(), "edges")
    before = None
    while True:
        # large star: every larger neighbour moves to the node's smallest neighbour
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        now = (both.join(least, "u").filter("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
               .filter("lo <> hi").distinct())
        # small star: smaller neighbours, and the node itself, move to the smallest of them
        least = now.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = now.join(least, "hi").select(F.col("m").alias("x"), F.col("lo").alias("y"))
        now = materialize(moved.union(least.select("m", "hi")).filter("x <> y")
                          .select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "edges")
        sign = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first())
        if sign == before:
            break
        before = sign
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
