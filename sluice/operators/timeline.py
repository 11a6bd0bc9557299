"""Keys walked in time, with no key in one task.

Rows of a key are dealt into buckets of time. A bucket that holds too many rows
is cut further at quantiles of its own times, so a key or a day that holds a
third of all rows spreads too. Questions about order are then answered inside
(key, bucket), and one row a bucket carries the answer on to later buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a (key, bucket) from which it is cut further, and the most parts it is cut into.
ROWS_A_BUCKET, MOST_PARTS = 200_000, 4096


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


class Buckets:
    """How the times of each key are dealt; made from the rows that count.

    ``rows`` needs ``key`` and ``t`` (microseconds). ``put`` adds ``bucket``,
    a struct that sorts by time, to any rows with these columns.
    """

    def __init__(self, rows: DataFrame, key: str, width_us: int, rows_a_bucket: int = ROWS_A_BUCKET):
        self.key, self.width = key, width_us
        wide = rows.select(key, "t", self._wide().alias("w"))
        heavy = wide.groupBy(key, "w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_a_bucket)
        most = heavy.agg(F.max("n")).first()[0]
        self.cuts = None
        if most:
            parts = min(MOST_PARTS, -(-most // rows_a_bucket))
            at = [i / parts for i in range(1, parts)]
            # a null key is a key like any other
            met = wide.join(heavy.select(F.col(key).alias("_key"), F.col("w").alias("_w")),
                            F.col(key).eqNullSafe(F.col("_key")) & (F.col("w") == F.col("_w")), "left_semi")
            self.cuts = met.groupBy(F.col(key).alias("_key"), F.col("w").alias("_w")).agg(
                F.array_distinct(F.percentile_approx("t", at, 10 * parts)).alias("cuts"))

    def _wide(self) -> Column:
        return F.floor(F.col("t") / F.lit(self.width))

    def put(self, rows: DataFrame) -> DataFrame:
        wide = rows.withColumn("_wide", self._wide())
        part = F.lit(0)
        if self.cuts is not None:
            wide = wide.join(self.cuts, F.col(self.key).eqNullSafe(F.col("_key")) & (F.col("_wide") == F.col("_w")), "left")
            part = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("t"))), F.lit(0))
            part = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(part)
        out = wide.withColumn("bucket", F.struct(F.col("_wide").alias("w"), part.alias("p")))
        return out.select(*rows.columns, "bucket")


def last_before(probes: DataFrame, events: DataFrame, key: str, value: Column, buckets: Buckets, keep: list[str]) -> DataFrame:
    """As-of lookup: each probe with the newest event of its key at or before its time.

    ``probes`` has ``key``, ``t`` and ``keep``; ``events`` has ``key``, ``t`` and
    ``tie``, which orders events of one time. Returns ``key``, ``keep`` and
    ``found`` (``value`` of the event as a struct, or null).
    """
    # one order of fields for structs that are compared: time, tie, then what is wanted
    event = F.struct(F.col("t").alias("t"), F.col("tie").alias("tie"), value.alias("value"))
    dealt = buckets.put(events.select(key, "t", event.alias("event")))
    asked = buckets.put(probes.select(key, "t", *keep))
    both = (asked.select(key, "bucket", "t", F.lit(1).alias("kind"), F.lit(None).cast(dealt.schema["event"].dataType).alias("event"), *keep)
            .unionByName(dealt.select(key, "bucket", "t", F.lit(0).alias("kind"), "event"), allowMissingColumns=True))
    inside = (Window.partitionBy(key, "bucket").orderBy("t", "kind", "event.tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    here = both.withColumn("here", F.last("event", ignorenulls=True).over(inside)).where("kind = 1").select(key, "bucket", "here", *keep)
    # one row a bucket: its newest event, carried on to later buckets
    newest = both.groupBy(key, "bucket").agg(F.max("event").alias("event"))
    earlier = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.withColumn("carried", F.last("event", ignorenulls=True).over(earlier)).select(
        F.col(key).alias("_key"), F.col("bucket").alias("_bucket"), "carried")
    joined = here.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("bucket") == F.col("_bucket")), "left")
    return joined.select(key, *keep, F.coalesce("here", "carried")["value"].alias("found"))
