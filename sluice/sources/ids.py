"""Row ids that are unique over appends, runs and concurrent writers, without a scan.

An append reserves an epoch of its table: the first free number, taken by
creating an empty file ``_ids/epoch=<n>`` below the table, which only one writer
can do. Free numbers are found by existence checks that double and then halve
(the taken ones have no gaps), so neither the table nor the folder is listed.
A row's id is ``epoch | task | row``, so ids grow with the epochs. An epoch may
carry a name; asking for the same name again gives the same epoch, which makes
a replayed streaming batch write the ids it wrote before.

The store must create files atomically (HDFS, a local disk, object stores with
conditional writes); readers skip folders that begin with an underscore.
"""

from __future__ import annotations

from threading import Lock

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bits of an id: 2^24 appends, 2^15 tasks an append, 2^24 rows a task.
EPOCH_BITS, TASK_BITS, ROW_BITS = 24, 15, 24
_LOCAL = Lock()


class _Folder:
    """Files of the ids folder of a table, through the Hadoop file system of its path."""

    def __init__(self, spark: SparkSession, table: str):
        self.jvm = spark._jvm
        self.root = f"{table.rstrip('/')}/_ids"
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def taken(self, n: int) -> bool:
        return self.fs.exists(self.path(f"epoch={n}"))

    def take(self, n: int) -> bool:
        with _LOCAL:  # a local disk checks and creates in two steps
            return self.fs.createNewFile(self.path(f"epoch={n}"))


def first_free(taken) -> int:
    """Smallest number that is not taken, where the taken ones have no gaps."""
    if not taken(0):
        return 0
    low, high = 0, 1
    while taken(high):
        low, high = high, high * 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if taken(middle) else (low, middle)
    return high


def reserve(spark: SparkSession, table: str, name: str | None = None) -> int:
    """A number no other append of ``table`` has, or the one reserved for ``name`` before."""
    folder = _Folder(spark, table)
    mark = folder.path(f"name={name}") if name is not None else None
    if mark is not None and folder.fs.exists(mark):
        stream = folder.fs.open(mark)
        try:
            return stream.readInt()
        finally:
            stream.close()
    epoch = first_free(folder.taken)
    while not folder.take(epoch):
        epoch += 1
    if epoch >= 1 << EPOCH_BITS:
        raise ValueError(f"{table} has had {epoch} appends, more than ids have room for")
    if mark is not None:
        stream = folder.fs.create(mark, True)
        try:
            stream.writeInt(epoch)
        finally:
            stream.close()
    return epoch


def first_id(epoch: int) -> int:
    return epoch << (TASK_BITS + ROW_BITS)


def row_ids(epoch: int) -> Column:
    """Ids of the rows of an append; fails loudly where a task or its rows do not fit."""
    seat = F.monotonically_increasing_id()
    task, row = F.shiftright(seat, 33), seat.bitwiseAND((1 << 33) - 1)
    fits = (task < (1 << TASK_BITS)) & (row < (1 << ROW_BITS))
    value = F.lit(first_id(epoch)).cast("bigint") + F.shiftleft(task, ROW_BITS) + row
    return F.when(fits, value).otherwise(F.raise_error(F.lit("too many rows for one append: repartition it")).cast("bigint"))
