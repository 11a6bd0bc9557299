"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, shared_path  # noqa: F401

#: A word is a run of anything but ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def values(column) -> Iterator:
    """The Python values of an Arrow array, one at a time, so that only one copy of a batch is held."""
    return (x.as_py() for x in column)


def slices(batches: Iterator[pa.Array], rows: int = 512) -> Iterator[pa.Array]:
    """Batches in pieces of at most ``rows`` values, so that results as large as their input leave a worker early."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def words(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True for the fold kept out of training: crc32(doc_id as text) mod parts = part.

    A null id counts as the empty text.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def share_of(key: Column, fraction: Column) -> Column:
    """Keep about ``fraction`` of the rows, the same ones in every run."""
    return (F.pmod(key, F.lit(1 << 40)) / F.lit(float(1 << 40))) < fraction


def distinct_texts(rows: DataFrame, label: str) -> DataFrame:
    """``label, text`` of ``rows`` once for each label and text (by a 64-bit hash).

    Tasks drop their own repeats before anything is moved, so a text with many
    copies sends one row a task. For samples: a task holds the hashes it met.
    """
    marked = rows.select(label, "text", F.xxhash64("text").alias("mark"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            new = []
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            if new:
                yield batch.take(pa.array(new))

    return marked.mapInArrow(once, marked.schema).dropDuplicates([label, "mark"]).select(label, "text")


def keep_rows(docs: DataFrame, mark: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``kept`` (doc_id, mark), one row for each, all columns.

    ``mark`` tells rows with one id apart. Where id and mark repeat, one of the
    rows stays; the choice follows their other columns.
    """
    names = docs.columns
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), mark.alias("mark"))
    named = kept.select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark"))
    met = rows.join(named, rows["id"].eqNullSafe(named["kept_id"]) & rows["mark"].eqNullSafe(named["kept_mark"]), "left_semi")
    others = F.xxhash64(*[F.col(f"doc.`{c}`") for c in names])
    first = F.row_number().over(Window.partitionBy("id", "mark").orderBy(others))
    return met.withColumn("first", first).filter("first = 1").select(*[F.col(f"doc.`{c}`") for c in names])
