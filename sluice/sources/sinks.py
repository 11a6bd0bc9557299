"""Sinks for the two log tables (A3, A4) and the session delete (A5).

Identifiers come from an epoch that the append reserves (``sources.ids``):
unique over appends and concurrent writers, without reading the table. An
append lands in a folder of its own, ``append_id=<epoch>/created_date=<day>``:
writers cannot disturb each other's commits, a repeated one replaces what it
wrote, and "last N days" reads prune by day. ``created_at`` is fixed when the
append is called, and the returned rows are read back, so they are the stored
ones.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ids
from .tables import CONVERSATION_DDL, EXECUTION_DDL, conform


def append_rows(df: DataFrame, path: str, ddl: str, name: str | None = None) -> DataFrame:
    """Append rows to a log table of a declared schema; returns them as stored.

    ``id`` is always given here, also where the input has one: that could be in
    use already. ``name`` makes the append repeatable: the same name writes the
    same folder and ids again.
    """
    spark = df.sparkSession
    epoch = ids.reserve(spark, path, name)
    if "created_at" not in df.columns:
        df = df.withColumn("created_at", F.lit(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz"))
    rows = conform(df.withColumn("id", ids.row_ids(epoch)), ddl).withColumn("created_date", F.to_date("created_at"))
    folder = f"{path.rstrip('/')}/append_id={epoch}"
    rows.write.mode("overwrite").partitionBy("created_date").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def append_conversations(df: DataFrame, path: str) -> DataFrame:
    """A3: append conversation rows; metadata defaults to ``{}``, created_at to now."""
    if "metadata_json" in df.columns:
        df = df.withColumn("metadata_json", F.coalesce(F.col("metadata_json"), F.lit("{}")))
    return append_rows(df, path, CONVERSATION_DDL)


def append_executions(df: DataFrame, path: str) -> DataFrame:
    """A4: append execution rows; time and tokens default to 0, status to
    ``pending``, the rest to NULL."""
    for name, default in (("execution_time_ms", 0.0), ("tokens_used", 0)):
        if name in df.columns:
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return append_rows(df, path, EXECUTION_DDL)


def rewrite_without_sessions(history_path: str, session_ids: DataFrame, out_path: str) -> None:
    """A5 as a job: write the history minus the given sessions to a new path.

    The input path is never overwritten while it is being read; the caller
    swaps the table location afterwards.
    """
    from ..operators.history import clear_sessions

    spark = session_ids.sparkSession
    kept = clear_sessions(spark.read.parquet(history_path), session_ids)
    writer = kept.write.mode("overwrite")
    if "created_date" in kept.columns:
        writer = writer.partitionBy("created_date")
    writer.parquet(out_path)
