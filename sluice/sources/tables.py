"""Relational sources: the three log tables, parameterised SQL.

A1 reads a history table either from parquet (the lake copy) or from a live
database over JDBC. A JDBC read is split into parallel range reads on the
integer primary key, so no single task pulls the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Declared table schemas (the data model's three tables).
CONVERSATION_DDL = ("id BIGINT, session_id STRING, user_message STRING, agent_response STRING, "
                    "agent_type STRING, metadata_json STRING, created_at TIMESTAMP_NTZ")
EXECUTION_DDL = ("id BIGINT, session_id STRING, agent_type STRING, task_description STRING, "
                 "status STRING, result STRING, error_message STRING, execution_time_ms DOUBLE, "
                 "tokens_used INT, model_used STRING, created_at TIMESTAMP_NTZ, "
                 "updated_at TIMESTAMP_NTZ")
CACHE_DDL = ("id BIGINT, cache_key STRING, cache_type STRING, value STRING, "
             "embedding ARRAY<FLOAT>, ttl_hours INT, hit_count INT, created_at TIMESTAMP_NTZ, "
             "expires_at TIMESTAMP_NTZ")

# Column defaults of the declared tables (applied when a column is absent).
DEFAULTS = {
    "status": "pending",
    "tokens_used": 0,
    "execution_time_ms": 0.0,
    "metadata_json": "{}",
    "ttl_hours": 24,
    "hit_count": 0,
}


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project ``df`` onto a declared schema: cast present columns, fill absent
    ones with their default (or a typed null), in declared order."""
    schema = StructType.fromDDL(ddl)
    cols = []
    for field in schema.fields:
        if field.name in df.columns:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            default = DEFAULTS.get(field.name)
            cols.append(F.lit(default).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def scan_table(spark: SparkSession, location: str, table: str | None = None,
               ddl: str | None = None, num_partitions: int = 64,
               properties: dict | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """A1: read a history table.

    ``location`` is a parquet path, or a ``jdbc:`` URL with ``table``. A JDBC
    read is partitioned on ``id`` between its min and max so the database is
    read by ``num_partitions`` tasks in parallel. ``columns`` gives declared
    columns as SQL expressions over the stored ones, for tables that store them
    under other names. Filters on declared columns that are stored as they are
    declared (also under another name) reach the scan.
    """
    if location.startswith("jdbc:"):
        if table is None:
            raise ValueError("a JDBC read needs a table name")
        props = dict(properties or {})
        bounds = (spark.read.format("jdbc").option("url", location)
                  .option("query", f"SELECT MIN(id) AS lo, MAX(id) AS hi FROM {table}")
                  .options(**props).load().first())
        reader = spark.read.format("jdbc").option("url", location).option("dbtable", table) \
            .options(**props)
        if bounds is not None and bounds["lo"] is not None:
            reader = (reader.option("partitionColumn", "id")
                      .option("lowerBound", str(bounds["lo"]))
                      .option("upperBound", str(bounds["hi"] + 1))
                      .option("numPartitions", str(num_partitions)))
        df = reader.load()
    else:
        df = spark.read.parquet(location)
    if columns:
        df = df.select(*[F.expr(text).alias(name) for name, text in columns.items()])
    return conform(df, ddl) if ddl else df


# Nodes of a parsed text that do something else than read (Catalyst class names).
_NOT_QUERIES = ("org.apache.spark.sql.catalyst.plans.logical.Command",
                "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")


def _is_query(spark: SparkSession, text: str) -> bool:
    """True if the parsed text, with everything in its tree, only reads.

    The text is parsed as Spark will parse it, and not run: comments, strings
    and arithmetic cannot hide a command, and a word in them is none.
    """
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    classes = [spark._jvm.java.lang.Class.forName(name, False, loader) for name in _NOT_QUERIES]
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    while todo:
        node = todo.pop()
        if any(c.isInstance(node) for c in classes) or "ExecuteImmediate" in node.getClass().getSimpleName():
            return False
        for below in (node.children(), node.innerChildren()):
            todo.extend(below.apply(i) for i in range(below.size()))
    return True


def sql_with_params(spark: SparkSession, text: str, params: list, **relations: DataFrame) -> DataFrame:
    """Run read-only SQL with positional ``?`` parameters.

    Values are bound by Spark (never spliced into the text); ``relations``
    bind ``{name}`` placeholders to DataFrames. Anything but a query raises
    ``ValueError`` before it runs: commands, inserts in any form (also behind
    ``FROM`` or ``WITH``), scripts and ``EXECUTE IMMEDIATE``.
    """
    bare = text.format(**{name: f"`{name}`" for name in relations}) if relations else text
    if not _is_query(spark, bare):
        raise ValueError("only queries are run here, not commands")
    return spark.sql(text, args=list(params), **relations)
