"""Spark session helpers.

On a cluster the session comes from the platform and carries its own sizing
(shuffle partitions, executor memory, checkpoint folder). Nothing here
overrides a value that is already set; the local defaults below only fill in
what a bare ``local[N]`` session lacks.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

# Settings every query relies on for correct results.
_REQUIRED = {
    # Timestamps in the data model are UTC wall-clock values.
    "spark.sql.session.timeZone": "UTC",
}

# Settings that make the plans scale: runtime re-planning, skew splitting,
# and coalescing of small shuffle partitions.
_SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # state on disk instead of the heap; also what list state and timers need
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "sluice") -> SparkSession:
    """Create (or reuse) a session for local runs and tests."""
    master = master or os.environ.get("SLUICE_MASTER", "local[8]")
    conf = SparkConf().setMaster(master).setAppName(app_name).setAll([
        ("spark.ui.enabled", "false"),
        ("spark.ui.showConsoleProgress", "false"),
        ("spark.sql.shuffle.partitions", str(shuffle_partitions)),
        ("spark.driver.memory", os.environ.get("SLUICE_DRIVER_MEMORY", "16g")),
        ("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024)),
        *{**_REQUIRED, **_SCALE_DEFAULTS}.items()])
    spark = SparkSession(SparkContext.getOrCreate(conf))
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to a session made elsewhere."""
    for key, value in _REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in _SCALE_DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def cpu_partitions(spark: SparkSession) -> int:
    """Partition count for CPU-bound stages whose input is small in bytes.

    AQE sizes shuffle partitions by bytes and would merge such a stage into a
    few tasks; an explicit count of at least one partition per core (or the
    configured shuffle partitions, if larger) keeps every core busy.
    """
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    try:
        cores = spark.sparkContext.defaultParallelism
    except Exception:  # no SparkContext on this client (e.g. Spark Connect)
        cores = shuffle
    return max(cores, shuffle)


#: Stored input bytes for each task of a CPU-bound stage.
TASK_BYTES = 4 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` is read from; 0 if there are none."""
    spark = df.sparkSession
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    except Exception:  # no JVM on this client (e.g. Spark Connect)
        return 0
    held = 0
    for name in df.inputFiles():
        file = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        held += file.getFileSystem(conf).getFileStatus(file).getLen()
    return held


def input_partitions(df: DataFrame) -> int:
    """Partition count for CPU-bound stages over rows that come from ``df``: one for
    each ``TASK_BYTES`` of its input files, at least ``cpu_partitions``, so that a
    task's share stays the same however large the input is."""
    return max(cpu_partitions(df.sparkSession), -(-input_bytes(df) // TASK_BYTES))


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, seen by every executor."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage and fixes values that a re-run could order
    differently; a lost executor costs a re-read, not a recomputation.
    """
    path = shared_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cutting lineage.

    A cluster names it in ``spark.checkpoint.dir``; that value is always used.
    Only a session without one (local tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # no shared folder configured: a local session (tests, benchmarks)
    local = tempfile.mkdtemp(prefix="sluice-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local
