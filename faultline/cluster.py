"""Session settings and durable intermediate results."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest lookup table (rows) that may be turned into a literal dictionary or broadcast on purpose.
# Anything beyond it goes through a shuffle join.
DICTIONARY_ROWS = 50_000
# Rows of narrow tables that one task sorts or groups, where the number of tasks is set by the rows.
TASK_ROWS = 1_000_000


def local_session(cpus: str | int = "*", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("faultline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets a fresh temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    made = tempfile.mkdtemp(prefix="faultline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stage_path(spark: SparkSession, name: str) -> str:
    """Fresh path for a stage table in the shared folder."""
    return f"{shared_dir(spark)}/faultline/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for a scan with fewer tasks than cores, such as one small file.

    A large table already has more splits than cores; it is returned unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal ``rows`` rows by key to as many tasks as TASK_ROWS asks for, the configured number at least.

    Spark merges small partitions by their compressed bytes, which say little of the memory that narrow rows take; a number
    that is asked for stays.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, math.ceil(rows / TASK_ROWS)), *keys)
