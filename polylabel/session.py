"""Session helpers.

Library code never creates a session on its own; it receives one. These
helpers exist for tests, the benchmark and command-line use, where a local
session is built with settings that mirror a cluster deployment (AQE on,
UI off, UTC, Arrow on).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "polylabel") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("POLYLABEL_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder. On a cluster the operator sets
    ``spark.checkpoint.dir`` to a shared folder and that value is used as is;
    without it a cluster session is an error. Only a single-process local
    session (tests, bench) gets a scratch folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="polylabel-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df, name: str = "stage"):
    """Materialise ``df`` as a Parquet table in the session's shared
    checkpoint folder and continue from it: lineage is cut, the data survives
    executor loss (unlike a local checkpoint), it is written once by the
    executors in a columnar, compressed form, and later scans get column
    pruning and statistics."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def spread(df, key: str, min_partitions: int | None = None):
    """Hash-repartition a file-backed ``df`` by ``key`` only when it comes
    from fewer files than the cluster can run tasks at once (one file often
    holds a single row group, i.e. one busy task). On a big input of many
    files this is a no-op, so no shuffle is added at scale; on small inputs
    the CPU-heavy text work is spread over all cores. The file count comes
    from the file index (no job). Hash partitioning (not round-robin) keeps
    row placement deterministic under task retries."""
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) < target:
        return df.repartition(target, key)
    return df


# Largest table (in rows) a library operator broadcasts after counting it.
BROADCAST_MAX_ROWS = 2_000_000


def bounded_broadcast(df, max_rows: int = BROADCAST_MAX_ROWS):
    """Broadcast ``df`` only when a count proves it small; otherwise return
    it unchanged so the planner picks a shuffle join. ``df`` should be a
    small aggregate: it is persisted so the count and the join share one
    computation."""
    from pyspark.sql import functions as F

    df = df.persist()
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df
