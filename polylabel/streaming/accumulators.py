"""Metric accumulators of a stream, kept on storage.

A stream of scored rows is summed per key, e.g. (run, phase, epoch), in update
mode: each micro-batch hands on the new totals of the keys that it touched, and
they replace those keys' rows of a Parquet state table. The table is a folder of
versions, one per micro-batch (``version=<batch id>``); the newest one that was
written to its end counts. A version is made from the newest one *before* its
batch, so a batch that is run again, after a failure at any point, makes the
same version again and nothing is counted twice. (It is never skipped: the
stream's own state is only kept once a batch's rows have been read.) Two versions are kept, so a
reader of the last one is not disturbed by the next.

State and table have one row per key; rows of the stream are never stored. The
checkpoint lies in the same folder as the table, so the two cannot part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..schema import DEFAULT_LABELS, LabelSet

KEYS = ("run", "phase", "epoch")


def _filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of the state table that were written to their end."""
    root, fs = _filesystem(spark, f"{path.rstrip('/')}/state")
    if not fs.exists(root):
        return []
    out = []
    for status in fs.listStatus(root):
        name = re.fullmatch(r"version=(\d+)", status.getPath().getName())
        if name and fs.exists(_filesystem(spark, f"{status.getPath().toString()}/_SUCCESS")[0]):
            out.append(int(name.group(1)))
    return sorted(out)


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest totals, one row per key; None before the first batch."""
    done = versions(spark, path)
    return spark.read.parquet(f"{path.rstrip('/')}/state/version={done[-1]}") if done else None


def upsert(path: str, key_cols):
    """A ``foreachBatch`` function: the rows of ``totals`` take the place of
    those with the same key in the state table. Null keys are equal."""
    path = path.rstrip("/")

    def run(totals: DataFrame, batch_id: int) -> None:
        spark = totals.sparkSession
        done = versions(spark, path)
        before = [v for v in done if v < batch_id]
        merged = totals
        if before:
            old = spark.read.parquet(f"{path}/state/version={before[-1]}")
            new = totals.select(*(F.col(k).alias(f"new_{i}") for i, k in enumerate(key_cols)))
            same = [F.col(k).eqNullSafe(F.col(f"new_{i}")) for i, k in enumerate(key_cols)]
            both = same[0]
            for s in same[1:]:
                both = both & s
            merged = old.join(new, both, "left_anti").unionByName(totals)
        # one row per key: a few files, however many tasks the stream has
        merged.coalesce(4).write.mode("overwrite").parquet(f"{path}/state/version={batch_id}")
        for v in before[:-1]:
            folder, fs = _filesystem(spark, f"{path}/state/version={v}")
            fs.delete(folder, True)
    return run


def accumulate(scored_stream: DataFrame, path: str, labels: LabelSet = DEFAULT_LABELS, key_cols=KEYS, sink=None):
    """Start summing ``scored_stream`` into the state table at ``path`` with
    all that is available now; started again, it goes on with what has come
    since. ``sink`` stands for ``upsert`` in tests. Returns the query."""
    path = path.rstrip("/")
    return (M.metric_sums(scored_stream, labels, key_cols).writeStream.outputMode("update")
            .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
            .foreachBatch(sink or upsert(path, key_cols)).start())


def per_label(spark: SparkSession, path: str, labels: LabelSet = DEFAULT_LABELS, key_cols=KEYS) -> DataFrame:
    """D7 per key from the state table."""
    return M.per_label_from_sums(read_state(spark, path), labels, key_cols)
