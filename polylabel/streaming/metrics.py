"""Streaming forms (H1, H2).

H1: the per-epoch metric accumulators of the reference (update per batch,
compute, reset per epoch) are a Structured Streaming aggregation of counts
keyed by the grouping columns (e.g. run, epoch). Only mergeable sums are
kept in state -- one row per group, so no watermark is needed -- and the
metrics are derived from the sums afterwards, so the streaming result equals
the batch result exactly.

H2: cleaning, label mapping and scoring are stateless row expressions, so
the batch column functions apply unchanged to a streaming DataFrame in
append mode.

A sink's checkpoint lies beside its output, under a name that does not change
between starts, so a restarted query resumes from its committed offsets. What a
stream appends goes to Parquet, never to the driver; only the metric counts,
one row per group, use a memory table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..schema import DEFAULT_LABELS, LabelSet
from ..session import ensure_checkpoint_dir


def read_parquet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Stream a Parquet table: a folder with files of any names, or one file.
    (The last letter stands as a class, as the source takes a single file only
    from a path with a pattern.) A path without files is an error: a stream
    would silently be empty."""
    if not spark.read.schema(schema).parquet(path).inputFiles():
        raise FileNotFoundError(f"no files in {path}")
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(files_per_trigger))
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def stream_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream that runs once."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def metric_counts_stream(scored_stream: DataFrame, labels: LabelSet = DEFAULT_LABELS,
                         group_cols=()) -> DataFrame:
    """H1: streaming aggregation of every metric sum, per group."""
    return M.metric_sums(scored_stream, labels, group_cols)


def run_appending(stream: DataFrame, name: str) -> DataFrame:
    """Run an appending stream over everything available now into Parquet and
    read that back."""
    spark = stream.sparkSession
    path = f"{stream_folder(spark, name)}/out"
    q = write_stream(stream, path, available_now=True)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_counts(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream of complete counts (a row per group) over everything
    available now into a memory table and return that as a batch DataFrame."""
    spark = stream.sparkSession
    qname = f"{name}_{uuid.uuid4().hex[:12]}"
    q = (stream.writeStream.format("memory").queryName(qname).outputMode("complete")
         .option("checkpointLocation", f"{stream_folder(spark, name)}/checkpoint")
         .trigger(availableNow=True).start())
    try:
        q.awaitTermination()
    finally:
        q.stop()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.table(qname)


def streaming_per_label_metrics(scored_stream: DataFrame, labels: LabelSet = DEFAULT_LABELS,
                                group_cols=()) -> DataFrame:
    """H1 end to end: complete-mode counts, then D7 from the sums."""
    sums = run_counts(metric_counts_stream(scored_stream, labels, group_cols), "metric_counts")
    return M.per_label_from_sums(sums, labels, group_cols)


def write_stream(stream: DataFrame, path: str, checkpoint: str | None = None, partition_by=(), available_now: bool = False):
    """H2 sink: append cleaned/scored rows to Parquet; returns the started
    query. The checkpoint (by default ``<path>_checkpoint``) keeps its place,
    so starting the same sink again goes on where it stopped and writes each
    row once."""
    w = (stream.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint or f"{path.rstrip('/')}_checkpoint")
         .outputMode("append"))
    if partition_by:
        w = w.partitionBy(*partition_by)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def clean_and_score_stream(docs_stream: DataFrame, clean, score) -> DataFrame:
    """H2: stateless per-row cleaning and scoring of arriving text."""
    return score(docs_stream.withColumn("text", clean(F.col("text"))))
