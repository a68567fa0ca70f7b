"""Training shards on storage (F7): seeded batches, written once, read by range.

``sampling.training_shards`` gives every row its shard, position and batch. The
writer deals runs of ``FILE_ROWS`` positions of a shard to tasks, sorts each by
position, and writes them under ``shard=<k>/``: one file for a shard of up to
that many rows, and no task that holds more than a few runs of a larger one. A
manifest, one row per shard, numbers the batches through all shards, so a
reader takes any range of batches by opening only the shards that hold it, and
an interrupted epoch goes on where it stopped.

Which rows a shard of one file holds, and in which order, and which run any row
is in, follows from the rows' seeded keys alone: another layout of the input
gives the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.sampling import DEFAULT_SEED, training_shards

FILE_ROWS = 1 << 14  # positions of a shard that one task writes together


def write_shards(df: DataFrame, path: str, n_shards: int, batch_size: int = 32, seed: int = DEFAULT_SEED,
                 id_col: str = "row_id", drop_last: bool = True) -> DataFrame:
    """Write the shards of ``df`` under ``path`` and return the manifest
    (shard, first_batch, batches, rows). A shard that got no row has no file
    and no manifest row. An existing folder is an error; the manifest is
    written last, so a folder without one is an unfinished write."""
    spark = df.sparkSession
    rows = training_shards(df, n_shards, batch_size, seed, id_col, drop_last)
    run = F.floor(F.col("position") / FILE_ROWS).alias("run")
    dealt = rows.withColumn("run", run).repartition("shard", "run").drop("run").sortWithinPartitions("shard", "position")
    dealt.write.mode("errorifexists").partitionBy("shard").parquet(f"{path}/rows")
    schema = [f for f in rows.schema.fields if f.name != "shard"]
    back = spark.read.schema(_schema(schema)).parquet(f"{path}/rows")
    per = back.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), (F.max("batch_in_shard") + 1).alias("batches"))
    # one row per shard from here on
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = per.select("shard", F.coalesce(F.sum("batches").over(before), F.lit(0)).alias("first_batch"), "batches", "rows")
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def _schema(fields):
    from pyspark.sql.types import LongType, StructField, StructType

    return StructType([*fields, StructField("shard", LongType())])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest").orderBy("shard")


def read_batches(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """The rows of the batches ``first`` to ``last`` (exclusive; to the end
    without it), with their number ``batch``. Only the shards that hold one of
    them are opened: the manifest's rows, one per shard, name them. A range
    beyond the end gives no rows."""
    rows = [(r["shard"], r["first_batch"], r["batches"]) for r in read_manifest(spark, path).collect()]
    hit = [(s, f) for s, f, n in rows if f + n > first and (last is None or f < last)]
    start = F.element_at(F.create_map(*(F.lit(x) for p in hit for x in p)), F.col("shard").cast("long")) if hit else F.lit(0).cast("long")
    back = spark.read.parquet(f"{path}/rows").filter(F.col("shard").isin([s for s, _ in hit]))
    out = back.withColumn("shard", F.col("shard").cast("long")).withColumn("batch", start + F.col("batch_in_shard"))
    return out.filter((F.col("batch") >= first) & (F.lit(True) if last is None else F.col("batch") < last))
