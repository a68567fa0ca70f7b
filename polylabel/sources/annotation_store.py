"""A stored table of annotations that may be appended to again and again.

The table is Parquet, partitioned by annotator. ``ingest`` merges arriving rows
with the stored rows of the annotators that occur among them, keeps the latest
per (annotator_id, text_id), and swaps the partitions of those annotators of
whom a row changes. The merged rows are written aside first, so the
table is never read and written by one job, and a failure before the swap
leaves it as it was. Rows are chosen by content, not by when they came: the
largest ``ingest_seq`` wins (null lowest), and of equal ones the greatest
(labels, text). So an append that is repeated, or run again after a failure,
changes nothing, and the order of appends does not matter. One writer at a time
is assumed.

What an append holds on disk besides the table is bounded by a copy of the
arriving and of the merged rows: texts are shuffled once, a slice of them at a
time, and a slice's arriving rows and shuffle files go before the next one.
Which annotators change, and how large they are, is found from rows with a
text's hashes in its place.

An annotator with a third of all rows is no hot group: rows are merged by the
full key and written in parts, more of them for an annotator with more rows. A
null and an empty annotator id are one annotator, null, as partition folders
know no empty name.
A null ``text_id`` is a key like any other. Annotator ids stay strings
("007" is not 7). Columns other than those named here are not stored.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DEFAULT_LABELS, LabelSet, require_columns
from ..session import BROADCAST_MAX_ROWS, bounded_broadcast, cut_lineage, ensure_checkpoint_dir
from .readers import annotation_worklist

FILE_BYTES = 64 << 20  # of an annotator's rows in a file, about
ROW_BYTES = 64         # of a row without its text, about
SLICES = 8             # of the texts, by their ids
PARTS_AT_ONCE = 16     # shuffled at a time, where that is not a slice of large annotators


def _schema(labels: LabelSet) -> T.StructType:
    return T.StructType([T.StructField("text_id", T.LongType()), T.StructField("text", T.StringType()),
                         *(T.StructField(n, T.IntegerType()) for n in labels.names),
                         T.StructField("ingest_seq", T.LongType()), T.StructField("annotator_id", T.StringType())])


def read_store(spark: SparkSession, path: str, labels: LabelSet = DEFAULT_LABELS, annotators=None) -> DataFrame:
    """The stored annotations, empty where nothing was ingested yet;
    ``annotators`` opens only these ids' folders."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], _schema(labels))
    df = spark.read.schema(_schema(labels)).parquet(path)
    return df if annotators is None else df.filter(F.col("annotator_id").isin([str(a) for a in annotators]))


def latest(annotations: DataFrame, labels: LabelSet = DEFAULT_LABELS, by=()) -> DataFrame:
    """One row per (annotator_id, text_id), by an aggregation. ``by`` are
    columns that follow from the key, by which the rows may be dealt."""
    row = F.struct("ingest_seq", *labels.names, "text")
    best = annotations.groupBy("annotator_id", *by, "text_id").agg(F.max(row).alias("r"))
    return best.select("text_id", "r.text", *(f"r.{n}" for n in labels.names), "r.ingest_seq", "annotator_id")


def _versions(rows: DataFrame, labels: LabelSet) -> DataFrame:
    """Rows with two hashes and the size of the text in its place."""
    return rows.select("annotator_id", "text_id", "ingest_seq", *labels.names, F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"),
                       (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).alias("size"))


def _changes(stored: DataFrame, arriving: DataFrame, labels: LabelSet) -> DataFrame:
    """(who, size, changed) per annotator from ``_versions``: the size of the
    merged rows, and whether any of them is not a stored one. Among the
    latest rows of a key that differ in their texts only, the greatest and
    the least hashes are looked at, so a key with other texts has changed."""
    both = stored.withColumn("old", F.lit(True)).unionByName(arriving.withColumn("old", F.lit(False)))
    rank = ["ingest_seq", *labels.names]
    ends = {"high": F.struct(*rank, "h1", "h2", "size"), "low": F.struct(*rank, F.bitwise_not("h1"), F.bitwise_not("h2"))}
    keys = both.groupBy("annotator_id", "text_id").agg(*(F.max(r).alias(k) for k, r in ends.items()),
                                                       *(F.max(F.when(F.col("old"), r)).alias(f"old_{k}") for k, r in ends.items()))
    same = F.col("high").eqNullSafe(F.col("old_high")) & F.col("low").eqNullSafe(F.col("old_low"))
    return keys.groupBy(F.col("annotator_id").alias("who")).agg(F.sum("high.size").alias("size"), F.max(~same).alias("changed"))


def _slice() -> Column:
    return F.pmod(F.xxhash64("text_id"), F.lit(SLICES)).cast("int")


def _delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _discard(df: DataFrame) -> None:
    """Delete a table that ``cut_lineage`` made."""
    uri = df.sparkSession.sparkContext._jvm.java.net.URI
    _delete(df.sparkSession, *{uri(f.rsplit("/", 1)[0]) for f in df.inputFiles()})


def _swap(spark: SparkSession, aside: str, path: str) -> None:
    """The annotators' folders under ``aside`` take the place of those under
    ``path``."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: N806
    fs = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def move(a, b):
        if not fs.rename(a, b):
            raise OSError(f"{a} could not be renamed to {b}")
    fs.mkdirs(gone := Path(f"{aside}/_replaced"))
    for name in [f.getPath().getName() for f in fs.listStatus(Path(aside))]:
        if name.startswith("annotator_id="):
            new, at, old = Path(Path(aside), name), Path(Path(path), name), Path(gone, name)
            had = fs.exists(at)
            if had:
                move(at, old)
            try:
                move(new, at)
            except Exception:
                if had:
                    move(old, at)
                raise
    spark.catalog.refreshByPath(path)


def ingest(annotations: DataFrame, path: str, labels: LabelSet = DEFAULT_LABELS, files: int | None = None) -> None:
    """Merge ``annotations`` (annotator_id, text_id, text, ingest_seq,
    labels) into the table at ``path``. Without rows nothing is written.
    Without ``files`` an annotator has a part per ``FILE_BYTES`` of rows."""
    require_columns(annotations, ["annotator_id", "text_id", "text", "ingest_seq", *labels.names], "annotations")
    spark = annotations.sparkSession
    who = F.col("annotator_id").cast("string")
    typed = {f.name: F.col(f.name).cast(f.dataType) for f in _schema(labels)} | {"annotator_id": F.when(who != "", who)}
    run = uuid.uuid4().hex
    texts, aside = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/arriving-texts-{run}", f"{path.rstrip('/')}/.merged-{run}"
    cut = []
    try:
        typed_rows = annotations.select(*(c.alias(n) for n, c in typed.items())).withColumn("slice", _slice())
        typed_rows.write.option("compression", "zstd").partitionBy("slice").parquet(texts)
        kinds = _schema(labels).add("slice", T.IntegerType())
        read = lambda: spark.read.schema(kinds).parquet(texts)
        cut.append(arriving := cut_lineage(_versions(read(), labels), "arriving"))
        touched = bounded_broadcast(arriving.select(F.col("annotator_id").alias("who")).distinct())
        stored = read_store(spark, path, labels).join(touched, F.col("annotator_id").eqNullSafe(F.col("who")), "left_semi")
        number = F.ceil(F.col("size") / FILE_BYTES).cast("int") if files is None else F.lit(files)
        cut.append(merged := cut_lineage(_changes(_versions(stored, labels), arriving, labels).select("who", "changed", number.alias("parts")), "merged"))
        changed = merged.filter("changed").drop("changed")
        whos, parts, small = changed.agg(F.count(F.lit(1)), F.sum("parts"), F.sum(F.when(F.col("parts") < SLICES, F.col("parts")))).first()
        if not whos:
            return

        def write(own: DataFrame, where: Column, n: int) -> None:
            """Merge and write the rows of some annotators and slices."""
            own = F.broadcast(own) if whos <= BROADCAST_MAX_ROWS else own
            rows = read_store(spark, path, labels).withColumn("slice", _slice()).unionByName(read()).filter(where)
            rows = rows.join(own, F.col("annotator_id").eqNullSafe(F.col("who")))
            rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "text_id"), "parts")).repartition(max(2 * n, 1), "annotator_id", "part")
            latest(rows, labels, by=["part"]).write.mode("append").option("compression", "zstd").partitionBy("annotator_id").parquet(aside)
            # Shuffle files go when the driver's JVM collects the finished plan.
            gc.collect()
            spark.sparkContext._jvm.System.gc()

        if parts <= PARTS_AT_ONCE:
            write(changed, F.lit(True), parts)
        else:
            # an annotator of few parts is written at once, then the others by one or more slices
            small = small or 0
            groups = min(-(-small // PARTS_AT_ONCE), SLICES)
            for k in range(groups):
                write(changed.filter((F.col("parts") < SLICES) & (F.pmod(F.xxhash64("who"), F.lit(groups)) == k)), F.lit(True), -(-small // groups))
            large = parts - small
            step = max(1, min(SLICES, SLICES * PARTS_AT_ONCE // 2 // max(large, 1)))
            own = changed.filter(F.col("parts") >= SLICES).withColumn("parts", F.ceil(F.col("parts") * step / SLICES).cast("int"))
            for k in range(0, SLICES if large else 0, step):
                write(own, F.col("slice").between(k, k + step - 1), -(-large * step // SLICES))
                _delete(spark, *(f"{texts}/slice={i}" for i in range(k, min(k + step, SLICES))))
        _swap(spark, aside, path)
    finally:
        _delete(spark, texts, aside)
        for df in cut:
            _discard(df)


def worklist(texts: DataFrame, path: str, annotator_ids, labels: LabelSet = DEFAULT_LABELS, id_col: str = "row_id") -> DataFrame:
    """What each annotator still has to do by the stored table."""
    done = read_store(texts.sparkSession, path, labels, annotator_ids)
    return annotation_worklist(texts, done, annotator_ids, id_col)
