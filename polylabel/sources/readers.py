"""Sources (A1-A6, A8, A9): labelled CSVs, list- and single-label corpora,
annotation files. Explicit schemas, no inference; one clear error naming
every missing column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import labels as LF
from ..functions import text as TF
from ..schema import DEFAULT_LABELS, LabelSet, annotation_schema, require_columns

# Class-id -> target label map of the 28-class list corpus.
LIST_CLASS_MAP = {
    "anger": [2, 3],
    "fear": [14, 19],
    "joy": [13, 17, 18, 20],
    "sadness": [9, 16, 24, 25],
    "surprise": [22, 26],
}

# Class names of the 28-class list corpus (debug decoding).
LIST_CLASS_NAMES = {
    0: "admiration", 1: "amusement", 2: "anger", 3: "annoyance", 4: "approval",
    5: "caring", 6: "confusion", 7: "curiosity", 8: "desire", 9: "disappointment",
    10: "disapproval", 11: "disgust", 12: "embarrassment", 13: "excitement",
    14: "fear", 15: "gratitude", 16: "grief", 17: "joy", 18: "love",
    19: "nervousness", 20: "optimism", 21: "pride", 22: "realization",
    23: "relief", 24: "remorse", 25: "sadness", 26: "surprise", 27: "neutral",
}

# Single-label corpus class ids; ``love`` is not a target label.
SINGLE_CLASS_MAP = {0: "sadness", 1: "joy", 2: "love", 3: "anger", 4: "fear", 5: "surprise"}

# Split names as published -> our names.
SPLIT_NAMES = {"train": "train", "validation": "val", "test": "test"}


def read_labelled_csv(spark: SparkSession, path: str, labels: LabelSet = DEFAULT_LABELS,
                      schema: T.StructType | None = None) -> DataFrame:
    """A1: labelled CSV with RFC-4180 quoting (doubled quotes, embedded
    newlines). ``escape='"'`` is required: Spark's default backslash escape
    alters rows with quotes."""
    reader = (spark.read.option("header", True).option("multiLine", True)
              .option("escape", '"').option("mode", "FAILFAST"))
    df = reader.schema(schema).csv(path) if schema is not None else \
        reader.option("inferSchema", False).csv(path)
    return df


def validate_labelled(df: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """A1 check: ``text`` and every label column must exist (one error naming
    all missing columns); label columns are cast to int. A set whose label
    columns are all null is an unlabelled set (see ``metrics.unlabelled_check``)."""
    require_columns(df, ["text"] + list(labels.names), "labelled table")
    return df.withColumns({n: F.col(n).cast("int") for n in labels.names})


def tag_split(frames: dict[str, DataFrame], name_map: dict[str, str] = SPLIT_NAMES) -> DataFrame:
    """Union the per-split tables with a ``split`` column (renamed
    through ``name_map``)."""
    out = None
    for split, df in frames.items():
        tagged = df.withColumn("split", F.lit(name_map.get(split, split)))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def split_counts(df: DataFrame) -> DataFrame:
    """D22."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def map_list_corpus(df: DataFrame, class_map: dict[str, list[int]] = LIST_CLASS_MAP,
                    labels: LabelSet = DEFAULT_LABELS, text_col: str = "text",
                    ids_col: str = "labels", drop_unlabelled: bool = True) -> DataFrame:
    """A4: clean text (B1-B4), class-id list -> multi-hot (B5), drop rows
    without any target label (B7). Empty text is kept (as the list corpus
    does)."""
    require_columns(df, [text_col, ids_col], "list-labelled corpus")
    hot = LF.multihot_from_ids(ids_col, {n: class_map[n] for n in labels.names})
    out = df.withColumn(text_col, TF.clean_text(text_col)).withColumns(hot)
    if drop_unlabelled:
        out = out.filter(LF.total(labels.names) > 0)
    return out


def map_single_corpus(df: DataFrame, class_map: dict[int, str] = SINGLE_CLASS_MAP,
                      labels: LabelSet = DEFAULT_LABELS, text_col: str = "text",
                      label_col: str = "label", love_to_joy: bool = False) -> DataFrame:
    """A5: clean text, drop empty text (B8), single class -> multi-hot.
    Class ``love`` maps to no target label unless ``love_to_joy``."""
    require_columns(df, [text_col, label_col], "single-label corpus")
    cmap = dict(class_map)
    if love_to_joy:
        cmap = {k: ("joy" if v == "love" else v) for k, v in cmap.items()}
    out = df.withColumn(text_col, TF.clean_text(text_col)).filter(F.col(text_col) != "")
    return out.withColumns(LF.multihot_from_class(label_col, cmap, labels))


def decode_examples(df: DataFrame, ids_col: str = "labels", k: int = 5,
                    order_col: str = "row_id") -> DataFrame:
    """First ``k`` rows with their class names (a debug sample; the
    limit is the feature)."""
    return df.orderBy(order_col).limit(k).select(
        order_col, "text", LF.decode_ids(ids_col, LIST_CLASS_NAMES).alias("class_names"))


def tag_source(df: DataFrame, source: str, labels: LabelSet = DEFAULT_LABELS,
               keep=("row_id",)) -> DataFrame:
    """Add a source tag and keep only text, labels, source (+ ``keep``)."""
    cols = [c for c in keep if c in df.columns] + ["text"] + list(labels.names)
    return df.select(*cols).withColumn("source", F.lit(source))


def union_sources(frames, allow_missing: bool = False) -> DataFrame:
    """Union by column name."""
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df, allowMissingColumns=allow_missing)
    return out


# ---------------------------------------------------------- annotations

# annotator id = last "_" part of the file name; the name may also be a folder
# of part files written by Spark (``human_annotations_A1.csv/part-...``)
ANNOTATOR_FROM_PATH = r"_([^_/]+)\.csv(/[^/]*)?$"


def read_annotations(spark: SparkSession, folder_or_glob: str, labels: LabelSet = DEFAULT_LABELS,
                     annotators=None) -> DataFrame:
    """Every ``human_annotations_<id>.csv`` in one scan; the annotator id
    is the last ``_`` part of the file name. ``annotators`` selects ids."""
    path = folder_or_glob if folder_or_glob.endswith(".csv") else \
        folder_or_glob.rstrip("/") + "/human_annotations_*.csv"
    df = (spark.read.schema(annotation_schema(labels)).option("header", True)
          .option("multiLine", True).option("escape", '"').csv(path))
    df = df.withColumn("annotator_id",
                       F.regexp_extract(F.col("_metadata.file_path"), ANNOTATOR_FROM_PATH, 1))
    if annotators is not None:
        df = df.filter(F.col("annotator_id").isin(list(annotators)))
    return df.select("annotator_id", "text_id", "text", *labels.names)


def write_annotations(annotations: DataFrame, folder: str, annotator_ids, labels: LabelSet = DEFAULT_LABELS,
                      mode: str = "overwrite") -> None:
    """One ``human_annotations_<id>.csv`` (a folder of part files) per
    annotator, in the column order ``text, text_id, <labels>`` that
    ``read_annotations`` expects."""
    for a in annotator_ids:
        (annotations.filter(F.col("annotator_id") == a).select("text", "text_id", *labels.names)
         .write.mode(mode).option("header", True).option("escape", '"')
         .csv(f"{folder.rstrip('/')}/human_annotations_{a}.csv"))


def annotation_worklist(texts: DataFrame, annotations: DataFrame, annotator_ids,
                        id_col: str = "row_id") -> DataFrame:
    """Per annotator, the texts not yet annotated (the resume
    point of an annotation session). ``annotator_ids`` is a short list of
    ids; each text row is fanned out to it with a literal array (no cross
    join), then the finished (annotator_id, text_id) pairs are removed with
    an anti join on the full key."""
    ids = F.array(*[F.lit(str(a)) for a in annotator_ids])
    todo = texts.select(F.col(id_col).alias("text_id"), "text",
                        F.explode(ids).alias("annotator_id"))
    done = annotations.select("annotator_id", "text_id")
    return todo.join(done, ["annotator_id", "text_id"], "left_anti")


def latest_annotations(annotations: DataFrame, order_col: Column | str = "ingest_seq") -> DataFrame:
    """Idempotent ingest; keep the latest row per (annotator_id,
    text_id). Partitioned by the key, so no group grows beyond the number of
    resubmissions of one text."""
    w = Window.partitionBy("annotator_id", "text_id").orderBy(F.col(order_col).desc()
                                                              if isinstance(order_col, str) else order_col)
    return annotations.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
