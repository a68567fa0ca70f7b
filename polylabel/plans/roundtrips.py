"""Queries that write the given tables through a sink and read them back
through its source, with their DuckDB twins. Everything is written into the
session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as LF
from ..functions import text as TF
from ..operators import agreement as AG
from ..operators import features as FE
from ..operators import sampling as S
from ..schema import DEFAULT_LABELS as L
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as FX
from ..sources import readers as R
from ..sources import sinks
from . import oracle as O

N = L.names


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/roundtrips/{name}-{uuid.uuid4().hex}"


def labelled_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: a labelled CSV with quotes, commas and line breaks in its texts,
    read with a schema, its columns checked."""
    path = _folder(spark, "csv")
    text = F.concat(F.lit('"'), F.col("text"), F.lit('"\n, end'))
    FX.labelled(spark, sf_dir).select("row_id", text.alias("text"), *N).write.option("header", True).option("escape", '"').csv(path)
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("text", T.StringType())]
                          + [T.StructField(n, T.IntegerType()) for n in N])
    back = R.validate_labelled(R.read_labelled_csv(spark, path, L, schema), L)
    return back.select("row_id", F.md5("text").alias("text_md5"), *N)


def split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split folders, read back one split at a time."""
    path = _folder(spark, "splits")
    split = S.stratified_split(FX.labelled(spark, sf_dir), L)
    sinks.write_splits(split.select("row_id", "stratum", "split"), path)
    back = spark.read.parquet(path)
    return back.filter("split = 'val'").unionByName(back.filter("split = 'train'")).select("row_id", "stratum", "split")


def slim_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slim predictions, written and read back."""
    path = _folder(spark, "slim")
    sinks.slim_predictions(FX.scored(spark, sf_dir), L).write.parquet(path)
    return spark.read.parquet(path)


def three_split_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + A6 + A4: the list corpus in its three published splits, renamed,
    mapped and counted per split."""
    raw = FX.list_labelled(spark, sf_dir)
    part = F.pmod("row_id", F.lit(10))
    frames = {"train": raw.filter(part < 8), "validation": raw.filter(part == 8), "test": raw.filter(part == 9)}
    mapped = R.tag_split({k: R.map_list_corpus(df, labels=L) for k, df in frames.items()})
    return mapped.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), *(F.sum(n).cast("long").alias(n) for n in N))


def latest_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of which every second text was submitted again with
    the opposite labels; the later one counts."""
    first = FX.annotations(spark, sf_dir).select("annotator_id", "text_id", *N, F.lit(1).alias("ingest_seq"))
    again = first.filter("text_id % 2 = 0").select("annotator_id", "text_id", *((1 - F.col(n)).alias(n) for n in N), F.lit(2).alias("ingest_seq"))
    return R.latest_annotations(first.unionByName(again)).select("annotator_id", "text_id", "ingest_seq", *N)


def unmatched_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations whose text has no prediction, counted per annotator
    (the texts' ids are moved on, so that some have none)."""
    moved = FX.annotations(spark, sf_dir).withColumn("text_id", F.col("text_id") + 50)
    return AG.unmatched_annotations(FX.scored(spark, sf_dir), moved)


def encoding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 + B20: the cached encoding, written and then served from its
    folder."""
    lab, path = FX.labelled(spark, sf_dir), _folder(spark, "encoded")
    FE.cached_encoding(lab, path, max_length=128, vocab_size=5000)
    enc = FE.cached_encoding(lab, path, max_length=128, vocab_size=5000)
    return enc.select("row_id", F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"), "n_tokens", "truncated")


def logit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and predictions from logits."""
    df = FX.scored(spark, sf_dir)
    logit = lambda n: (F.col(L.prob(n)) - 0.5) * 12
    probs = df.select("row_id", *(LF.sigmoid(logit(n)).alias(f"prob_{n}") for n in N))
    return probs.select("row_id", *(F.round(f"prob_{n}", 6).alias(f"prob_{n}") for n in N),
                        *(LF.threshold(F.col(f"prob_{n}")).alias(f"pred_{n}") for n in N))


def unicode_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1-B4 on texts with signs that are no emoji, emoji in several forms,
    white space beyond ASCII and null texts."""
    d = F.col("doc_id")
    text = (F.when(d % 5 == 0, F.concat(F.lit("→ ★ ✓ "), F.col("text")))
            .when(d % 5 == 1, F.concat(F.col("text"), F.lit(" ✔️\U0001F1E9\U0001F1EA")))
            .when(d % 5 == 2, F.replace(F.col("text"), F.lit(" "), F.lit("  ")))
            .when(d % 5 == 3, F.concat(F.lit("[USER] "), F.col("text"))))
    df = FX.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), TF.clean_text(text).alias("clean"))
    return df.select("row_id", F.md5("clean").alias("text_md5"), (F.col("clean") == "").alias("is_empty"))


_LABS = ", ".join(N)
# White_Space beyond what the engine's \s holds, spelled out
_UNI = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

QUERIES = {f.__name__: f for f in (labelled_csv, split_tables, slim_predictions, three_split_ingest, latest_annotations,
                                   unmatched_annotations, encoding_cache, logit_scores, unicode_clean)}
ORACLE = {
    "labelled_csv": f"""WITH {O.LAB_CTE}
SELECT row_id, md5('"' || text || '"' || chr(10) || ', end') AS text_md5, {_LABS} FROM lab""",
    "split_tables": O.STRATIFIED,
    "slim_predictions": f"""WITH {O.SCORED_CTE}
SELECT row_id, {", ".join(L.pred_cols + L.true_cols)} FROM scored""",
    "three_split_ingest": f"""WITH {O.LIST_CTE}
SELECT CASE WHEN row_id % 10 < 8 THEN 'train' WHEN row_id % 10 = 8 THEN 'val' ELSE 'test' END AS split,
  count(*) AS n_rows, {", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in N)}
FROM lstf GROUP BY 1""",
    "latest_annotations": f"""WITH {O.ANN_CTE}
SELECT annotator_id, text_id, CAST(CASE WHEN text_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS ingest_seq,
  {", ".join(f"CAST(CASE WHEN text_id % 2 = 0 THEN 1 - true_{n} ELSE true_{n} END AS INTEGER) AS {n}" for n in N)} FROM ann""",
    "unmatched_annotations": f"""WITH {O.ANN_CTE}
SELECT annotator_id, count(*) AS n_unmatched FROM ann
WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.row_id = ann.text_id + 50) GROUP BY annotator_id""",
    "encoding_cache": O.ENCODE,
    "logit_scores": f"""WITH {O.SCORED_CTE},
z AS (SELECT row_id, {", ".join(f"1.0e0 / (1.0e0 + exp(-((prob_{n} - 0.5e0) * 12))) AS p_{n}" for n in N)} FROM scored)
SELECT row_id, {", ".join(f"round(p_{n}, 6) AS prob_{n}" for n in N)},
  {", ".join(f"CASE WHEN p_{n} > 0.5e0 THEN 1 ELSE 0 END AS pred_{n}" for n in N)} FROM z""",
    "unicode_clean": f"""WITH t AS (SELECT doc_id AS row_id, CASE doc_id % 5
    WHEN 0 THEN '→ ★ ✓ ' || text WHEN 1 THEN text || ' ✔️\U0001F1E9\U0001F1EA'
    WHEN 2 THEN replace(text, ' ', '  ') WHEN 3 THEN '[USER] ' || text END AS x FROM documents),
c AS (SELECT row_id, replace(replace(replace(trim(regexp_replace(regexp_replace(coalesce(x, ''), '{O.EMOJI}', '', 'g'), '{_UNI}', ' ', 'g')),
    '[NAME]', ''), '[USER]', ''), '[URL]', '') AS clean FROM t)
SELECT row_id, md5(clean) AS text_md5, clean = '' AS is_empty FROM c""",
}
