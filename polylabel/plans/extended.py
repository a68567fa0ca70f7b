"""Queries on state and tables that grow by appends, on large label sets and on
draws with replacement, with their DuckDB twins. Everything is written into
the session's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import epoch_draws as ED
from ..operators import label_pairs as LP
from ..operators import sampling as S
from ..schema import DEFAULT_LABELS as L
from ..sources import annotation_store as AS
from ..sources import fixtures as FX
from ..streaming import accumulators as AC
from ..streaming import metrics as SM
from . import oracle as O
from .catalog import _joined
from .roundtrips import _folder

N = L.names
WIDE, PER_ROW = 1000, 20  # labels of the large set, and draws of them per document


def accumulated_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 + D21: per-label counts by run, phase and epoch, from a stream that
    comes in several micro-batches and is upserted into a state table."""
    path, d = _folder(spark, "accumulated"), F.col("row_id")
    scored = FX.scored(spark, sf_dir).select(
        F.concat(F.lit("r"), d % 2).alias("run"), F.when(d % 10 < 8, "train").otherwise("val").alias("phase"), (d % 3).alias("epoch"),
        *L.true_cols, *L.pred_cols)
    scored.repartition(3).write.parquet(f"{path}/scored")
    stream = SM.read_parquet_stream(spark, f"{path}/scored", scored.schema, files_per_trigger=1)
    AC.accumulate(stream, path, L).awaitTermination()
    return AC.per_label(spark, path, L).select(*AC.KEYS, "label", "tp", "fp", "fn", "tn", F.round("f1", 6).alias("f1"))


def _submitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Annotations, and every second of them again with opposite labels."""
    first = FX.annotations(spark, sf_dir).withColumn("ingest_seq", F.lit(1))
    again = first.filter("text_id % 2 = 0").withColumns({n: 1 - F.col(n) for n in N} | {"ingest_seq": F.lit(2)})
    return first, again


def stored_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to the stored table, and the first one repeated, which
    changes nothing."""
    path = _folder(spark, "annotations")
    first, again = _submitted(spark, sf_dir)
    for part in (first, again, first):
        AS.ingest(part, path, L)
    return AS.read_store(spark, path, L).select("annotator_id", "text_id", F.md5("text").alias("text_md5"), "ingest_seq", *N)


def stored_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9a + A9b: what is left to do after an append of a part of the
    annotations, by the stored table."""
    path = _folder(spark, "annotations")
    AS.ingest(_submitted(spark, sf_dir)[0].filter("text_id % 4 <> 1"), path, L)
    texts = FX.labelled(spark, sf_dir).select("row_id", "text")
    return AS.worklist(texts, path, [f"A{k}" for k in FX.ANNOTATORS], L).select("annotator_id", "text_id")


def sparse_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 over the class ids of the list corpus."""
    return LP.cooccurrence(FX.list_labelled(spark, sf_dir), "labels")


def wide_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 over a set of 1,000 labels, 20 of them (or fewer) per document."""
    d = F.col("doc_id")
    ids = F.transform(F.sequence(F.lit(0), F.lit(PER_ROW - 1)), lambda i: (d * (2 * i + 1) + i * i) % WIDE)
    return LP.cooccurrence(FX.table(spark, sf_dir, "documents").select(ids.alias("ids")), "ids", symmetric=False)


def sparse_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14 + G1 from sparse arrays; equals ``confusion_pairs``."""
    out = LP.ranked_confusions(LP.dense_ids(_joined(spark, sf_dir), L), "true_ids", "pred_ids", len(N) ** 2)
    name = lambda c: F.element_at(F.array(*map(F.lit, N)), F.col(c) + 1)
    return out.select(name("true_id").alias("true_label"), name("pred_id").alias("pred_label"),
                      F.col("true_id").alias("true_index"), F.col("pred_id").alias("pred_index"), "n", "rank")


def epoch_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 + F6: an epoch of a weighted sampler, as many draws with replacement
    as there are rows; how often each drawn row comes."""
    rows = S.sample_weights(FX.labelled(spark, sf_dir).select("row_id", *N), L)
    return ED.drawn_counts(rows, "weight", rows.count())


_COUNTS = ", ".join(f"sum(CASE WHEN true_{n} = {t} AND pred_{n} = {p} THEN 1 ELSE 0 END) AS {k}_{n}"
                    for n in N for k, t, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))
_LABS = ", ".join(N)

QUERIES = {f.__name__: f for f in (accumulated_metrics, stored_annotations, stored_worklist, sparse_cooccurrence, wide_cooccurrence,
                                   sparse_confusions, epoch_draws)}
ORACLE = {
    "accumulated_metrics": f"""WITH {O.SCORED_CTE},
g AS (SELECT 'r' || (row_id % 2) AS run, CASE WHEN row_id % 10 < 8 THEN 'train' ELSE 'val' END AS phase, row_id % 3 AS epoch, {_COUNTS}
  FROM scored GROUP BY 1, 2, 3),
r AS ({" UNION ALL ".join(f"SELECT run, phase, epoch, '{n}' AS label, tp_{n} AS tp, fp_{n} AS fp, fn_{n} AS fn, tn_{n} AS tn FROM g" for n in N)})
SELECT run, phase, epoch, label, {", ".join(f"CAST({k} AS BIGINT) AS {k}" for k in ("tp", "fp", "fn", "tn"))},
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM r""",
    "stored_annotations": f"""WITH {O.ANN_CTE}
SELECT annotator_id, text_id, md5(d.text) AS text_md5, CAST(CASE WHEN text_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS ingest_seq,
  {", ".join(f"CAST(CASE WHEN text_id % 2 = 0 THEN 1 - true_{n} ELSE true_{n} END AS INTEGER) AS {n}" for n in N)}
FROM ann JOIN documents d ON d.doc_id = text_id""",
    "stored_worklist": f"""WITH w AS (SELECT doc_id AS text_id, unnest([{", ".join(map(str, FX.ANNOTATORS))}]) AS k FROM documents)
SELECT 'A' || k AS annotator_id, text_id FROM w WHERE text_id % k <> 0 OR text_id % 4 = 1""",
    "sparse_cooccurrence": f"""WITH i AS (SELECT DISTINCT doc_id, CAST((doc_id * unnest([{", ".join(map(str, FX.LIST_ID_FACTORS))}])) % {FX.N_LIST_CLASSES} AS INTEGER) AS c
  FROM documents)
SELECT x.c AS a, y.c AS b, count(*) AS n FROM i x JOIN i y ON x.doc_id = y.doc_id GROUP BY 1, 2""",
    "wide_cooccurrence": f"""WITH k AS (SELECT doc_id, unnest(range(0, {PER_ROW})) AS i FROM documents),
i AS (SELECT DISTINCT doc_id, (doc_id * (2 * i + 1) + i * i) % {WIDE} AS c FROM k)
SELECT x.c AS a, y.c AS b, count(*) AS n FROM i x JOIN i y ON x.doc_id = y.doc_id AND x.c <= y.c GROUP BY 1, 2""",
    "sparse_confusions": O.CONFUSION_PAIRS,
    "epoch_draws": f"""WITH {O.SAMPLE_WEIGHTS_CTE},
u AS (SELECT {ED.BITS} - 1 - floor(log2(CAST(sum(CAST(weight AS DECIMAL(38, 18))) AS DOUBLE))) AS bits, count(*) AS k FROM wts),
sz AS (SELECT row_id, CAST(floor(weight * pow(2, bits)) AS BIGINT) AS size FROM wts, u),
sp AS (SELECT row_id, sum(size) OVER (ORDER BY {O._key()}, row_id ROWS UNBOUNDED PRECEDING) - size AS start FROM sz WHERE size > 0),
dr AS (SELECT unnest(range(0, k)) AS j FROM u),
pt AS (SELECT (CAST({O._draw("j", "'with replacement'", digits=15)} AS HUGEINT) * (SELECT sum(size) FROM sz)) // 1152921504606846976 AS at FROM dr)
SELECT row_id, count(*) AS times FROM pt ASOF JOIN sp ON pt.at >= sp.start GROUP BY row_id""",
}
