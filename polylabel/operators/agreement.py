"""Model-vs-human agreement.

All annotators are compared in one pass: annotations (annotator_id,
text_id, <label>...) are equi-joined to the model's predictions on the text
key, then grouped by annotator_id. The join is left to Catalyst/AQE (it
broadcasts the annotation side at runtime when that side is small, and
sort-merges otherwise); grouping uses partial aggregation, so an annotator
with a third of all rows costs no more than the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as LF
from ..schema import DEFAULT_LABELS, LabelSet
from . import metrics as M


def join_annotations(predictions: DataFrame, annotations: DataFrame,
                     labels: LabelSet = DEFAULT_LABELS, id_col: str = "row_id",
                     how: str = "inner") -> DataFrame:
    """Annotations with the model's predictions of the same text. Human
    labels become ``true_<label>``, model labels stay ``pred_<label>``."""
    preds = predictions.select(F.col(id_col).alias("text_id"), *labels.pred_cols)
    human = annotations.select("annotator_id", "text_id", "text",
                               *[F.col(n).cast("int").alias(labels.true(n)) for n in labels.names])
    return human.join(preds, "text_id", how)


def agreement(joined: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """D17 + D18 per (annotator_id, label): agreement, disagreement rate,
    false-positive rate and false-negative rate (model vs human; FPR/FNR 0
    when their denominator is 0, agreement null on zero rows), plus the
    annotator's exact-match ratio (= subset accuracy) and Hamming loss."""
    sums = M.metric_sums(joined, labels, group_cols=("annotator_id",))
    per = M.per_label_from_sums(sums, labels, group_cols=("annotator_id",))
    summ = M.summary_from_sums(sums, labels, group_cols=("annotator_id",))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    tot = tp + fp + fn + tn
    per = per.select(
        "annotator_id", "label", "label_index", "tp", "fp", "fn", "tn",
        F.round(F.when(tot > 0, (tp + tn) / tot), 6).alias("agreement"),
        F.round(F.when(tot > 0, (fp + fn) / tot), 6).alias("disagreement_rate"),
        F.round(LF.safe_div(fp, fp + tn), 6).alias("false_positive_rate"),
        F.round(LF.safe_div(fn, fn + tp), 6).alias("false_negative_rate"))
    return per.join(summ.select("annotator_id", "n", "exact_match_ratio",
                                F.col("exact_match_ratio").alias("subset_accuracy"), "hamming_loss"),
                    "annotator_id")


def unmatched_annotations(predictions: DataFrame, annotations: DataFrame,
                          id_col: str = "row_id") -> DataFrame:
    """Annotations whose text_id has no prediction (the reference raises an
    index error there): a count per annotator."""
    keys = predictions.select(F.col(id_col).alias("text_id"))
    miss = annotations.join(keys, "text_id", "left_anti")
    return miss.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n_unmatched"))


def disagreement_examples(joined: DataFrame, labels: LabelSet = DEFAULT_LABELS, k: int = 3) -> DataFrame:
    """G3 (+ Q16: every label, not only the last): per (annotator, label,
    kind) the first ``k`` error texts by text_id with the other side's
    labels, and the total count of that error kind.

    kind ``fp``: model predicted the label, human did not (other side =
    human labels); ``fn``: human marked it, model missed it (other side =
    model labels). Totals come from a partial aggregation; the examples from
    ``row_number() <= k``, which Spark plans with a window group limit that
    keeps only k rows per group in each task before the shuffle."""
    rows = []
    for i, n in enumerate(labels.names):
        t, p = F.col(labels.true(n)), F.col(labels.pred(n))
        rows.append(F.when(p > t, F.struct(F.lit(n).alias("label"), F.lit(i).alias("label_index"),
                                           F.lit("fp").alias("kind")))
                    .when(p < t, F.struct(F.lit(n).alias("label"), F.lit(i).alias("label_index"),
                                          F.lit("fn").alias("kind"))))
    errs = joined.select("annotator_id", "text_id", "text",
                         LF.label_string(labels.true_cols, labels.names).alias("human_labels"),
                         LF.label_string(labels.pred_cols, labels.names).alias("model_labels"),
                         F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("_e"))
    errs = errs.select("annotator_id", "text_id", "text", "human_labels", "model_labels",
                       "_e.label", "_e.label_index", "_e.kind")
    keys = ["annotator_id", "label", "kind"]
    totals = errs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"))
    w = Window.partitionBy(*keys).orderBy("text_id")
    ex = errs.withColumn("example_no", F.row_number().over(w)).filter(F.col("example_no") <= k)
    ex = ex.withColumn("other_labels", F.when(F.col("kind") == "fp", F.col("human_labels"))
                       .otherwise(F.col("model_labels")))
    return ex.join(totals, keys).select("annotator_id", "label", "label_index", "kind", "n_total",
                                        "example_no", "text_id", "text", "other_labels")


def raw_comparisons(joined: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """Per annotated text, the model's and the human's label names
    (``none`` when empty), keyed by (annotator_id, text_id)."""
    return joined.select(
        "annotator_id", "text_id", "text",
        LF.label_string(labels.pred_cols, labels.names, empty="none").alias("model_labels"),
        LF.label_string(labels.true_cols, labels.names, empty="none").alias("human_labels"))
