"""K3 evaluate, K4 compare_annotators, K5 train_and_select, K6
explain_corpus as compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agreement as AG
from ..operators import discrepancy as D
from ..operators import explain as X
from ..operators import metrics as M
from ..operators import model as MD
from ..schema import DEFAULT_LABELS, LabelSet


def evaluate(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS, examples: int = 10) -> dict[str, DataFrame]:
    """K3 on a Scored table (score once and persist it; Q22): every report
    section as a DataFrame. The per-label, summary and metric-table sections
    share one aggregation pass."""
    scored = scored.persist()
    if M.unlabelled_check(scored, labels.true_cols).first()["is_unlabelled"]:
        # Q21: an unlabelled set is not evaluated against all-zero truth
        raise ValueError("cannot evaluate an unlabelled table: every truth column is null")
    sums = M.metric_sums(scored, labels).persist()
    return {
        "per_label": M.per_label_from_sums(sums, labels),
        "summary": M.summary_from_sums(sums, labels),
        "exact_match": M.exact_match_summary(scored, labels),
        "cardinality": M.cardinality_histogram(scored, labels.true_cols),
        "confusion_matrix": M.confusion_matrix(scored, labels),
        "missing_extra": D.missing_extra(scored, labels),
        "confusion_pairs": D.confusion_pairs(scored, labels),
        "mismatch_examples": D.mismatch_examples(scored, labels, k=examples),
        "multilabel_examples": D.multilabel_examples(scored, labels),
        "metric_table": M.metric_table(scored, labels),
        "detailed": D.detailed_predictions(scored, labels),
    }


def compare_annotators(predictions: DataFrame, annotations: DataFrame,
                       labels: LabelSet = DEFAULT_LABELS) -> dict[str, DataFrame]:
    """K4: every annotator in one pass (the reference loops annotators)."""
    joined = AG.join_annotations(predictions, annotations, labels).persist()
    return {
        "agreement": AG.agreement(joined, labels),
        "examples": AG.disagreement_examples(joined, labels),
        "raw": AG.raw_comparisons(joined, labels),
        "advice": D.threshold_advice(joined, labels, group_cols=("annotator_id",)),
        "error_words": D.error_words(joined, labels, group_cols=("annotator_id",)),
        "unmatched": AG.unmatched_annotations(predictions, annotations),
    }


def train_and_select(train: DataFrame, val: DataFrame, labels: LabelSet = DEFAULT_LABELS,
                     epochs=(1, 2, 3, 5, 8), patience: int = 3, min_delta: float = 0.001):
    """K5: run history on the validation view, top-3 + last epochs, early
    stopping, and the model refit with the selected number of passes."""
    hist = MD.epoch_history(train, val, labels, epochs=epochs).persist()
    top = MD.top_epochs(hist)
    stop = MD.early_stop(hist, patience=patience, min_delta=min_delta)
    best = stop.first()["best_epoch"]
    model = MD.train(train, labels, max_iter=list(epochs)[max(best, 0)])
    return model, hist, top, stop


def explain_corpus(model: MD.MultiLabelModel, df: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """K6: attributions and occlusion for every document."""
    contrib = X.token_contributions(model, df).persist()
    return {"contributions": contrib,
            "top_attribution": X.top_tokens(contrib, "attribution", k),
            "top_occlusion": X.top_tokens(contrib, "occlusion", k),
            "scores": contrib.groupBy("row_id", "label").agg(F.first("prob").alias("prob"))}
