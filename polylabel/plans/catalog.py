"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
and derives its labelled / scored input in Spark (``sources.fixtures``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as LF
from ..functions import text as TF
from ..operators import agreement as AG
from ..operators import discrepancy as D
from ..operators import explain as X
from ..operators import features as FE
from ..operators import model as MD
from ..operators import metrics as M
from ..operators import sampling as S
from ..operators import stats as ST
from ..sources import readers as R
from ..streaming import metrics as SM
from . import corpus as K
from ..schema import DEFAULT_LABELS as L
from ..sources import fixtures as FX


# ---------------------------------------------------------------- metrics

def per_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 (flagship)."""
    return M.per_label_metrics(FX.scored(spark, sf_dir), L)


def macro_sample_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8-D10, D18."""
    return M.macro_sample_metrics(FX.scored(spark, sf_dir), L)


def cardinality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11."""
    return M.cardinality_histogram(FX.scored(spark, sf_dir), L.true_cols)


def exact_match_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11-D13."""
    return M.exact_match_summary(FX.scored(spark, sf_dir), L)


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D16."""
    return M.confusion_matrix(FX.scored(spark, sf_dir), L)


def bce_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D20."""
    return M.bce_loss(FX.scored(spark, sf_dir), L)


def row_set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B13-B16, B18 per row."""
    df = M.with_row_metrics(FX.scored(spark, sf_dir), L)
    return df.select(
        "row_id", "n_inter", "n_true", "n_pred", "n_union", "exact",
        F.round("jaccard", 6).alias("jaccard"),
        F.round("sample_precision", 6).alias("sample_precision"),
        F.round("sample_recall", 6).alias("sample_recall"),
        F.round("sample_f1", 6).alias("sample_f1"),
        F.concat_ws(", ", LF.missing_labels(L)).alias("missing"),
        F.concat_ws(", ", LF.extra_labels(L)).alias("extra"))


def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 on the second natural truth (labels table joined to documents)."""
    return M.per_label_metrics(FX.quality_scored(spark, sf_dir), FX.QUALITY_LABELS)


def unlabelled_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + D23 on the scored table's truth and probability columns."""
    return M.unlabelled_check(FX.scored(spark, sf_dir), L.true_cols, L.prob_cols)


# ------------------------------------------------------ sources and text

def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1-B4 on the dirty-text fixture."""
    df = FX.dirty_text(spark, sf_dir).withColumn("clean", TF.clean_text("text"))
    return df.select("row_id", F.md5("clean").alias("text_md5"),
                     F.length("clean").alias("n_chars"), (F.col("clean") == "").alias("is_empty"))


def multihot_from_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: B1-B5 + B7 on the list-labelled fixture."""
    df = R.map_list_corpus(FX.list_labelled(spark, sf_dir), labels=L)
    return df.select("row_id", *L.names, F.md5("text").alias("text_md5"))


def multihot_from_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: B1-B4 + B6 + B8 on the single-label fixture."""
    df = R.map_single_corpus(FX.single_labelled(spark, sf_dir), labels=L)
    return df.select("row_id", "label", *L.names)


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B9 + C1: three differently labelled corpora, cleaned, mapped, tagged
    and unioned into one labelled table keyed by (source, row_id)."""
    lab = FX.labelled(spark, sf_dir).withColumn("text", TF.clean_text("text"))
    lst = R.map_list_corpus(FX.list_labelled(spark, sf_dir), labels=L)
    one = R.map_single_corpus(FX.single_labelled(spark, sf_dir), labels=L)
    return R.union_sources([R.tag_source(lab, "labelled", L), R.tag_source(lst, "list_corpus", L),
                            R.tag_source(one, "single_corpus", L)])


def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _combined(spark, sf_dir)
    return df.select("source", "row_id", *L.names, F.md5("text").alias("text_md5"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1."""
    return ST.label_counts(FX.labelled(spark, sf_dir), L)


def label_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2."""
    return ST.label_cooccurrence(FX.labelled(spark, sf_dir), L)


def label_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3."""
    return ST.label_combinations(FX.labelled(spark, sf_dir), L)


def source_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 over the combined corpus."""
    return ST.source_distribution(_combined(spark, sf_dir), L)


def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 + E5."""
    df = S.sample_weights(FX.labelled(spark, sf_dir), L)
    return df.select("row_id", F.round("weight", 6).alias("weight"))


def oversample_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6 + F1 quotas."""
    return S.oversample_plan(FX.labelled(spark, sf_dir), L)


def oversample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F3 + C2: originals and augmented copies."""
    df = S.oversample(FX.labelled(spark, sf_dir), L)
    return df.select("origin_id", "copy_label", "copy_no", *L.names, "source",
                     F.md5("text").alias("text_md5"))


def oversample_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uniform draws with replacement per synthetic row (bootstrap mode)."""
    df = S.oversample(FX.labelled(spark, sf_dir), L, mode="bootstrap")
    return df.select("origin_id", "copy_label", "copy_no", *L.names, "source",
                     F.md5("text").alias("text_md5"))


def balanced_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label counts after balancing."""
    return ST.label_counts(S.oversample(FX.labelled(spark, sf_dir), L, augment=False), L)


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 + D22."""
    df = S.stratified_split(FX.labelled(spark, sf_dir), L)
    return df.select("row_id", "stratum", "split")


def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 rows drawn with probability proportional to the F5 weight."""
    w = S.sample_weights(FX.labelled(spark, sf_dir), L)
    out = S.weighted_sample(w, "weight", 100)
    return out.select("row_id", F.round("weight", 6).alias("weight"))


def training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 shards of shuffled 32-row batches; fewer than 32 rows are dropped."""
    df = S.training_shards(FX.labelled(spark, sf_dir), n_shards=4)
    return df.select("row_id", "shard", "position", "batch_in_shard")


def augment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Augmented training view next to the original words."""
    lab = FX.labelled(spark, sf_dir).withColumn("text", TF.clean_text("text"))
    train, _ = S.training_views(lab, lab.limit(0), augment=True)
    return train.select("row_id", F.size(TF.words("text")).alias("n_words"),
                        F.md5("text").alias("text_md5"))


# ------------------------------------------------------- error analysis

def discrepancy_missing_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14 + G1: missing / extra counters with most-common ranks."""
    return D.missing_extra(FX.scored(spark, sf_dir), L)


def confusion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14 + G1: (true -> predicted) confusion pairs, ranked; human labels of
    all annotators as truth against the model's predictions."""
    return D.confusion_pairs(_joined(spark, sf_dir), L)


def mismatch_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 10 mismatches by row id."""
    df = D.mismatch_examples(FX.scored(spark, sf_dir), L, k=10)
    return df.select("row_id", F.md5("text").alias("text_md5"), "true_labels", "pred_labels",
                     "missing", "extra")


def multilabel_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 5 multi-label rows."""
    df = D.multilabel_examples(FX.scored(spark, sf_dir), L, k=5)
    return df.select("row_id", F.md5("text").alias("text_md5"), "true_labels", "pred_labels",
                     "perfect_match")


def detailed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 + B11 + B14 + B15."""
    df = D.detailed_predictions(FX.scored(spark, sf_dir), L)
    return df.select("row_id", F.md5("text").alias("text_md5"), *L.pred_cols,
                     *[F.round(c, 6).alias(c) for c in L.prob_cols], *L.true_cols,
                     "predicted_labels", "true_labels", "correct",
                     F.round("jaccard_similarity", 6).alias("jaccard_similarity"))


# ------------------------------------------------------------ annotators

def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AG.join_annotations(FX.scored(spark, sf_dir), FX.annotations(spark, sf_dir), L)


def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 + D17 + D18 for every annotator in one pass."""
    return AG.agreement(_joined(spark, sf_dir), L)


def annotator_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 (+Q16): first 3 FP / FN texts per annotator and label."""
    df = AG.disagreement_examples(_joined(spark, sf_dir), L, k=3)
    return df.select("annotator_id", "label", "label_index", "kind", "n_total", "example_no",
                     "text_id", F.md5("text").alias("text_md5"), "other_labels")


def raw_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    df = AG.raw_comparisons(_joined(spark, sf_dir), L)
    return df.select("annotator_id", "text_id", F.md5("text").alias("text_md5"),
                     "model_labels", "human_labels")


def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 end to end: the annotation fixture is written as one CSV per
    annotator into the shared checkpoint folder, read back with one glob scan
    (annotator id from the file name), joined to the predictions and
    evaluated (equals ``annotator_agreement``)."""
    import os
    import uuid

    from ..session import ensure_checkpoint_dir
    folder = os.path.join(ensure_checkpoint_dir(spark), "annotations", uuid.uuid4().hex)
    ids = [f"A{k}" for k in FX.ANNOTATORS]
    R.write_annotations(FX.annotations(spark, sf_dir), folder, ids)
    ann = R.read_annotations(spark, folder, L)
    return AG.agreement(AG.join_annotations(FX.scored(spark, sf_dir), ann, L), L)


def annotation_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + E3: texts each annotator has not annotated yet."""
    texts = FX.scored(spark, sf_dir).select("row_id", "text")
    ids = [f"A{k}" for k in FX.ANNOTATORS]
    wl = R.annotation_worklist(texts, FX.annotations(spark, sf_dir), ids)
    return wl.select("annotator_id", "text_id")


def error_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B19 + D15 + G4: top-3 words of each annotator's FP / FN texts."""
    return D.error_words(_joined(spark, sf_dir), L, group_cols=("annotator_id",), top=3)


def threshold_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D19 per annotator and label."""
    return D.threshold_advice(_joined(spark, sf_dir), L, group_cols=("annotator_id",))


# ------------------------------------------------- features, model, explain

def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D15-style corpus vocabulary (the B20 id table)."""
    return FE.build_vocabulary(FX.labelled(spark, sf_dir), vocab_size=5000)


def encode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-length 128-id encodings with a corpus vocabulary."""
    lab = FX.labelled(spark, sf_dir)
    enc = FE.encode(lab, FE.build_vocabulary(lab, vocab_size=5000), max_length=128)
    return enc.select("row_id", F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
                      "n_tokens", "truncated")


_MODELS: dict = {}


def _split_and_model(spark: SparkSession, sf_dir: str):
    """Labelled fixture split 90/10 (F4) and a binary-relevance model
    trained on the train part; memoised per session and folder."""
    key = (id(spark), sf_dir)
    if key not in _MODELS:
        split = S.stratified_split(FX.labelled(spark, sf_dir), L).persist()
        train = split.filter(F.col("split") == "train")
        model = MD.train(train, L)
        _MODELS[key] = (split, model)
    return _MODELS[key]


def train_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + J1 + B12: train on the train split, score the validation split."""
    split, model = _split_and_model(spark, sf_dir)
    val = split.filter(F.col("split") == "val").select("row_id", "text")
    out = MD.score(model, val)
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in L.prob_cols], *L.pred_cols)


def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 on the trained model: per-label metrics of the validation split."""
    split, model = _split_and_model(spark, sf_dir)
    val = split.filter(F.col("split") == "val")
    scored = MD.score(model, val.select("row_id", "text")).join(
        val.select("row_id", *[F.col(n).alias(L.true(n)) for n in L.names]), "row_id")
    return M.per_label_metrics(scored, L)


def run_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D21 + G5 + G6: validation history over optimiser passes, the top-3 +
    last epochs, and the early-stopping decision."""
    split, model = _split_and_model(spark, sf_dir)
    train = split.filter(F.col("split") == "train")
    val = split.filter(F.col("split") == "val")
    hist = MD.epoch_history(train, val, L, epochs=tuple(range(1, 11)), features_model=model.features)
    hist = hist.persist()
    kept = MD.top_epochs(hist, "val_f1", 3).select("run", "epoch", F.lit(True).alias("kept"))
    stop = MD.early_stop(hist, "val_f1", patience=3, min_delta=0.001)
    ranked = hist.withColumn("rank", F.row_number().over(
        Window.partitionBy("run").orderBy(F.col("val_f1").desc(), "epoch")))  # one row per epoch
    # every epoch of the history, flagged with the top-3 + last selection
    out = ranked.join(kept, ["run", "epoch"], "left").join(stop, "run")
    return out.select("run", "epoch", "val_f1", "val_precision", "val_recall", "val_accuracy", "rank",
                      F.coalesce("kept", F.lit(False)).alias("kept"), "best_epoch", "stop_epoch",
                      "stopped_early")


def _contributions(spark: SparkSession, sf_dir: str, largest, among: DataFrame | None = None) -> DataFrame:
    """Contributions of all texts, or of those with a row_id of ``among``,
    against the mean of all texts."""
    split, model = _split_and_model(spark, sf_dir)
    texts = split.select("row_id", "text")
    mean_x = X.background_mean(model, texts)
    if among is not None:
        texts = texts.join(among.select("row_id").distinct(), "row_id", "left_semi")
    return X.token_contributions(model, texts, mean_x=mean_x, largest=largest)


def token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + B24 + B26: top-5 tokens per document and label by |attribution|."""
    top = X.top_tokens(_contributions(spark, sf_dir, ("attribution", 5)), "attribution", 5)
    return top.select("row_id", "label", "rank", "token", "tf", F.round("attribution", 6).alias("attribution"),
                      F.round("weight", 6).alias("weight"))


def token_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-5 tokens per document and label by |occlusion delta|."""
    top = X.top_tokens(_contributions(spark, sf_dir, ("occlusion", 5)), "occlusion", 5)
    return top.select("row_id", "label", "rank", "token", F.round("occlusion", 6).alias("occlusion"),
                      F.round("prob", 6).alias("prob"))


def example_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions attached to the first-3 FP/FN annotator examples."""
    ex = AG.disagreement_examples(_joined(spark, sf_dir), L, k=3)
    contrib = _contributions(spark, sf_dir, ("attribution", 5), among=ex.select(F.col("text_id").alias("row_id")))
    out = X.example_attributions(ex, contrib, k=5)
    return out.select("annotator_id", "label", "kind", "example_no", "row_id", "rank", "token",
                      F.round("attribution", 6).alias("attribution"))


# -------------------------------------------------------------- streaming

def _doc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = FX.table(spark, sf_dir, "documents").schema
    return SM.read_parquet_stream(spark, f"{sf_dir}/documents.parquet", schema)


def streaming_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: per-label metrics from streaming count accumulators (equals the
    batch ``per_label_metrics``)."""
    scored = FX.scored_from_docs(_doc_stream(spark, sf_dir), L)
    return SM.streaming_per_label_metrics(scored, L)


def streaming_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: cleaning of arriving dirty text in append mode (equals the batch
    ``clean_text``)."""
    dirty = FX.dirty_from_docs(_doc_stream(spark, sf_dir))
    out = dirty.withColumn("clean", TF.clean_text("text")).select(
        "row_id", F.md5("clean").alias("text_md5"), F.length("clean").alias("n_chars"),
        (F.col("clean") == "").alias("is_empty"))
    return SM.run_appending(out, "clean_stream")


# ------------------------------------------------------ composite entries

def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: three corpora cleaned, mapped, tagged and unioned, oversampled
    with augmentation, then split 90/10 by label combination."""
    tagged = _combined(spark, sf_dir).withColumn(
        "row_id", F.concat_ws("-", F.col("source"), F.col("row_id").cast("string")))
    built = K.build_corpus([tagged], L)
    return built.corpus.select("row_key", "split", "source", *L.names, F.md5("text").alias("text_md5"))


# ------------------------------------------------------------ reporting

def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation report as a long Metric table."""
    df = M.metric_table(FX.scored(spark, sf_dir), L)
    return df.select("section", "label", "metric", F.round("value", 6).alias("value"))


def debug_row_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debug-form row P/R/F1 (empty side counts as 1) of the first 5
    rows by id (a first-k report)."""
    df = M.with_row_metrics(FX.scored(spark, sf_dir), L, empty="one").orderBy("row_id").limit(5)
    return df.select("row_id", F.round("sample_precision", 6).alias("precision"),
                     F.round("sample_recall", 6).alias("recall"), F.round("sample_f1", 6).alias("f1"))


def decode_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class names of the first 5 list-corpus rows."""
    df = R.decode_examples(FX.list_labelled(spark, sf_dir), k=5)
    return df.select("row_id", F.array_join("class_names", ", ").alias("class_names"))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D22 after the F4 split."""
    return R.split_counts(S.stratified_split(FX.labelled(spark, sf_dir), L))


QUERIES = {
    "per_label_metrics": per_label_metrics,
    "macro_sample_metrics": macro_sample_metrics,
    "cardinality_histogram": cardinality_histogram,
    "exact_match_multilabel": exact_match_multilabel,
    "confusion_matrix": confusion_matrix,
    "bce_loss": bce_loss,
    "row_set_metrics": row_set_metrics,
    "quality_metrics": quality_metrics,
    "unlabelled_check": unlabelled_check,
    "clean_text": clean_text,
    "multihot_from_list": multihot_from_list,
    "multihot_from_class": multihot_from_class,
    "corpus_union": corpus_union,
    "label_counts": label_counts,
    "label_cooccurrence": label_cooccurrence,
    "label_combinations": label_combinations,
    "source_distribution": source_distribution,
    "sample_weights": sample_weights,
    "oversample_plan": oversample_plan,
    "oversample_rows": oversample_rows,
    "oversample_bootstrap": oversample_bootstrap,
    "balanced_distribution": balanced_distribution,
    "stratified_split": stratified_split,
    "weighted_sample": weighted_sample,
    "training_shards": training_shards,
    "augment_words": augment_words,
    "discrepancy_missing_extra": discrepancy_missing_extra,
    "confusion_pairs": confusion_pairs,
    "mismatch_examples": mismatch_examples,
    "multilabel_examples": multilabel_examples,
    "detailed_predictions": detailed_predictions,
    "annotator_agreement": annotator_agreement,
    "annotator_examples": annotator_examples,
    "raw_comparisons": raw_comparisons,
    "annotation_worklist": annotation_worklist,
    "annotation_files": annotation_files,
    "error_words": error_words,
    "threshold_advice": threshold_advice,
    "vocabulary": vocabulary,
    "encode_tokens": encode_tokens,
    "train_and_score": train_and_score,
    "validation_metrics": validation_metrics,
    "run_selection": run_selection,
    "token_attribution": token_attribution,
    "token_occlusion": token_occlusion,
    "example_attributions": example_attributions,
    "streaming_metrics": streaming_metrics,
    "streaming_clean": streaming_clean,
    "corpus_build": corpus_build,
    "metrics_report": metrics_report,
    "debug_row_metrics": debug_row_metrics,
    "decode_examples": decode_examples,
    "split_counts": split_counts,
}
