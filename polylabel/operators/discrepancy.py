"""Error analysis.

Counts that the reference collects with Python Counters over mismatched
rows are sums over the wide table: "missing" label l is fn_l, "extra" is
fp_l, and the confusion pair (m -> e) counts rows where m is missing and e
is extra, i.e. sum(t_m (1-p_m) p_e (1-t_e)). One aggregation gives all
L + L + L(L-1) counters without exploding a single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as LF
from ..functions import text as TF
from ..schema import DEFAULT_LABELS, LabelSet


def _miss(labels: LabelSet, n: str):
    return F.col(labels.true(n)) * (F.lit(1) - F.col(labels.pred(n)))


def _extra(labels: LabelSet, n: str):
    return F.col(labels.pred(n)) * (F.lit(1) - F.col(labels.true(n)))


def missing_extra(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """D14 + G1: per label, times missing and times extra, the mismatch count
    and ratio, and the most-common rank of each counter (ties by label
    order)."""
    aggs = [F.count(F.lit(1)).alias("n"),
            F.sum(F.when(LF.exact_match(labels.true_cols, labels.pred_cols), 0).otherwise(1)).alias("n_mismatch")]
    for n in labels.names:
        aggs += [F.sum(_miss(labels, n)).alias(f"m_{n}"), F.sum(_extra(labels, n)).alias(f"e_{n}")]
    wide = scored.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(i).alias("label_index"),
                              F.col(f"m_{n}").cast("long").alias("n_missing"),
                              F.col(f"e_{n}").cast("long").alias("n_extra"))
                     for i, n in enumerate(labels.names)])
    out = wide.select("n", "n_mismatch", F.inline(rows))
    w_all = Window.partitionBy(F.lit(0))  # over L rows
    return out.select(
        "label", "label_index", "n_missing", "n_extra",
        F.row_number().over(w_all.orderBy(F.col("n_missing").desc(), "label_index")).alias("missing_rank"),
        F.row_number().over(w_all.orderBy(F.col("n_extra").desc(), "label_index")).alias("extra_rank"),
        F.col("n_mismatch").cast("long").alias("n_mismatch"),
        F.round(F.col("n_mismatch") / F.col("n"), 6).alias("mismatch_ratio"))


def confusion_pairs(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """D14 + G1: (true_label -> predicted_label) pairs with their count,
    most common first (ties by label order); zero pairs are omitted."""
    names = labels.names
    aggs = []
    for i, m in enumerate(names):
        for j, e in enumerate(names):
            if i != j:
                aggs.append(F.sum(_miss(labels, m) * _extra(labels, e)).alias(f"p_{i}_{j}"))
    wide = scored.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(m).alias("true_label"), F.lit(e).alias("pred_label"),
                               F.lit(i).alias("true_index"), F.lit(j).alias("pred_index"),
                               F.coalesce(F.col(f"p_{i}_{j}"), F.lit(0)).cast("long").alias("n"))
                      for i, m in enumerate(names) for j, e in enumerate(names) if i != j])
    pairs = wide.select(F.inline(cells)).filter(F.col("n") > 0)
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "true_index", "pred_index")  # <= L(L-1) rows
    return pairs.withColumn("rank", F.row_number().over(w))


def with_label_strings(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """B11 + B13: true/predicted/missing/extra label names as ", " strings."""
    return scored.withColumns({
        "true_labels": LF.label_string(labels.true_cols, labels.names),
        "pred_labels": LF.label_string(labels.pred_cols, labels.names),
        "missing": F.concat_ws(", ", LF.missing_labels(labels)),
        "extra": F.concat_ws(", ", LF.extra_labels(labels)),
    })


def mismatch_examples(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS, k: int = 10,
                      id_col: str = "row_id") -> DataFrame:
    """The first ``k`` mismatched rows by id (a top-k report: each task
    keeps k rows, TakeOrderedAndProject merges them)."""
    bad = scored.filter(~LF.exact_match(labels.true_cols, labels.pred_cols))
    top = bad.orderBy(id_col).limit(k)
    return with_label_strings(top, labels).select(id_col, "text", "true_labels", "pred_labels",
                                                  "missing", "extra")


def multilabel_examples(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS, k: int = 5,
                        id_col: str = "row_id") -> DataFrame:
    """The first ``k`` rows carrying more than one true label."""
    multi = scored.filter(LF.total(labels.true_cols) > 1).orderBy(id_col).limit(k)
    return with_label_strings(multi, labels).select(
        id_col, "text", "true_labels", "pred_labels",
        LF.exact_match(labels.true_cols, labels.pred_cols).alias("perfect_match"))


def detailed_predictions(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """A10: per row, text, pred/prob/true columns, predicted and true label
    strings, ``correct`` (set equality) and the row Jaccard."""
    rc = LF.row_counts(labels.true_cols, labels.pred_cols)
    out = scored.withColumns({
        "predicted_labels": LF.label_string(labels.pred_cols, labels.names),
        "true_labels": LF.label_string(labels.true_cols, labels.names),
        "jaccard_similarity": LF.row_jaccard(rc["n_inter"], rc["n_union"]),
    }).withColumn("correct", F.col("predicted_labels") == F.col("true_labels"))
    keep = [c for c in ("row_id", "text") if c in scored.columns]
    return out.select(*keep, *labels.pred_cols, *labels.prob_cols, *labels.true_cols,
                      "predicted_labels", "true_labels", "correct", "jaccard_similarity")


# ------------------------------------------------------------ error words

def error_rows(joined: DataFrame, labels: LabelSet) -> DataFrame:
    """One row per (row, label, kind) error: kind ``fp`` (predicted, not
    true) or ``fn`` (true, not predicted). At most L rows per input row."""
    flags = F.array(*[
        F.when(F.col(labels.pred(n)) > F.col(labels.true(n)),
               F.struct(F.lit(n).alias("label"), F.lit(i).alias("label_index"), F.lit("fp").alias("kind")))
        .when(F.col(labels.pred(n)) < F.col(labels.true(n)),
              F.struct(F.lit(n).alias("label"), F.lit(i).alias("label_index"), F.lit("fn").alias("kind")))
        for i, n in enumerate(labels.names)])
    e = joined.select("*", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("_e"))
    return e.select("*", "_e.label", "_e.label_index", "_e.kind").drop("_e")


def error_words(joined: DataFrame, labels: LabelSet = DEFAULT_LABELS, group_cols=(), top: int = 3,
                min_len: int = 3) -> DataFrame:
    """D15 + G4: word counts (lowercase, whitespace split, length >= 3) over
    the texts of each (group, label, kind) error set, top ``top`` words per
    set (ties by word). A text's words are exploded once, whatever its errors,
    and counted in one row per (group, word) with a counter per label and
    kind; these become rows after the count. The ranking window uses Spark's
    window group limit (top-k kept per task before the shuffle)."""
    group_cols = list(group_cols)
    flags = {}
    for n in labels.names:
        p, t = F.col(labels.pred(n)), F.col(labels.true(n))
        flags |= {f"_fp_{n}": F.when(p > t, 1).otherwise(0), f"_fn_{n}": F.when(p < t, 1).otherwise(0)}
    errs = joined.select(*group_cols, "text", *(c.alias(k) for k, c in flags.items())).filter(sum((F.col(k) for k in flags), F.lit(0)) > 0)
    words = errs.select(*group_cols, *flags, F.explode(TF.word_tokens("text", min_len)).alias("word"))
    wide = words.groupBy(*group_cols, "word").agg(*(F.sum(k).alias(k) for k in flags))
    sets = F.array(*(F.struct(F.lit(n).alias("label"), F.lit(i).alias("label_index"), F.lit(kind).alias("kind"), F.col(f"_{kind}_{n}").alias("n"))
                     for i, n in enumerate(labels.names) for kind in ("fp", "fn")))
    counts = wide.select(*group_cols, "word", F.inline(F.filter(sets, lambda s: s["n"] > 0))) \
        .select(*group_cols, "label", "label_index", "kind", "word", "n")
    w = Window.partitionBy(*group_cols, "label", "kind").orderBy(F.col("n").desc(), "word")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def threshold_advice(joined: DataFrame, labels: LabelSet = DEFAULT_LABELS, group_cols=(),
                     high: float = 0.7, low: float = 0.3) -> DataFrame:
    """Per (group, label) error balance fp/(fp+fn) (0 without errors):
    above ``high`` suggests raising the threshold, below ``low`` lowering
    it; plus the top-3 words of the false-positive and false-negative
    texts."""
    group_cols = list(group_cols)
    aggs = []
    for n in labels.names:
        aggs += [F.sum(_extra(labels, n)).alias(f"fp_{n}"), F.sum(_miss(labels, n)).alias(f"fn_{n}")]
    g = joined.groupBy(*group_cols).agg(*aggs) if group_cols else joined.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(i).alias("label_index"),
                              F.col(f"fp_{n}").cast("long").alias("fp"),
                              F.col(f"fn_{n}").cast("long").alias("fn"))
                     for i, n in enumerate(labels.names)])
    bal = g.select(*group_cols, F.inline(rows))
    ratio = LF.safe_div(F.col("fp"), F.col("fp") + F.col("fn"))
    bal = bal.withColumn("fp_ratio", F.round(ratio, 6)).withColumn(
        "advice", F.when(ratio > high, F.lit("raise threshold"))
        .when(ratio < low, F.lit("lower threshold")).otherwise(F.lit("keep threshold")))
    words = error_words(joined, labels, group_cols, top=3)
    tops = words.groupBy(*group_cols, "label").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "fp",
                                                                    F.struct("rank", "word")))),
                                 lambda s: s["word"]), ", ").alias("fp_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "fn",
                                                                    F.struct("rank", "word")))),
                                 lambda s: s["word"]), ", ").alias("fn_words"))
    out = bal.join(tops, group_cols + ["label"], "left")
    return out.select(*group_cols, "label", "label_index", "fp", "fn", "fp_ratio", "advice",
                      F.coalesce("fp_words", F.lit("")).alias("fp_words"),
                      F.coalesce("fn_words", F.lit("")).alias("fn_words"))
