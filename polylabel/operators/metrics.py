"""Evaluation metrics over a Scored table.

Every metric is derived from one aggregation pass: per-label tp/fp/fn/tn
sums plus row-level sums (exact matches, sample P/R/F1, Jaccard, label
cardinality). Spark runs it as a partial (map-side) hash aggregate followed
by a single-row final merge, so the shuffle carries one small row per task
whatever the table size, and group skew cannot build up. Ratios are formed
from the integer sums at the very end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as LF
from ..schema import DEFAULT_LABELS, METRIC_SCHEMA, LabelSet, require_columns

ROUND = 6


def _r(c: Column) -> Column:
    return F.round(c, ROUND)


def with_row_metrics(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS,
                     empty: str = "standard") -> DataFrame:
    """Adds the row-level columns B13-B16, B18: n_inter, n_true, n_pred,
    n_union, exact, jaccard, sample_precision/recall/f1."""
    rc = LF.row_counts(labels.true_cols, labels.pred_cols)
    df = scored.withColumns(rc)
    prf = LF.row_prf("n_inter", "n_true", "n_pred", empty=empty)
    return df.withColumns({
        "exact": LF.exact_match(labels.true_cols, labels.pred_cols).cast("int"),
        "jaccard": LF.row_jaccard("n_inter", "n_union"),
        "sample_precision": prf["precision"],
        "sample_recall": prf["recall"],
        "sample_f1": prf["f1"],
    })


def metric_sums(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS, group_cols=(),
                empty: str = "standard") -> DataFrame:
    """One aggregation pass: confusion counts per label and the row sums."""
    require_columns(scored, labels.true_cols + labels.pred_cols, "scored table")
    df = with_row_metrics(scored, labels, empty)
    aggs = [F.count(F.lit(1)).alias("n")]
    for name in labels.names:
        t, p = F.col(labels.true(name)), F.col(labels.pred(name))
        aggs += [
            F.sum(F.when((t == 1) & (p == 1), 1).otherwise(0)).alias(f"tp_{name}"),
            F.sum(F.when((t == 0) & (p == 1), 1).otherwise(0)).alias(f"fp_{name}"),
            F.sum(F.when((t == 1) & (p == 0), 1).otherwise(0)).alias(f"fn_{name}"),
            F.sum(F.when((t == 0) & (p == 0), 1).otherwise(0)).alias(f"tn_{name}"),
        ]
    aggs += [
        F.sum("exact").alias("n_exact"),
        F.sum("n_true").alias("n_label_total"),
        F.sum("n_pred").alias("n_pred_total"),
        F.sum(F.when(F.col("n_true") > 1, 1).otherwise(0)).alias("n_multi"),
        F.sum(F.when(F.col("n_true") > 1, F.col("exact")).otherwise(0)).alias("n_multi_exact"),
        F.sum(F.when(F.col("exact") == 0, 1).otherwise(0)).alias("n_mismatch"),
        F.sum("sample_precision").alias("sum_sample_precision"),
        F.sum("sample_recall").alias("sum_sample_recall"),
        F.sum("sample_f1").alias("sum_sample_f1"),
        F.sum("jaccard").alias("sum_jaccard"),
    ]
    if group_cols:
        return df.groupBy(*group_cols).agg(*aggs)
    return df.agg(*aggs)


def _label_rows(sums: DataFrame, labels: LabelSet, group_cols=()) -> DataFrame:
    """Unpivot the wide per-label sums into one row per label (on the tiny
    aggregated table, after the shuffle)."""
    structs = [F.struct(F.lit(name).alias("label"), F.lit(i).alias("label_index"),
                        F.col(f"tp_{name}").alias("tp"), F.col(f"fp_{name}").alias("fp"),
                        F.col(f"fn_{name}").alias("fn"), F.col(f"tn_{name}").alias("tn"))
               for i, name in enumerate(labels.names)]
    return sums.select(*group_cols, "n", F.inline(F.array(*structs)))


def per_label_from_sums(sums: DataFrame, labels: LabelSet = DEFAULT_LABELS,
                        group_cols=()) -> DataFrame:
    rows = _label_rows(sums, labels, group_cols)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return rows.select(
        *group_cols, "label", "label_index", "tp", "fp", "fn", "tn",
        (tp + fn).alias("support"),
        LF.safe_div(tp, tp + fp).alias("precision"),
        LF.safe_div(tp, tp + fn).alias("recall"),
        LF.safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((tp + tn) / F.col("n")).alias("accuracy"),
    )


def per_label_metrics(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS,
                      group_cols=()) -> DataFrame:
    """Precision, recall, F1, support (and accuracy) per label;
    zero division gives 0."""
    return per_label_from_sums(metric_sums(scored, labels, group_cols), labels, group_cols)


def _mean(cols) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total / F.lit(len(cols))


def summary_from_sums(sums: DataFrame, labels: LabelSet = DEFAULT_LABELS,
                      group_cols=()) -> DataFrame:
    """Macro means, sample means, Jaccard, exact match,
    Hamming loss."""
    p, r, f = [], [], []
    for name in labels.names:
        tp, fp, fn = (F.col(f"{k}_{name}") for k in ("tp", "fp", "fn"))
        p.append(LF.safe_div(tp, tp + fp))
        r.append(LF.safe_div(tp, tp + fn))
        f.append(LF.safe_div(2 * tp, 2 * tp + fp + fn))
    n = F.col("n")
    errors = sum((F.col(f"fp_{nm}") + F.col(f"fn_{nm}") for nm in labels.names[1:]),
                 F.col(f"fp_{labels.names[0]}") + F.col(f"fn_{labels.names[0]}"))
    return sums.select(
        *group_cols, "n",
        _r(_mean(p)).alias("macro_precision"),
        _r(_mean(r)).alias("macro_recall"),
        _r(_mean(f)).alias("macro_f1"),
        _r(_mean([(F.col(f"tp_{nm}") + F.col(f"tn_{nm}")) / n for nm in labels.names])).alias("macro_accuracy"),
        _r(F.col("sum_sample_precision") / n).alias("sample_precision"),
        _r(F.col("sum_sample_recall") / n).alias("sample_recall"),
        _r(F.col("sum_sample_f1") / n).alias("sample_f1"),
        _r(F.col("sum_jaccard") / n).alias("jaccard"),
        F.col("n_exact"),
        _r(F.col("n_exact") / n).alias("exact_match_ratio"),
        _r(errors / (n * F.lit(len(labels)))).alias("hamming_loss"),
        F.col("n_mismatch"),
    )


def macro_sample_metrics(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS,
                         group_cols=(), empty: str = "standard") -> DataFrame:
    return summary_from_sums(metric_sums(scored, labels, group_cols, empty), labels, group_cols)


def exact_match_summary(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """D11 header + D12 + D13: totals, perfect matches overall and among
    multi-label rows, and per-label accuracy (one row)."""
    s = metric_sums(scored, labels)
    n = F.col("n")
    acc = [_r((F.col(f"tp_{nm}") + F.col(f"tn_{nm}")) / n).alias(f"accuracy_{nm}")
           for nm in labels.names]
    return s.select(
        "n", "n_label_total",
        _r(F.col("n_label_total") / n).alias("labels_per_text"),
        "n_exact", _r(F.col("n_exact") * 100.0 / n).alias("pct_exact"),
        "n_multi", "n_multi_exact",
        _r(LF.safe_div(F.col("n_multi_exact") * 100.0, F.col("n_multi"))).alias("pct_multi_exact"),
        *acc)


def cardinality_histogram(labelled: DataFrame, label_cols, include_zero: bool = False) -> DataFrame:
    """Rows per number of labels, from 1 (or 0) up to the maximum, with
    empty bins as 0. The spine is built from the one-row max, so the join is
    between two tables of at most L+1 rows."""
    k = LF.total(label_cols)
    counts = labelled.select(k.alias("n_labels")).groupBy("n_labels").agg(F.count(F.lit(1)).alias("n_texts"))
    bounds = counts.agg(F.max("n_labels").alias("mx"), F.sum("n_texts").alias("n"))
    start = 0 if include_zero else 1
    spine = bounds.select(F.explode(F.sequence(F.lit(start), F.greatest(F.col("mx"), F.lit(start))))
                          .alias("n_labels"), "n", "mx") \
                  .filter(F.col("n_labels") <= F.col("mx"))
    out = spine.join(F.broadcast(counts), "n_labels", "left")
    return out.select("n_labels", F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
                      _r(F.coalesce("n_texts", F.lit(0)) * 100.0 / F.col("n")).alias("pct"))


def confusion_matrix(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """2x2 matrix per label as (label, true, pred, n)."""
    rows = _label_rows(metric_sums(scored, labels), labels)
    cells = F.array(
        F.struct(F.lit(0).alias("true"), F.lit(0).alias("pred"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("true"), F.lit(1).alias("pred"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("true"), F.lit(0).alias("pred"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("true"), F.lit(1).alias("pred"), F.col("tp").alias("n")),
    )
    return rows.select("label", "label_index", F.inline(cells))


def bce_loss(df: DataFrame, labels: LabelSet = DEFAULT_LABELS, from_probs: bool = True,
             group_cols=()) -> DataFrame:
    """Mean binary cross-entropy with logits over n*L cells.

    ``from_probs``: logits are ``ln(p/(1-p))``; otherwise ``logit_<label>``
    columns are read. Nothing is clipped but probabilities of exactly 0 and 1,
    which have no finite logit: they count as 1e-15 away from it."""
    terms = []
    for name in labels.names:
        y = F.col(labels.true(name)).cast("double")
        if from_probs:
            p = F.least(F.greatest(F.col(labels.prob(name)), F.lit(1e-15)), F.lit(1.0 - 1e-15))
            z = F.log(p / (F.lit(1.0) - p))
        else:
            z = F.col(f"logit_{name}")
        terms.append(F.greatest(z, F.lit(0.0)) - z * y + F.log(F.lit(1.0) + F.exp(-F.abs(z))))
    row_loss = terms[0]
    for t in terms[1:]:
        row_loss = row_loss + t
    agg = df.groupBy(*group_cols) if group_cols else df
    out = agg.agg(F.sum(row_loss).alias("_s"), F.count(F.lit(1)).alias("n"))
    return out.select(*group_cols, "n", _r(F.col("_s") / (F.col("n") * F.lit(len(labels)))).alias("bce_loss"))


def metric_table(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """Everything of the evaluation report as a long Metric table
    (section, label, metric, value), from one aggregation pass."""
    sums = metric_sums(scored, labels).cache()
    per = per_label_from_sums(sums, labels)
    per_long = per.select(
        F.lit("per_label").alias("section"), "label",
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                           for m in ("precision", "recall", "f1", "support", "accuracy")])))
    summ = summary_from_sums(sums, labels)
    summary_metrics = ("macro_precision", "macro_recall", "macro_f1", "sample_precision",
                       "sample_recall", "sample_f1", "jaccard", "exact_match_ratio", "hamming_loss",
                       "n", "n_exact", "n_mismatch")
    sum_long = summ.select(
        F.lit("overall").alias("section"), F.lit(None).cast("string").alias("label"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                           for m in summary_metrics])))
    out = per_long.unionByName(sum_long)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in METRIC_SCHEMA.fields])


def render_report(metric_rows, labels: LabelSet = DEFAULT_LABELS) -> str:
    """Text rendering of a collected Metric table (a few dozen rows)."""
    by = {(r["section"], r["label"], r["metric"]): r["value"] for r in metric_rows}
    lines = ["", "PER-LABEL METRICS", "================="]
    for name in labels.names:
        lines.append(f"\n{name.upper()}:")
        for m in ("precision", "recall", "f1"):
            lines.append(f"  {m}: {by[('per_label', name, m)]:.4f}")
        lines.append(f"  support: {int(by[('per_label', name, 'support')])}")
    lines += ["", "SAMPLE-BASED METRICS", "===================="]
    for m in ("precision", "recall", "f1"):
        lines.append(f"{m}: {by[('overall', None, 'sample_' + m)]:.4f}")
    lines += ["", "MACRO AVERAGES", "=============="]
    for m in ("precision", "recall", "f1"):
        lines.append(f"{m}: {by[('overall', None, 'macro_' + m)]:.4f}")
    lines.append(f"\nJaccard Similarity: {by[('overall', None, 'jaccard')]:.4f}")
    return "\n".join(lines)


def unlabelled_check(df: DataFrame, label_cols, other_cols=()) -> DataFrame:
    """A2 + D23: one row telling whether every label column is null in every
    row (an unlabelled set), and null/NaN counts of these and ``other_cols``
    (scores, which say nothing about labels)."""
    all_cols = [*label_cols, *other_cols]
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in all_cols:
        bad = F.col(c).isNull()
        if dict(df.dtypes)[c] in ("double", "float"):
            bad = bad | F.isnan(c)
        aggs.append(F.sum(bad.cast("int")).alias(f"invalid_{c}"))
        aggs.append(F.max(F.col(c).isNotNull().cast("int")).alias(f"_any_{c}"))
    s = df.agg(*aggs)
    any_label = F.greatest(*[F.coalesce(F.col(f"_any_{c}"), F.lit(0)) for c in label_cols]) \
        if len(label_cols) > 1 else F.coalesce(F.col(f"_any_{label_cols[0]}"), F.lit(0))
    return s.select("n", (any_label == 0).alias("is_unlabelled"),
                    *[F.col(f"invalid_{c}").cast("long").alias(f"invalid_{c}") for c in all_cols])
