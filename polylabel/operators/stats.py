"""Corpus statistics (D1-D6, D22): label counts and frequencies,
co-occurrence, label combinations, per-source distribution.

The table stays wide: one aggregation computes all L (or L(L+1)/2) sums in a
partial + final hash aggregate, and the single result row is unpivoted
afterwards. Exploding rows by label before aggregating would move L times
the data through the shuffle for nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as LF
from ..schema import DEFAULT_LABELS, LabelSet, require_columns


def _flag(c: str):
    # A label counts as present when it equals 1 (null counts as absent).
    return F.when(F.col(c) == 1, 1).otherwise(0)


def label_counts(df: DataFrame, labels: LabelSet = DEFAULT_LABELS, group_cols=()) -> DataFrame:
    """Per label, count and frequency (count / rows)."""
    require_columns(df, labels.names, "labelled table")
    aggs = [F.count(F.lit(1)).alias("n_rows")] + \
        [F.sum(_flag(n)).alias(f"c_{n}") for n in labels.names]
    wide = df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(i).alias("label_index"),
                              F.col(f"c_{n}").alias("count"))
                     for i, n in enumerate(labels.names)])
    out = wide.select(*group_cols, "n_rows", F.inline(rows))
    return out.select(*group_cols, "label", "label_index",
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"), "n_rows",
                      F.round(LF.safe_div(F.col("count"), F.col("n_rows")), 6).alias("frequency"))


def label_cooccurrence(df: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """L x L co-occurrence in long form (label_a, label_b, n); diagonal =
    label count. One aggregation of the L(L+1)/2 upper-triangle products,
    mirrored afterwards."""
    names = labels.names
    aggs = []
    for i in range(len(names)):
        for j in range(i, len(names)):
            aggs.append(F.sum(_flag(names[i]) * _flag(names[j])).alias(f"co_{i}_{j}"))
    wide = df.agg(*aggs)
    cells = []
    for i in range(len(names)):
        for j in range(len(names)):
            a, b = min(i, j), max(i, j)
            cells.append(F.struct(F.lit(names[i]).alias("label_a"), F.lit(names[j]).alias("label_b"),
                                  F.lit(i).alias("index_a"), F.lit(j).alias("index_b"),
                                  F.coalesce(F.col(f"co_{a}_{b}"), F.lit(0)).cast("long").alias("n")))
    return wide.select(F.inline(F.array(*cells)))


def label_combinations(df: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """D3: rows per full label combination (at most 2^L groups; map-side
    partial aggregation keeps a dominant combination cheap)."""
    keys = [_flag(n).alias(n) for n in labels.names]
    return (df.select(*keys).groupBy(*labels.names).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("labels", LF.label_string(labels.names, labels.names, empty="none")))


def source_distribution(df: DataFrame, labels: LabelSet = DEFAULT_LABELS,
                        source_col: str = "source") -> DataFrame:
    """Per source (only sources with rows), per label count and percent
    of that source's rows."""
    out = label_counts(df, labels, group_cols=(source_col,))
    return out.select(source_col, "label", "label_index", "count", "n_rows",
                      F.round(F.col("count") * 100.0 / F.col("n_rows"), 6).alias("pct"))


def max_label_count(counts: DataFrame) -> DataFrame:
    """The oversampling target = the largest label count."""
    return counts.agg(F.max("count").alias("target"))
