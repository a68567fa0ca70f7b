"""K1 build_corpus and K2 label_info as compositions of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sampling as S
from ..operators import stats as ST
from ..schema import DEFAULT_LABELS, LabelSet
from ..session import cut_lineage
from ..sources import readers as R
from ..sources import sinks


@dataclass
class CorpusBuild:
    corpus: DataFrame          # row_key, origin_id, copy_label, copy_no, text, labels, source, split
    before: DataFrame          # D4 per-source distribution before balancing
    after: DataFrame           # D5 distribution after balancing
    split_counts: DataFrame    # D22


def row_key(origin="origin_id", label="copy_label", copy="copy_no"):
    """Stable key of an original (``<id>##0``) or synthetic row."""
    return F.concat_ws("#", F.col(origin).cast("string"), F.coalesce(F.col(label), F.lit("")),
                       F.col(copy).cast("string"))


def build_corpus(tagged_sources: list[DataFrame], labels: LabelSet = DEFAULT_LABELS, seed: int = 42,
                 test_size: float = 0.1, augment: bool = True, order: str = "balance_then_split",
                 checkpoint: bool = True, out_path: str | None = None) -> CorpusBuild:
    """K1: union the tagged sources (C1), report per-source distribution
    (D4), oversample with augmentation (F1-F3, C2), report the balanced
    distribution (D5), stratified 90/10 split (F4), split counts (D22), and
    optionally write one folder per split (A7).

    ``order="balance_then_split"`` is the reference's order (copies of one
    text can land in both splits); ``"split_then_balance"`` balances the
    training split only. The cleaned union is checkpointed to the shared
    checkpoint folder because it feeds several passes."""
    union = R.union_sources(tagged_sources)
    if checkpoint:
        union = cut_lineage(union, "corpus_union")
    before = ST.source_distribution(union, labels)
    if order == "balance_then_split":
        balanced = S.oversample(union, labels, seed=seed, augment=augment)
        balanced = balanced.withColumn("row_key", row_key())
        if checkpoint:  # the balanced table feeds the histogram and both split passes
            balanced = cut_lineage(balanced, "corpus_balanced")
        corpus = S.stratified_split(balanced, labels, test_size, seed, id_col="row_key")
    elif order == "split_then_balance":
        split = S.stratified_split(union, labels, test_size, seed)
        train = split.filter(F.col("split") == "train").drop("split", "stratum")
        val = split.filter(F.col("split") == "val").drop("split", "stratum")
        tb = S.oversample(train, labels, seed=seed, augment=augment).withColumn("split", F.lit("train"))
        vb = val.select(F.col("row_id").alias("origin_id"), F.lit(None).cast("string").alias("copy_label"),
                        F.lit(0).cast("long").alias("copy_no"), "text", *labels.names,
                        *[c for c in ("source",) if c in val.columns]).withColumn("split", F.lit("val"))
        corpus = tb.unionByName(vb).withColumn("row_key", row_key())
    else:
        raise ValueError(f"unknown order {order!r}")
    after = ST.label_counts(corpus, labels)
    counts = R.split_counts(corpus)
    if out_path:
        sinks.write_splits(corpus, out_path)
    return CorpusBuild(corpus, before, after, counts)


def label_info(df: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> dict[str, DataFrame]:
    """K2: counts and frequencies (D1), co-occurrence (D2), combinations (D3)."""
    return {"counts": ST.label_counts(df, labels),
            "cooccurrence": ST.label_cooccurrence(df, labels),
            "combinations": ST.label_combinations(df, labels)}
