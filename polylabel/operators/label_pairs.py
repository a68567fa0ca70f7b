"""Label pairs of large label sets (D2, D14): co-occurrence and confusions from
sparse label arrays.

``stats.label_cooccurrence`` and ``discrepancy.confusion_pairs`` have a sum per
pair of labels in one row, which suits a handful of labels; a thousand would be
half a million expressions. Here a row holds the ids of its labels only, its
pairs are streamed out of it one by one and added up in the map side's hash
aggregate on (a, b), so a task holds at most the pairs that occur, and spills
beyond its memory. What is shuffled is a task's distinct pairs, not its rows; a
pair that every row has is one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import DEFAULT_LABELS, LabelSet


def flagged_ids(flags) -> Column:
    """Positions of the true conditions among ``flags``, ascending; null
    conditions count as absent."""
    return F.array_compact(F.array(*(F.when(f, F.lit(i)) for i, f in enumerate(flags))))


def present_ids(cols) -> Column:
    """Positions of the 0/1 columns that are 1."""
    return flagged_ids([F.col(c) == 1 for c in cols])


def _ids(c) -> Column:
    return F.array_compact(F.array_distinct(F.col(c) if isinstance(c, str) else c))


def cooccurrence(df: DataFrame, ids_col, symmetric: bool = True) -> DataFrame:
    """(a, b, n), in how many rows both labels occur; the diagonal is the
    label's count. Repeated ids in a row count once, null ids and null arrays
    not at all. Pairs that never occur have no row. ``symmetric=False`` gives
    a <= b only."""
    rows = df.select(F.array_sort(_ids(ids_col)).alias("ids"))
    first = rows.select(F.posexplode("ids").alias("at", "a"), "ids")
    # the ids from a on; no row ever holds its pairs as an array
    pairs = first.select("a", F.explode(F.slice("ids", F.col("at") + 1, F.size("ids"))).alias("b"))
    half = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    if not symmetric:
        return half
    other = half.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    return half.unionByName(other)


def confusions(df: DataFrame, true_col, pred_col) -> DataFrame:
    """(true_id, pred_id, n): how often a row misses ``true_id`` while
    it has ``pred_id`` too many. Null arrays are empty."""
    empty = lambda c: F.coalesce(_ids(c), F.array())
    t, p = empty(true_col), empty(pred_col)
    rows = df.select(F.array_except(t, p).alias("missing"), F.array_except(p, t).alias("extra"))
    pairs = rows.select(F.explode("missing").alias("true_id"), "extra").select("true_id", F.explode("extra").alias("pred_id"))
    return pairs.groupBy("true_id", "pred_id").agg(F.count(F.lit(1)).alias("n"))


def ranked_confusions(df: DataFrame, true_col, pred_col, k: int) -> DataFrame:
    """G1: the ``k`` most common confusions, ties by ids (the limit is the
    feature: each task keeps ``k`` rows)."""
    top = confusions(df, true_col, pred_col).orderBy(F.desc("n"), "true_id", "pred_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "true_id", "pred_id")))


def dense_ids(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """``scored`` with its 0/1 columns as ``true_ids`` and ``pred_ids``."""
    return scored.withColumns({"true_ids": present_ids(labels.true_cols), "pred_ids": present_ids(labels.pred_cols)})
