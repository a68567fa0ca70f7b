"""Sinks (A7, A10, A11, A12, A13, A14).

Everything is written by the executors as partitioned Parquet (or CSV when a
human-readable file is wanted); nothing is gathered on the driver except the
few dozen metric rows a text report renders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import discrepancy as D
from ..operators import metrics as M
from ..schema import DEFAULT_LABELS, LabelSet


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per split (``split=train`` / ``split=val`` ...), so a
    reader of one split prunes the others."""
    w = df.write.mode(mode).partitionBy("split")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def write_detailed_predictions(scored: DataFrame, path: str, labels: LabelSet = DEFAULT_LABELS,
                               fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A10: text, pred/prob/true columns, label strings, correctness and
    the row Jaccard."""
    out = D.detailed_predictions(scored, labels)
    if fmt == "csv":
        out.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        out.write.mode(mode).parquet(path)


def slim_predictions(scored: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """Only the ``pred_*`` and ``true_*`` columns (plus the key)."""
    keep = [c for c in ("row_id",) if c in scored.columns]
    return scored.select(*keep, *labels.pred_cols, *labels.true_cols)


def write_metric_table(scored: DataFrame, path: str, labels: LabelSet = DEFAULT_LABELS,
                       mode: str = "overwrite") -> str:
    """The long Metric table to Parquet, and its text rendering (the
    only driver-side step: a few dozen rows)."""
    table = M.metric_table(scored, labels)
    table.write.mode(mode).parquet(path)
    return M.render_report(table.collect(), labels)


def write_raw_comparisons(raw: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per annotator."""
    raw.write.mode(mode).partitionBy("annotator_id").parquet(path)
