"""Label vocabulary, canonical schemas and column checks.

Canonical tables (all wide, one row per text):

* Labelled : row_id, text, source, <label> int (0/1, null = unlabelled) x L
* Scored   : row_id, true_<label> int x L, prob_<label> double x L, pred_<label> int x L
* Annotated: annotator_id, text_id, text, <label> int x L
* Metric   : section, label (null for overall), metric, value double
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The five target labels and their order (index = position).
EMOTIONS = ("anger", "fear", "joy", "sadness", "surprise")


@dataclass(frozen=True)
class LabelSet:
    """Ordered label vocabulary; every operator takes one as a parameter."""

    names: tuple[str, ...] = EMOTIONS

    def __post_init__(self):
        if len(self.names) < 1:
            raise ValueError("a LabelSet needs at least one label")
        if len(set(self.names)) != len(self.names):
            raise ValueError(f"duplicate label names in {self.names}")

    def __len__(self) -> int:
        return len(self.names)

    def __iter__(self):
        return iter(self.names)

    def index(self, name: str) -> int:
        return self.names.index(name)

    def true(self, name: str) -> str:
        return f"true_{name}"

    def prob(self, name: str) -> str:
        return f"prob_{name}"

    def pred(self, name: str) -> str:
        return f"pred_{name}"

    @property
    def true_cols(self) -> list[str]:
        return [self.true(n) for n in self.names]

    @property
    def prob_cols(self) -> list[str]:
        return [self.prob(n) for n in self.names]

    @property
    def pred_cols(self) -> list[str]:
        return [self.pred(n) for n in self.names]


DEFAULT_LABELS = LabelSet()


def labelled_schema(labels: LabelSet = DEFAULT_LABELS, id_type=T.StringType()) -> T.StructType:
    """Schema of a labelled CSV: ``id, text, <labels>``."""
    return T.StructType(
        [T.StructField("id", id_type, True), T.StructField("text", T.StringType(), True)]
        + [T.StructField(n, T.IntegerType(), True) for n in labels.names]
    )


def annotation_schema(labels: LabelSet = DEFAULT_LABELS) -> T.StructType:
    return T.StructType(
        [T.StructField("text", T.StringType(), True), T.StructField("text_id", T.LongType(), True)]
        + [T.StructField(n, T.IntegerType(), True) for n in labels.names]
    )


METRIC_SCHEMA = T.StructType([
    T.StructField("section", T.StringType(), False),
    T.StructField("label", T.StringType(), True),
    T.StructField("metric", T.StringType(), False),
    T.StructField("value", T.DoubleType(), True),
])


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, columns, what: str = "input") -> DataFrame:
    """Fail once, naming every missing column."""
    present = set(df.columns)
    missing = [c for c in columns if c not in present]
    if missing:
        raise MissingColumnsError(f"{what} is missing required columns: {missing}")
    return df
