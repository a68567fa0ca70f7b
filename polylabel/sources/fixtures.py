"""Label fixtures derived from the driver's ``documents`` / ``labels`` tables.

The driver ships raw text tables only, so truth, scores, class ids and
annotations are derived from ``doc_id`` with fixed arithmetic rules. Every
rule below has a twin in ``__spark_entry__.oracle_sql`` so DuckDB can rebuild
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import threshold
from ..schema import DEFAULT_LABELS, LabelSet
from ..session import spread

# Truth rule per label, true when doc_id % modulus < cutoff.
TRUTH_RULES = {
    "anger": (10, 3),
    "fear": (7, 3),
    "joy": (11, 3),
    "sadness": (13, 4),
    "surprise": (17, 5),
}

# List-corpus class ids per row are doc_id times these factors, mod 28.
LIST_ID_FACTORS = (1, 7, 11)
N_LIST_CLASSES = 28
N_SINGLE_CLASSES = 6

# Annotators A1..A3; A_k annotates doc_id % k = 0 and flips label
# i when (doc_id*13 + i + k) % 23 = 0.
ANNOTATORS = (1, 2, 3)


# Text-heavy tables and the key used to spread them when the scan is narrow.
SPREAD_KEYS = {"documents": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in SPREAD_KEYS:
        df = spread(df, SPREAD_KEYS[name])
    return df


def with_truth(docs: DataFrame, labels: LabelSet = DEFAULT_LABELS, prefix: str = "true_") -> DataFrame:
    """Adds ``<prefix><label>`` 0/1 columns from the doc_id rules."""
    cols = {}
    for name in labels.names:
        mod, cut = TRUTH_RULES[name]
        cols[f"{prefix}{name}"] = F.when(F.col("doc_id") % mod < cut, F.lit(1)).otherwise(F.lit(0))
    return docs.withColumns(cols)


def labelled(spark: SparkSession, sf_dir: str, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """Labelled table: row_id, text, source, lang, <label> x L."""
    docs = table(spark, sf_dir, "documents")
    return with_truth(docs, labels, prefix="").select(
        F.col("doc_id").alias("row_id"), "text", "source", "lang", *labels.names)


def with_scores(df: DataFrame, labels: LabelSet = DEFAULT_LABELS, id_col: str = "doc_id") -> DataFrame:
    """Deterministic probabilities and strict-threshold predictions."""
    d = F.col(id_col)
    cols = {}
    for i, name in enumerate(labels.names):
        t = F.col(f"true_{name}")
        base = F.when(t == 1, F.lit(0.51) + (d % 49).cast("double") / 100) \
                .otherwise((d % 51).cast("double") / 100)
        cols[f"prob_{name}"] = F.when((d * 31 + i) % 19 == 0, F.lit(1) - base).otherwise(base)
    df = df.withColumns(cols)
    return df.withColumns({f"pred_{n}": threshold(f"prob_{n}") for n in labels.names})


def scored(spark: SparkSession, sf_dir: str, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """Scored table: row_id, text, source, lang, true_/prob_/pred_ x L."""
    return scored_from_docs(table(spark, sf_dir, "documents"), labels)


def scored_from_docs(docs: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """Same as ``scored`` on any documents DataFrame (also a streaming one)."""
    df = with_scores(with_truth(docs, labels), labels)
    return df.select(F.col("doc_id").alias("row_id"), "text", "source", "lang",
                     *labels.true_cols, *labels.prob_cols, *labels.pred_cols)


def dirty_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with placeholders, an emoji and blank rows injected."""
    return dirty_from_docs(table(spark, sf_dir, "documents"))


def dirty_from_docs(docs: DataFrame) -> DataFrame:
    d, t = F.col("doc_id"), F.col("text")
    dirty = (F.when(d % 5 == 0, F.concat(F.lit("[NAME] "), t))
             .when(d % 5 == 1, F.concat(t, F.lit("  [USER]")))
             .when(d % 5 == 2, F.concat(F.lit("\U0001F600 "), t, F.lit(" [URL]")))
             .when(d % 25 == 3, F.lit("[NAME]"))
             .when(d % 25 == 8, F.lit("   "))
             .otherwise(t))
    return docs.select(F.col("doc_id").alias("row_id"), dirty.alias("text"), "source", "lang")


def list_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List-labelled corpus: row_id, text, source, labels array<int>."""
    docs = table(spark, sf_dir, "documents")
    ids = F.array_distinct(F.array(*[((F.col("doc_id") * k) % N_LIST_CLASSES).cast("int")
                                     for k in LIST_ID_FACTORS]))
    return docs.select(F.col("doc_id").alias("row_id"), "text", "source", ids.alias("labels"))


def single_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-label corpus: row_id, text, source, label int (0..5)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("row_id"), "text", "source",
                       (F.col("doc_id") % N_SINGLE_CLASSES).cast("int").alias("label"))


def annotations(spark: SparkSession, sf_dir: str, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """Annotated table: annotator_id, text_id, text, <label> x L for A1..A3.

    Each annotator's rows are one ``select`` over ``documents``; the union is
    a plain concatenation (no shuffle)."""
    docs = with_truth(table(spark, sf_dir, "documents"), labels)
    parts = []
    for k in ANNOTATORS:
        d = F.col("doc_id")
        flips = {name: F.when((d * 13 + i + k) % 23 == 0, F.lit(1) - F.col(f"true_{name}"))
                 .otherwise(F.col(f"true_{name}")).alias(name)
                 for i, name in enumerate(labels.names)}
        parts.append(docs.filter(d % k == 0).select(
            F.lit(f"A{k}").alias("annotator_id"), d.alias("text_id"), "text",
            *flips.values()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Second natural truth: the driver's own ``labels`` table joined to documents.
QUALITY_LABELS = LabelSet(("quality", "toxic"))


def quality_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth from ``labels``; predictions from document length rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels")
    j = lab.join(docs, "doc_id", "inner")
    return j.select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").alias("true_quality"), F.col("toxic").alias("true_toxic"),
        F.col("n_chars").between(200, 6000).cast("int").alias("pred_quality"),
        (F.col("n_chars") % 7 == 0).cast("int").alias("pred_toxic"))


# ------------------------------------------------------------ a black box

def token_code(token: str) -> int:
    """The leading 32 bits of md5(token)."""
    import hashlib

    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16)


def load_neighbour_model():
    """A stand-in for a model of another library: a function from texts to one
    probability per label. It sees nothing but the text, and is not linear in
    its tokens: a label's evidence is its distinct tokens (by code modulo 5),
    times its tokens that stand before one of code 0 modulo 3."""
    import itertools

    import numpy as np

    class Codes(dict):
        def __missing__(self, token):
            self[token] = code = token_code(token)
            return code

    codes = Codes()

    def model(texts):
        words = [t.split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        b = np.fromiter(map(codes.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
        row, n = np.repeat(np.arange(len(words)), sizes), 5 * len(words)
        seen = np.sort(row << 32 | b)
        seen = seen[np.append(True, seen[1:] != seen[:-1])] if len(seen) else seen
        kinds = np.bincount((seen >> 32) * 5 + (seen & 0xFFFFFFFF) % 5, minlength=n)
        next_to = (row[1:] == row[:-1]) & (b[1:] % 3 == 0)
        before = np.bincount((row[:-1] * 5 + b[:-1] % 5)[next_to], minlength=n)
        evidence = (kinds * (1 + before)).reshape(-1, 5)
        return (1 + evidence) / (3 + sizes[:, None] + evidence)
    return model
