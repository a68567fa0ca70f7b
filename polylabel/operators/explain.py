"""Token attributions for a whole corpus.

The reference explains one text at a time with KernelSHAP and attention
maps of a transformer. For the linear per-label models of ``model`` the
exact answers are cheap and need no sampling, so every document is explained
in one pass:

* J3 linear SHAP on the log-odds: phi_j = beta_j * (x_j - E[x_j]) with
  x_j = tf_j * idf_j and E[x_j] the mean over the explained corpus;
* J4 occlusion: the change in probability when every occurrence of a token
  is removed, p - sigmoid(z - beta_j * x_j), exact for a linear model.

Work is one shuffle of the texts to their document key, and array arithmetic
over the distinct tokens of a batch of documents, looked up in the model's
coefficients (a token outside the vocabulary keeps its row, with a
contribution of 0).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .features import tokens
from .model import MultiLabelModel

DOCS_AT_ONCE = 512  # documents whose tokens are held at once


def background_mean(model: MultiLabelModel, df: DataFrame, text_col: str = "text"):
    """E[x_j] over ``df``: the mean TF-IDF vector, one distributed
    tree-aggregation (no shuffle) returning a vocabulary-sized vector."""
    from pyspark.ml.stat import Summarizer

    feats = model.features.transform(df.select(F.coalesce(text_col, F.lit("")).alias(text_col)))
    return feats.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()


def token_contributions(model: MultiLabelModel, df: DataFrame, id_col: str = "row_id",
                        text_col: str = "text", drop_tokens=(), mean_x=None, largest=None) -> DataFrame:
    """Per (doc, label, token): tf, x = tf*idf, attribution (J3), occlusion
    delta (J4), the doc's probability, and the signed weight scaled by the
    largest absolute attribution of that doc and label (B26).

    Every token of every text has its rows: one outside the model's vocabulary
    has an ``x``, attribution and occlusion of 0. A null text, and a text
    without tokens (or with dropped ones only), has one row per label with a
    null token and a ``tf`` of 0. With ``largest=(column, k)`` only the rows
    that ``top_tokens`` ranks first of each doc and label come out; they are
    computed from all of the doc's tokens.

    Plan: texts are gathered by their key, one shuffle of texts; all the rest
    is local to a document and computed for an Arrow batch of documents at
    once, so tokens are neither shuffled nor sorted by Spark."""
    labels = model.labels
    if mean_x is None:
        mean_x = background_mean(model, df, text_col)
    words = F.flatten(F.transform("_texts", tokens))
    if drop_tokens:  # B25
        words = F.filter(words, lambda t: ~t.isin(list(drop_tokens)))
    docs = df.groupBy(id_col).agg(F.collect_list(text_col).alias("_texts")).select(id_col, words.alias("_words"))
    schema = T.StructType([docs.schema[id_col]] + [T.StructField(c, k) for c, k in (
        ("label", T.StringType()), ("label_index", T.IntegerType()), ("token", T.StringType()), ("tf", T.LongType()),
        *((c, T.DoubleType()) for c in ("x", "attribution", "occlusion", "prob", "weight")))])
    vocabulary, idf = model.features.stages[1].vocabulary, model.features.stages[2].idf.toArray()
    mean = np.broadcast_to(np.asarray(mean_x, float), (len(vocabulary),))
    beta = np.stack([model.per_label[n].coefficients.toArray() for n in labels.names])
    intercepts = [float(model.per_label[n].intercept) for n in labels.names]
    return docs.mapInArrow(_contributions(vocabulary, idf, mean, beta, intercepts, labels.names, schema.names, largest), schema)


def _contributions(vocabulary, idf, mean, beta, intercepts, names, columns, largest):
    """``token_contributions`` of batches of (id, words)."""
    def sig(z):
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-z))

    def run(batches):
        known = pa.array(vocabulary, pa.string())
        for whole in batches:
            for start in range(0, len(whole), DOCS_AT_ONCE):
                batch = whole.slice(start, DOCS_AT_ONCE)
                ids, words, n = batch.column(0), batch.column(1), len(batch)
                coded = words.flatten().dictionary_encode()
                found = coded.dictionary
                place = np.empty(len(found) + 1, np.int64)  # of the batch's tokens in their order; none comes last
                place[pc.sort_indices(found).to_numpy()] = np.arange(len(found))
                place[-1] = len(found)
                sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                key = np.repeat(np.arange(n), sizes) * (len(found) + 1) + coded.indices.to_numpy()
                key, tf = np.unique(np.concatenate([key, np.flatnonzero(sizes == 0) * (len(found) + 1) + len(found)]), return_counts=True)
                row, code = key // (len(found) + 1), key % (len(found) + 1)
                tf = np.where(code == len(found), 0, tf)
                at = np.append(pc.index_in(found, value_set=known).fill_null(-1).to_numpy(), -1)[code]
                inside = at >= 0
                x = np.where(inside, tf * idf[at], 0.0)
                firsts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
                token = found.take(pa.array(code, mask=code == len(found)))
                for i, name in enumerate(names):
                    b = np.where(inside, beta[i][at], 0.0)
                    z = np.bincount(row, b * x, n)[row] + intercepts[i]
                    attribution = b * (x - np.where(inside, mean[at], 0.0))
                    attribution[np.isnan(attribution)] = 0.0  # B24
                    prob = sig(z)
                    top = np.maximum.reduceat(np.abs(attribution), firsts)[row] if len(row) else attribution
                    scaled = np.minimum(np.divide(np.abs(attribution), top, out=np.zeros(len(row)), where=top > 0), 1.0)
                    out = {"x": x, "attribution": attribution, "occlusion": prob - sig(z - b * x), "prob": prob, "weight": np.sign(attribution) * scaled}
                    pick = np.arange(len(row))
                    if largest:
                        by, k = largest
                        pick = np.lexsort((place[code], -np.abs(out[by]), row))
                        pick = pick[np.arange(len(row)) - firsts[row] < k] if len(row) else pick
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row[pick])), pa.array([name] * len(pick), pa.string()), pa.array(np.full(len(pick), i, np.int32)),
                         token.take(pa.array(pick)), pa.array(tf[pick].astype(np.int64)), *(pa.array(c[pick]) for c in out.values())], columns)
    return run


def top_tokens(contrib: DataFrame, by: str = "attribution", k: int = 5, id_col: str = "row_id") -> DataFrame:
    """Top ``k`` tokens per (doc, label) by absolute ``by`` (ties by token)."""
    w = Window.partitionBy(id_col, "label").orderBy(F.abs(by).desc(), "token")
    return contrib.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def example_attributions(examples: DataFrame, contrib: DataFrame, k: int = 5) -> DataFrame:
    """Attributions of the G3 disagreement examples for the label they
    disagree on (a semi-join on the few example texts). Every example stays."""
    ex = examples.select("annotator_id", "label", "kind", "example_no",
                         F.col("text_id").alias("row_id"))
    sel = contrib.join(ex.select("row_id", "label").distinct(), ["row_id", "label"], "left_semi")
    top = top_tokens(sel, "attribution", k)
    return ex.join(top, ["row_id", "label"], "left")
