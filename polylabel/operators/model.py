"""Training, scoring and run selection.

The reference fine-tunes a transformer on a GPU; that is not rebuilt. The
Spark-native stand-in is binary relevance with MLlib: one shared feature
pipeline (tokenizer -> count vectorizer with a bounded vocabulary -> IDF),
fitted and applied once and cached, then one logistic regression per label
with an L2 penalty (the weight-decay analogue) and optional row weights
(F5). MLlib fits with distributed tree aggregation, so training scales with
the cluster. The explicit vocabulary keeps features interpretable per token
(used by ``explain``).
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import labels as LF
from ..schema import DEFAULT_LABELS, LabelSet
from . import metrics as M
from . import descent
from .features import TOKEN_SPLIT

NUM_FEATURES = 1 << 16
FIT_BYTES = 1 << 30   # of feature blocks held by all fits that run at once
PART_BYTES = 64 << 20  # of features in a partition, at most (unless the input's own are larger)
BLOCK_ENTRIES = 1 << 18  # of counts in a block of rows


@dataclass
class MultiLabelModel:
    features: PipelineModel
    per_label: dict[str, LogisticRegressionModel]
    labels: LabelSet
    threshold: float = 0.5


def feature_pipeline(text_col: str = "text", num_features: int = NUM_FEATURES) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=TOKEN_SPLIT, toLowercase=True),
        CountVectorizer(inputCol="_tokens", outputCol="_tf", vocabSize=num_features),
        IDF(inputCol="_tf", outputCol="features"),
    ])


def fit_features(df: DataFrame, text_col: str = "text", num_features: int = NUM_FEATURES) -> PipelineModel:
    """``feature_pipeline`` fitted, with the words counted by an aggregation:
    CountVectorizer's own fit sends ``num_features`` words of every partition
    to the driver. Words of equal count go by their order."""
    tokenizer, vectorizer, idf = feature_pipeline(text_col, num_features).getStages()
    split = tokenizer.transform(df.select(text_col))
    counts = split.select(F.explode("_tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "t").limit(num_features).toArrow()
    words = CountVectorizerModel.from_vocabulary(top.column("t").to_pylist(), inputCol=vectorizer.getInputCol(), outputCol=vectorizer.getOutputCol())
    return PipelineModel([tokenizer, words, idf.fit(words.transform(split))])


def cached_features(fm: PipelineModel, df: DataFrame, cols) -> tuple[DataFrame, DataFrame, int]:
    """(persisted features and ``cols``, the same in few partitions, how many
    fits may run at once). Every fit holds blocks of all features, and sends a
    gradient per partition through its tree of sums, so fits at once and
    partitions go by the size of the features."""
    cached = fm.transform(df).select("features", *cols, F.size(F.array_distinct("_tokens")).alias("_entries")).persist()
    size = 12 * (cached.agg(F.sum("_entries")).first()[0] or 0)
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return cached, cached.drop("_entries").coalesce(parts), max(1, FIT_BYTES // max(size, 1))


def train(df: DataFrame, labels: LabelSet = DEFAULT_LABELS, text_col: str = "text",
          weight_col: str | None = None, reg_param: float = 0.01, max_iter: int = 20,
          num_features: int = NUM_FEATURES, features_model: PipelineModel | None = None,
          parallel_fits: int = 8, features_df: DataFrame | None = None) -> MultiLabelModel:
    """Binary relevance training. The feature matrix is computed once and
    persisted for the L fits (or passed in, already persisted, as
    ``features_df``). At most ``parallel_fits`` run at once, fewer where
    features are large (``cached_features``)."""
    fm = features_model or fit_features(df, text_col, num_features)
    own = features_df is None
    feats = features_df
    if own:
        cached, feats, at_once = cached_features(fm, df, [*labels.names, *([weight_col] if weight_col else [])])
        parallel_fits = min(parallel_fits, at_once)

    def fit_one(n):
        lr = LogisticRegression(featuresCol="features", labelCol=n, regParam=reg_param,
                                elasticNetParam=0.0, maxIter=max_iter, standardization=False, aggregationDepth=3,
                                predictionCol=f"_p_{n}", probabilityCol=f"_pr_{n}",
                                rawPredictionCol=f"_raw_{n}")
        if weight_col:
            lr = lr.setWeightCol(weight_col)
        return n, lr.fit(feats.withColumn(n, F.col(n).cast("double")))

    # The L fits are independent jobs over the same cached features; small ones
    # are submitted concurrently, so per-iteration stages share the cores.
    try:
        with ThreadPoolExecutor(max_workers=max(1, min(parallel_fits, len(labels)))) as pool:
            models = dict(pool.map(fit_one, labels.names))
    finally:
        if own:
            cached.unpersist()
    return MultiLabelModel(fm, {n: models[n] for n in labels.names}, labels)


def score(model: MultiLabelModel, df: DataFrame, keep=("row_id",)) -> DataFrame:
    """J1 + B12: ``prob_<label>`` (sigmoid of the margin) and ``pred_<label>``
    (strict threshold) for every row, in one pass of projections."""
    out = model.features.transform(df)
    for n, m in model.per_label.items():
        out = m.transform(out).withColumn(f"prob_{n}", vector_to_array(f"_pr_{n}")[1]) \
            .drop(f"_p_{n}", f"_pr_{n}", f"_raw_{n}")
    labels = model.labels
    out = out.withColumns({labels.pred(n): LF.threshold(labels.prob(n), model.threshold)
                           for n in labels.names})
    cols = [c for c in keep if c in df.columns]
    extra = [c for c in df.columns if c not in cols and c not in ("features",)]
    return out.select(*cols, *[c for c in extra if not c.startswith("_")], *labels.prob_cols, *labels.pred_cols)


def score_with(df: DataFrame, scorer, schema: str) -> DataFrame:
    """J1 for any external model: ``scorer`` maps an iterator of pandas
    frames to an iterator of pandas frames (load the model once per task,
    score Arrow batches). Runs as ``mapInPandas``."""
    return df.mapInPandas(scorer, schema=schema)


# ------------------------------------------------------------- run history

def _counts(fm: PipelineModel, df: DataFrame, cols) -> DataFrame:
    """``cols`` and the known words of the texts, as ``ids`` and ``tf``."""
    tf = F.unwrap_udt("_tf")
    return PipelineModel(fm.stages[:2]).transform(df).select(*cols, tf["indices"].alias("ids"), tf["values"].alias("tf"))


def _entries(batch, last: int):
    """(sizes, ids, counts) of the two list columns that end at ``last``."""
    ids, tf = batch.column(last - 1), batch.column(last)
    return ids.value_lengths().to_numpy(zero_copy_only=False), ids.flatten().to_numpy(), tf.flatten().to_numpy()


def _blocks(counts: DataFrame, n_labels: int, known: int) -> DataFrame:
    """Rows of ``_counts`` (labels first) in blocks of arrays: the narrowest
    integers that hold them."""
    wide = "<u2" if known <= 1 << 16 else "<u4"

    def run(batches):
        for batch in batches:
            sizes, ids, tf = _entries(batch, n_labels + 1)
            y = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_labels)], axis=1)
            if not ((y == 0) | (y == 1)).all():
                raise ValueError("labels must be 0 or 1")
            ends = np.append(0, np.cumsum(sizes))
            row = 0
            while row < len(sizes):
                stop = max(row + 1, int(np.searchsorted(ends, ends[row] + BLOCK_ENTRIES, "right")) - 1)
                a, b = ends[row], ends[stop]
                few = "<u2" if b == a or tf[a:b].max() < 1 << 16 else "<i8"
                arrays = [v.tobytes() for v in (sizes[row:stop].astype("<i4"), ids[a:b].astype(wide), tf[a:b].astype(few), y[row:stop].astype("i1"))]
                yield pa.RecordBatch.from_arrays([pa.array([int(b - a)], pa.int64()), *(pa.array([v], pa.binary()) for v in arrays)],
                                                 ["entries", "sizes", "ids", "tf", "y"])
                row = stop
    return counts.mapInArrow(run, "entries long, sizes binary, ids binary, tf binary, y binary")


def _each_block(batches, n_labels: int):
    """(row of each entry, ids, counts, y (rows, labels)) of the blocks."""
    for batch in batches:
        for entries, *raw in zip(*(batch.column(c).to_pylist() for c in ("entries", "sizes", "ids", "tf", "y"))):
            wide = {k: f"<u{len(raw[k]) // max(entries, 1)}" for k in (1, 2)} if entries else {1: "<u2", 2: "<u2"}
            sizes, ids, tf = (np.frombuffer(raw[k], d) for k, d in ((0, "<i4"), (1, wide[1]), (2, wide[2])))
            yield np.repeat(np.arange(len(sizes)), sizes), ids.astype(np.int64), tf.astype(float), np.frombuffer(raw[3], "i1").reshape(-1, n_labels)


def _added(blocks: DataFrame, of, size: int, n_labels: int) -> np.ndarray:
    """The sum of ``of(row, ids, tf, y)``, a vector, over all blocks: added in
    the tasks, then in groups of them, in the order of the partitions."""
    fan = max(4, math.isqrt(blocks.rdd.getNumPartitions()))
    kind = "fan int, part int, sums binary"

    def run(batches):
        from pyspark import TaskContext

        total, at = np.zeros(size), TaskContext.get().partitionId()
        for block in _each_block(batches, n_labels):
            total += of(*block)
        yield pa.RecordBatch.from_arrays([pa.array([at % fan], pa.int32()), pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                         ["fan", "part", "sums"])

    def add(table):
        table = table.sort_by("part")
        total = sum(np.frombuffer(s.as_py()) for s in table.column("sums"))
        return pa.table({"fan": table.column("fan")[:1], "part": table.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    got = blocks.mapInArrow(run, kind).groupBy("fan").applyInArrow(add, kind).toArrow().sort_by("fan")
    return sum((np.frombuffer(s.as_py()) for s in got.column("sums")), np.zeros(size))


def _margins(row, ids, tf, w, shift, n: int) -> np.ndarray:
    """Logits (n, columns of ``w``)."""
    out = np.empty((n, len(shift)))
    for k in range(len(shift)):
        out[:, k] = np.bincount(row, tf * w[k, ids], n) + shift[k]
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def training_path(blocks: DataFrame, idf: np.ndarray, n_labels: int, steps: int, reg_param: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights of a word's count (steps + 1, labels, words), intercepts) after
    0 to ``steps`` optimiser passes of each label's logistic regression: what
    MLlib's fits with ``maxIter`` of 0 to ``steps`` give, all from one run. Each
    evaluation is one job over the blocks for all labels at once. As MLlib does,
    words are centred and scaled by their deviation, and the penalty is on the
    unscaled weights."""
    v = len(idf)

    def moments(row, ids, tf, y):
        return np.concatenate([np.bincount(ids, tf, v), np.bincount(ids, tf * tf, v), y.sum(0, dtype=float), [len(y)]])

    total = _added(blocks, moments, 2 * v + n_labels + 1, n_labels)
    n, positive = total[-1], total[2 * v:-1]
    if not n:
        raise ValueError("no rows to train on")
    variance = np.maximum(total[v:2 * v] - total[:v] ** 2 / n, 0) / (n - 1) if n > 1 else np.zeros(v)
    std = idf * np.sqrt(variance)
    scale = np.divide(1.0, std, out=np.zeros(v), where=std > 0)  # of a feature
    centre, unit = idf * total[:v] / n * scale, idf * scale      # of a scaled feature, and of a count
    penalty = reg_param * scale * scale

    def evaluate(points: dict) -> dict:
        at = list(points)
        w = np.stack([points[k][:-1] * unit for k in at])
        shift = np.array([points[k][-1] - points[k][:-1] @ centre for k in at])

        def of(row, ids, tf, y):
            z, y = _margins(row, ids, tf, w, shift, len(y)), y[:, at]
            slope = _sigmoid(z) - y
            loss = np.where(y == 1, np.logaddexp(0, -z), np.logaddexp(0, z)).sum(0)
            return np.concatenate([*(np.bincount(ids, tf * slope[row, k], v) for k in range(len(at))), slope.sum(0), loss])

        m = len(at)
        total = _added(blocks, of, m * (v + 2), n_labels) / n
        out = {}
        for i, k in enumerate(at):
            x, slope = points[k][:-1], total[m * v + i]
            gradient = np.append(total[i * v:(i + 1) * v] * unit - centre * slope + penalty * x, slope)
            out[k] = float(total[m * (v + 1) + i] + 0.5 * (penalty * x) @ x), gradient
        return out

    # a label that is the same in all rows has no weights, as with MLlib
    mixed = [k for k in range(n_labels) if 0 < positive[k] < n]
    starts = {k: np.append(np.zeros(v), math.log(positive[k] / (n - positive[k]))) for k in mixed}
    weights, shifts = np.zeros((steps + 1, n_labels, v)), np.zeros((steps + 1, n_labels))
    shifts[:, positive == 0], shifts[:, positive == n] = -np.inf, np.inf
    for k, path in descent.together(starts, steps, evaluate).items():
        for e in range(steps + 1):
            x = path[min(e, len(path) - 1)]
            weights[e, k], shifts[e, k] = x[:-1] * unit, x[-1] - x[:-1] @ centre
    return weights, shifts


def epoch_history(train_df: DataFrame, val_df: DataFrame, labels: LabelSet = DEFAULT_LABELS,
                  epochs=(1, 2, 3, 4, 5, 6), run: str = "run", reg_param: float = 0.01,
                  features_model: PipelineModel | None = None) -> DataFrame:
    """Run history (run, epoch, val metrics): the model after ``e`` optimiser
    passes is scored on the validation view and evaluated with the D21
    macro metrics (accuracy, F1, precision, recall at threshold 0.5).
    The feature pipeline is fitted once (or passed in, fitted on the same
    texts); one run of the optimiser passes by all
    its epochs (``training_path``), and one pass over the validation texts
    scores them by the models of all epochs."""
    fm = features_model or fit_features(train_df)
    idf, size = fm.stages[2].idf.toArray(), len(labels)
    cached = _blocks(_counts(fm, train_df, labels.names), size, len(idf)).persist()
    scored = None
    try:
        entries = cached.agg(F.sum("entries")).first()[0] or 0
        parts = max(train_df.sparkSession.sparkContext.defaultParallelism, -(-4 * entries // PART_BYTES))
        weights, shifts = training_path(cached.coalesce(parts), idf, size, max(epochs), reg_param)
        weights, shifts = weights[list(epochs)].reshape(len(epochs) * size, -1), shifts[list(epochs)].ravel()
        truth = val_df.select("row_id", *[F.col(n).alias(labels.true(n)) for n in labels.names])
        texts = _counts(fm, val_df.select("row_id", "text"), ["row_id"])

        def probabilities(batches):
            for batch in batches:
                for k in range(0, len(batch), 512):
                    part = batch.slice(k, 512)
                    sizes, ids, tf = _entries(part, 2)
                    p = _sigmoid(_margins(np.repeat(np.arange(len(part)), sizes), ids, tf, weights, shifts, len(part)))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists], ["row_id", "_probs"])

        schema = T.StructType([texts.schema["row_id"], T.StructField("_probs", T.ArrayType(T.DoubleType()))])
        scored = texts.mapInArrow(probabilities, schema).join(truth, "row_id").persist()
        out = None
        for i in range(len(epochs)):
            at = scored.withColumns({labels.pred(n): LF.threshold(F.col("_probs")[i * size + k]) for k, n in enumerate(labels.names)})
            summ = M.summary_from_sums(M.metric_sums(at, labels), labels)
            one = summ.select(F.lit(run).alias("run"), F.lit(i).alias("epoch"),
                              F.col("macro_f1").alias("val_f1"),
                              F.col("macro_precision").alias("val_precision"),
                              F.col("macro_recall").alias("val_recall"),
                              F.col("macro_accuracy").alias("val_accuracy"))
            out = one if out is None else out.unionByName(one)
        rows = sorted(out.collect(), key=lambda r: r["epoch"])
    finally:
        for df in (cached, scored):
            if df is not None:
                df.unpersist()
    spark = train_df.sparkSession
    return spark.createDataFrame(rows, "run string, epoch int, val_f1 double, val_precision double, "
                                       "val_recall double, val_accuracy double")


def top_epochs(history: DataFrame, metric: str = "val_f1", k: int = 3) -> DataFrame:
    """Per run, the ``k`` best epochs by ``metric`` plus the last epoch
    (what a top-k + last checkpoint policy keeps). Windows are per run; a
    run has one row per epoch."""
    w_rank = Window.partitionBy("run").orderBy(F.col(metric).desc(), "epoch")
    w_run = Window.partitionBy("run")
    out = (history.withColumn("rank", F.row_number().over(w_rank))
           .withColumn("is_last", F.col("epoch") == F.max("epoch").over(w_run)))
    return out.filter((F.col("rank") <= k) | F.col("is_last"))


def early_stop(history: DataFrame, metric: str = "val_f1", patience: int = 3,
               min_delta: float = 0.001) -> DataFrame:
    """Per run, the epoch where training stops and the best value, with
    an improvement counted only when it exceeds best + min_delta (so the best
    does not move on small gains; not a running max). An ordered fold over
    the run's epochs (one small array per run)."""
    init = F.struct(F.lit(float("-inf")).alias("best"), F.lit(-1).alias("best_epoch"),
                    F.lit(0).alias("wait"), F.lit(None).cast("int").alias("stop_epoch"))

    def step(acc, x):
        improved = (x[metric] - F.lit(min_delta)) > acc["best"]
        done = acc["stop_epoch"].isNotNull()
        wait = F.when(improved, F.lit(0)).otherwise(acc["wait"] + 1)
        return F.when(done, acc).otherwise(F.struct(
            F.when(improved, x[metric]).otherwise(acc["best"]).alias("best"),
            F.when(improved, x["epoch"]).otherwise(acc["best_epoch"]).alias("best_epoch"),
            wait.alias("wait"),
            F.when(wait >= patience, x["epoch"]).otherwise(F.lit(None).cast("int")).alias("stop_epoch")))

    seq = history.groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"),
                                             F.col(metric).cast("double").alias(metric)))).alias("_h"))
    folded = seq.select("run", F.aggregate("_h", init, step).alias("_s"),
                        F.size("_h").alias("n_epochs"))
    return folded.select("run", F.col("_s.best").alias(f"best_{metric}"), F.col("_s.best_epoch").alias("best_epoch"),
                         F.col("_s.stop_epoch").alias("stop_epoch"),
                         F.col("_s.stop_epoch").isNotNull().alias("stopped_early"), "n_epochs")
