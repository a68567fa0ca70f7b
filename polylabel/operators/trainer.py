"""Training by epochs (J2, D20, D21, G5, G6): one run that carries its weights on.

All labels are one matrix of weights (vocabulary and intercept by labels), a
sigmoid per label. An epoch is one pass over the training shards
(``sources.shards``): each shard starts from the epoch's weights, goes through
its batches in their order by AdaGrad with decoupled weight decay, and the
shards' weights and step sizes, averaged by their rows, start the next epoch
(iterative parameter mixing). The averages are added up on the executors; the
driver gets at most ``FAN_IN`` matrices, whose size depends on the vocabulary
and the labels only. Results follow from the shards, not from the layout. Tokens are
looked up in the vocabulary once, before the first epoch.

After each epoch the validation texts are scored; loss (from logits), macro
metrics and the training loss make one row of the history, and training ends
where ``model.early_stop`` would end it. The weights of an epoch are kept as a
table, so a run can be resumed, and any epoch applied.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as LF
from ..schema import DEFAULT_LABELS, LabelSet
from ..sources import shards as SH
from . import metrics as M
from .features import tokens

FAN_IN = 8
PART_BYTES = 64 << 20  # of coded validation texts in a task


@dataclass
class Vocabulary:
    """Tokens by falling count, and their inverse document frequencies."""

    tokens: list[str]
    idf: np.ndarray

    def rows(self, words: pa.Array):
        """(row, token id, tf * idf) of a list column, one entry per row and
        known token, in order."""
        at = pc.index_in(words.flatten(), value_set=pa.array(self.tokens, pa.string()))
        row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        known = at.is_valid().to_numpy(zero_copy_only=False)
        key = row[known] * len(self.tokens) + at.drop_null().to_numpy()
        key, tf = np.unique(key, return_counts=True)
        row, ids = key // max(len(self.tokens), 1), key % max(len(self.tokens), 1)
        return row, ids, tf * self.idf[ids]

    def coded(self, df: DataFrame, words: str) -> DataFrame:
        """``df`` with the known tokens of its list column ``words``, which
        goes, as ``_ids`` and their counts ``_tf``: looked up once, not by
        every pass."""
        known, at = self.tokens, df.columns.index(words)
        own = [f for f in df.schema.fields if f.name != words]

        def run(batches):
            plain = Vocabulary(known, np.ones(len(known)))
            for b in batches:
                row, ids, tf = plain.rows(b.column(at))
                ends = pa.array(np.searchsorted(row, np.arange(len(b) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32), pa.int32())) for v in (ids, tf)]
                yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(b.columns) if k != at), *lists], [*(f.name for f in own), "_ids", "_tf"])

        kind = T.ArrayType(T.IntegerType())
        return df.mapInArrow(run, T.StructType([*own, T.StructField("_ids", kind), T.StructField("_tf", kind)]))


def _entries(ids: pa.Array, tf: pa.Array, idf: np.ndarray):
    """``Vocabulary.rows`` from coded columns."""
    row = np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy(zero_copy_only=False))
    ids = ids.flatten().to_numpy()
    return row, ids, tf.flatten().to_numpy() * idf[ids]


def learn_vocabulary(df: DataFrame, size: int, text_col: str = "text") -> Vocabulary:
    """The ``size`` most frequent tokens (ties by token), counted over all
    texts; idf as ln((n + 1) / (documents + 1))."""
    words = df.select(tokens(F.coalesce(text_col, F.lit(""))).alias("w"))
    n = words.count()
    count = words.select(F.explode("w").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    top = count.orderBy(F.desc("c"), "t").limit(size)
    docs = words.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("d"))
    rows = top.join(docs, "t").orderBy(F.desc("c"), "t").select("t", "d").toArrow()
    return Vocabulary(rows.column("t").to_pylist(), np.log((n + 1) / (rows.column("d").to_numpy() + 1.0)))


def _margins(w: np.ndarray, n: int, row, ids, x) -> np.ndarray:
    """Logits (n, labels); the last row of ``w`` is the intercept."""
    out = np.empty((n, w.shape[1]))
    for k in range(w.shape[1]):
        out[:, k] = np.bincount(row, x * w[ids, k], n)
    return out + w[-1]


def _loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))


def _batch_step(w, g, row, ids, x, y, weight, rate, decay) -> float:
    """One AdaGrad step on a batch, in place; its loss before the step."""
    n = len(y)
    z = _margins(w, n, row, ids, x)
    slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * (weight / n)[:, None]
    seen, at = np.unique(ids, return_inverse=True)
    grad = np.stack([np.bincount(at, x * slope[row, k], len(seen)) for k in range(w.shape[1])], axis=1) if len(seen) else np.zeros((0, w.shape[1]))
    where = np.append(seen, len(w) - 1)
    grad = np.concatenate([grad, slope.sum(0)[None]])
    if decay:
        w[:-1] *= 1 - rate * decay
    g[where] += grad * grad
    w[where] -= rate * grad / (np.sqrt(g[where]) + 1e-8)
    return float((_loss(z, y) * weight[:, None]).sum())


def _epoch(idf: np.ndarray, labels: LabelSet, start: np.ndarray, steps: np.ndarray, rate: float, decay: float):
    names = labels.names

    def run(batches):
        shard, w, g, loss, rows, held = None, None, None, 0.0, 0, None

        def close():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard % FAN_IN], pa.int64()), pa.array([shard], pa.int64()), pa.array([rows], pa.int64()), pa.array([loss]),
                 pa.array([(np.stack([w, g]) * rows).tobytes()], pa.binary())], ["part", "shard", "rows", "loss", "sums"])

        def steps_of(table, last):
            """Whole batches of a table; what may go on is given back."""
            nonlocal shard, w, g, loss, rows
            key = np.stack([table.column("shard").to_numpy(), table.column("batch_in_shard").to_numpy()])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            bounds = [0, *cut.tolist()] + [len(table)] * last
            for a, b in zip(bounds, bounds[1:]):
                if key[0, a] != shard:
                    if shard is not None:
                        yield close()
                    shard, w, g, loss, rows = int(key[0, a]), start.copy(), steps.copy(), 0.0, 0
                part = table.slice(a, b - a).combine_chunks()
                y = np.stack([part.column(c).to_numpy().astype(float) for c in names], axis=1)
                weight = part.column("weight").to_numpy()
                loss += _batch_step(w, g, *_entries(part.column("_ids").chunk(0), part.column("_tf").chunk(0), idf), y, weight, rate, decay)
                rows += b - a
            return table.slice(bounds[-1])

        for batch in batches:
            if len(batch):
                table = pa.Table.from_batches([batch])
                table = table if held is None else pa.concat_tables([held, table])
                held = yield from steps_of(table, 0)
        if held is not None and len(held):
            yield from steps_of(held, 1)
        if shard is not None:
            yield close()
    return run


def _add(table: pa.Table) -> pa.Table:
    table = table.sort_by("shard")
    total = sum(np.frombuffer(s.as_py()) for s in table.column("sums"))
    return pa.table({"part": table.column("part")[:1], "shard": table.column("shard")[:1], "rows": [sum(table.column("rows").to_pylist())],
                     "loss": [float(sum(table.column("loss").to_pylist()))], "sums": pa.array([total.tobytes()], pa.binary())})


_SUMS = "part bigint, shard bigint, rows bigint, loss double, sums binary"


@dataclass
class EpochModel:
    """The weights of one epoch, as a scorer (see ``scorers``) and a table."""

    vocabulary: Vocabulary
    weights: np.ndarray
    labels: LabelSet

    def logits(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """``df`` with ``logit_<label>`` columns."""
        names = [f"logit_{n}" for n in self.labels.names]
        vocabulary, w, own = self.vocabulary, self.weights, df.columns

        def run(batches):
            for b in batches:
                z = _margins(w, len(b), *vocabulary.rows(b.column(len(own))))
                yield pa.RecordBatch.from_arrays([*b.columns[:len(own)], *(pa.array(c) for c in z.T)], [*own, *names])

        schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in names)])
        return df.withColumn("_words", tokens(F.coalesce(text_col, F.lit("")))).mapInArrow(run, schema)

    def coded_logits(self, coded: DataFrame) -> DataFrame:
        """``logits`` of what ``Vocabulary.coded`` gives."""
        idf, w = self.vocabulary.idf, self.weights
        names = [*coded.columns[:-2], *(f"logit_{n}" for n in self.labels.names)]

        def run(batches):
            for b in batches:
                z = _margins(w, len(b), *_entries(b.column(len(b.columns) - 2), b.column(len(b.columns) - 1), idf))
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], *(pa.array(c) for c in z.T)], names)

        return coded.mapInArrow(run, T.StructType([*coded.schema.fields[:-2], *(T.StructField(c, T.DoubleType()) for c in names[len(coded.columns) - 2:])]))

    def __call__(self, df: DataFrame) -> DataFrame:
        z = self.logits(df)
        return z.withColumns({self.labels.prob(n): LF.sigmoid(F.col(f"logit_{n}")) for n in self.labels.names}).drop(*(f"logit_{n}" for n in self.labels.names))

    def table(self, spark: SparkSession) -> DataFrame:
        """(token, <label> ...), the intercept under a null token."""
        cols = {n: self.weights[:, k] for k, n in enumerate(self.labels.names)}
        return spark.createDataFrame(pa.table({"token": [*self.vocabulary.tokens, None], **cols}))


@dataclass
class Run:
    history: DataFrame
    models: list[EpochModel]
    stopped_early: bool


def _validate(model: EpochModel, val: DataFrame, labels: LabelSet) -> dict:
    z = model.coded_logits(val)
    z = z.withColumns({labels.prob(n): LF.sigmoid(F.col(f"logit_{n}")) for n in labels.names})
    z = z.withColumns({labels.pred(n): LF.threshold(labels.prob(n)) for n in labels.names} | {labels.true(n): F.col(n) for n in labels.names})
    s = M.summary_from_sums(M.metric_sums(z, labels), labels).first()
    return {"val_loss": M.bce_loss(z, labels, from_probs=False).first()["bce_loss"], "val_f1": s["macro_f1"],
            "val_precision": s["macro_precision"], "val_recall": s["macro_recall"], "val_accuracy": s["macro_accuracy"]}


def fit_epochs(train: DataFrame, val: DataFrame, path: str, labels: LabelSet = DEFAULT_LABELS, epochs: int = 10, n_shards: int = 4,
               batch_size: int = 32, rate: float = 0.3, weight_decay: float = 0.01, patience: int = 3, min_delta: float = 0.001,
               vocabulary_size: int = 1 << 16, weight_col: str | None = None, run: str = "run") -> Run:
    """Train on ``train`` (row_id, text, labels) and watch ``val``. ``path`` is
    a new folder in shared storage: the shards are written there once and read
    by every epoch. ``weight_col`` (F5) weighs rows, by mean 1 at best.
    Null texts have no
    tokens; a null label counts as 0."""
    spark = train.sparkSession
    vocabulary = learn_vocabulary(train, vocabulary_size)
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = train.select("row_id", tokens(F.coalesce("text", F.lit(""))).alias("words"), weight.alias("weight"),
                        *(F.coalesce(F.col(n), F.lit(0)).cast("double").alias(n) for n in labels.names))
    SH.write_shards(rows, f"{path}/shards", n_shards, batch_size, drop_last=False)
    stored = spark.read.parquet(f"{path}/shards/rows").withColumn("shard", F.col("shard").cast("long"))
    data = (vocabulary.coded(stored.select("shard", "position", "batch_in_shard", "words", "weight", *labels.names), "words")
            .repartitionByRange(n_shards + 1, "shard").sortWithinPartitions("shard", "position")
            .select("shard", "batch_in_shard", "_ids", "_tf", "weight", *labels.names).persist(StorageLevel.MEMORY_AND_DISK))
    seen = vocabulary.coded(val.select(*labels.names, tokens(F.coalesce("text", F.lit(""))).alias("words")), "words").persist(StorageLevel.MEMORY_AND_DISK)
    entries = seen.agg(F.sum(F.size("_ids"))).first()[0] or 0
    # every task of a pass gets the weights: tasks go by the size of the texts
    few = seen.coalesce(max(spark.sparkContext.defaultParallelism, -(-8 * entries // PART_BYTES)))
    shape = (len(vocabulary.tokens) + 1, len(labels))
    w, g = np.zeros(shape), np.zeros(shape)
    history, models, best, wait = [], [], float("-inf"), 0
    try:
        for epoch in range(epochs):
            sums = (data.mapInArrow(_epoch(vocabulary.idf, labels, w, g, rate, weight_decay), _SUMS)
                    .groupBy("part").applyInArrow(_add, _SUMS).orderBy("part").collect())
            n = sum(r.rows for r in sums)
            if not n:
                break
            w, g = (sum(np.frombuffer(r.sums) for r in sums) / n).reshape(2, *shape)
            models.append(EpochModel(vocabulary, w, labels))
            row = {"run": run, "epoch": epoch, "train_loss": sum(r.loss for r in sums) / (n * len(labels)), **_validate(models[-1], few, labels)}
            history.append(row)
            # the rule of model.early_stop, applied while training
            improved = row["val_f1"] - min_delta > best
            best, wait = (row["val_f1"], 0) if improved else (best, wait + 1)
            if wait >= patience:
                break
    finally:
        data.unpersist()
        seen.unpersist()
    names = ["run", "epoch", "train_loss", "val_loss", "val_f1", "val_precision", "val_recall", "val_accuracy"]
    schema = "run string, epoch int, " + ", ".join(f"{c} double" for c in names[2:])
    return Run(spark.createDataFrame([tuple(h[c] for c in names) for h in history], schema), models, wait >= patience)
