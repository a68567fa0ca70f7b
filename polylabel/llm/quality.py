"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled as good; everything else is unlabelled web
text, a mixture with an estimated class prior ``p`` of positives. A small
network f is fitted by minimising the non-negative unbiased risk

    p E_P[l(f, +)] + max(0, E_U[l(f, -)] - p E_P[l(f, -)])

with the logistic loss, where a batch that makes the second part negative
steps against it instead (so the network can't win by overfitting the
positives). Negative labels never enter the risk; they only count in the prior,
which is the share of positives among the labelled rows.

Features are dense statistics of the whole text (character classes, word
shape and repetition, line repetition), computed in one vectorised pass and
staged as a narrow table; means and deviations are taken over all rows. The
network starts from a fit on about ``FIT_ROWS`` positives and as many unlabelled
rows, drawn by hash. From there ``PASSES`` steps go down the risk of the whole
table: every step is one pass, E_P and E_U being over all trusted positives and
all rows, each task adding up its gradients, and the tasks' sums being added on
the executors down to at most ``FAN_IN``. Scoring covers every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polylabel.llm import common as C
from polylabel.llm.toxicity import label_rows

FIT_ROWS = 20_000
HIDDEN, STEPS, BATCH, RATE = 16, 1500, 1024, 0.01
PASSES, PASS_RATE, FAN_IN = 30, 0.01, 16
_SIGNS = b"!?.,;:|#%$&*\"'-_/=()[]{}<>@"
_CLASSES = {
    "upper": C.byte_table(bytes(range(0x41, 0x5B))), "lower": C.byte_table(bytes(range(0x61, 0x7B))),
    "digit": C.byte_table(bytes(range(0x30, 0x3A))), "wide": C.byte_table(bytes(range(0x80, 0x100))),
    "space": ~C.NON_SPACE, "line": C.byte_table(b"\n"), **{f"sign_{x:02x}": C.byte_table(bytes([x])) for x in _SIGNS},
}
NAMES = [*_CLASSES, "log_words", "word_length", "long_words", "word_variety", "word_repeats", "top_word", "pair_variety",
         "bare_words", "capital_words", "log_lines", "line_words", "line_variety"]


def _per_text(flags: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(upto[ptr])


def _distinct(values: np.ndarray, text: np.ndarray, n: int):
    """(distinct values per text, highest count of one value per text)."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(v)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, t[heads], counts)
    return np.bincount(t[heads], minlength=n), top


def features(column) -> np.ndarray:
    """A row of ``NAMES`` for each text; all 0 for a text without bytes."""
    buf, offs = C.utf8(column)
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1)
    out = [_per_text(table[buf], offs) / size for table in _CLASSES.values()]
    starts, ends, ptr = C.words(buf, offs, C.NON_SPACE)
    words = np.diff(ptr)
    some = np.maximum(words, 1)
    text = np.repeat(np.arange(n), words)
    length = ends - starts
    h = C.span_hash(C.prefix_hash(buf, C.FOLDED), starts, ends)
    variety, top = _distinct(h, text, n)
    pairs = C.rolling(h, 2)
    at = np.flatnonzero(C.inside(ptr, 2, len(pairs)))
    pair_variety, _ = _distinct(pairs[at], text[at], n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    letters = np.concatenate([[0], np.cumsum(C.ALNUM_WIDE[buf])])
    capitals = np.concatenate([[0], np.cumsum(_CLASSES["upper"][buf])])
    bare = letters[ends] - letters[starts]
    line_ends = _per_text(_CLASSES["line"][buf], offs)
    cut = np.flatnonzero(_CLASSES["line"][buf])
    line_of = np.concatenate([np.arange(n), np.searchsorted(offs, cut, "right") - 1])
    line_from, line_to = np.concatenate([offs[:-1], cut + 1]), np.concatenate([offs[1:], cut])
    order = np.lexsort((line_from, line_of))
    to = line_to[np.lexsort((line_to, line_of))]
    line_hash = C.span_hash(C.prefix_hash(buf, C.EXACT), line_from[order], to)
    lines, _ = _distinct(line_hash, line_of[order], n)
    out += [np.log1p(words), _per_text(length, ptr) / some, _per_text(length > 20, ptr) / some, variety / some, _per_text(again, ptr) / some, top / some,
            pair_variety / np.maximum(words - 1, 1), _per_text(bare == 0, ptr) / some,
            _per_text((capitals[ends] - capitals[starts] == bare) & (bare > 1), ptr) / some,
            np.log1p(line_ends), words / (line_ends + 1), lines / (line_ends + 1)]
    out = np.stack(out, axis=1).astype(np.float64)
    out[np.diff(offs) == 0] = 0
    return out


def _featurise(batches):
    for batch in C.chunks(batches):
        x = features(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), C.lists(x.reshape(-1), np.full(len(x), x.shape[1]), pa.float64())], ["id", "x"])


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(self.standard(x) @ w1 + b1) @ w2 + b2

    def standard(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)


def _gradients(x, weights, slope):
    """Gradients of a sum whose slope by each row's logit is ``slope``."""
    w1, b1, w2, _ = weights
    hidden = np.tanh(x @ w1 + b1)
    back = slope[:, None] * w2[None, :] * (1 - hidden ** 2)
    return [x.T @ back, back.sum(0), hidden.T @ slope, slope.sum()]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Adam:
    """Steps on ``w`` in place, with a little decay of the two matrices."""

    def __init__(self, w: list):
        self.w, self.step = w, 0
        self.m, self.v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]

    def __call__(self, grads: list, rate: float) -> None:
        self.step += 1
        grads = list(grads)
        grads[0] = grads[0] + 1e-4 * self.w[0]
        grads[2] = grads[2] + 1e-4 * self.w[2]
        for i, g in enumerate(grads):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.w[i] = self.w[i] - rate * (self.m[i] / (1 - 0.9 ** self.step)) / (np.sqrt(self.v[i] / (1 - 0.999 ** self.step)) + 1e-8)


def risk_sums(x: np.ndarray, trusted: np.ndarray, weights: list) -> np.ndarray:
    """What a stretch of rows adds to the risk and its gradients: rows,
    trusted rows, sums of l(f, -) over both, then the gradients of the sums of
    l(f, -) over all rows, of l(f, -) and of f over the trusted rows."""
    z = np.tanh(x @ weights[0] + weights[1]) @ weights[2] + weights[3]
    loss = np.logaddexp(0, z)
    slopes = (_sigmoid(z), _sigmoid(z) * trusted, trusted.astype(float))
    grads = [g.reshape(-1) for s in slopes for g in map(np.asarray, _gradients(x, weights, s))]
    return np.concatenate([[len(x), trusted.sum(), loss.sum(), loss[trusted].sum()], *grads])


def risk_gradient(sums: np.ndarray, prior: float, weights: list) -> list:
    """The step's gradients from the sums over the whole table."""
    n_u, n_p, l_u, l_p = sums[:4]
    each = sums[4:].reshape(3, -1)
    if l_u / n_u - prior * l_p / n_p >= 0:
        flat = each[0] / n_u - prior * each[2] / n_p
    else:
        flat = prior * each[1] / n_p - each[0] / n_u
    cuts = np.cumsum([a.size for a in weights])[:-1]
    return [g.reshape(a.shape) for g, a in zip(np.split(flat, cuts), weights)]


def _whole_table(rows: DataFrame, net: Network) -> np.ndarray:
    """``risk_sums`` over all rows (x, trusted)."""
    def run(batches):
        total = 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(len(batch), len(NAMES))
            total = total + risk_sums(net.standard(x), batch.column(1).to_numpy(zero_copy_only=False), net.weights)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % FAN_IN], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "m"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"g": table.column("g")[:1], "m": pa.array([sum(np.frombuffer(m.as_py()) for m in table.column("m")).tobytes()], pa.binary())})

    parts = rows.select("x", "trusted").mapInArrow(run, "g int, m binary").groupBy("g").applyInArrow(add, "g int, m binary")
    return sum(np.frombuffer(r.m) for r in parts.orderBy("g").collect())


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, mean: np.ndarray, scale: np.ndarray, seed: int = 0) -> Network:
    """Minimise the non-negative risk by Adam."""
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(())]
    net = Network(mean, scale, w)
    p_all, u_all = net.standard(positive), net.standard(unlabelled)
    adam, sigmoid = Adam(w), _sigmoid
    for _ in range(STEPS):
        p = p_all[rng.integers(0, len(p_all), min(BATCH, 4 * len(p_all)))]
        u = u_all[rng.integers(0, len(u_all), min(BATCH, 4 * len(u_all)))]
        zp, zu = (np.tanh(a @ w[0] + w[1]) @ w[2] + w[3] for a in (p, u))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            # p E_P[l(+)] + E_U[l(-)] - p E_P[l(-)]; for the logistic loss the two positive parts sum to -p E_P[f]
            parts = [(p, np.full(len(p), -prior / len(p))), (u, sigmoid(zu) / len(u))]
        else:
            parts = [(u, -sigmoid(zu) / len(u)), (p, prior * sigmoid(zp) / len(p))]
        grads = [sum(g) for g in zip(*(_gradients(a, w, s) for a, s in parts))]
        adam(grads, RATE)
    net.weights = w
    return net


def quality(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality") -> DataFrame:
    """One row per input row: the id and ``score``, the probability (0 to 1)
    that the text is good. ``training`` says, of the column ``_label_id``,
    which labelled ids may be learned from.

    Null and empty texts have all features 0 and are scored like any text;
    repeated rows each give a row. Without positives, or without documents to
    hold them against, every score is the prior (0.5 without labels). Extra
    columns of either table are ignored."""
    scratch = C.Scratch(docs.sparkSession, "quality")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    x = scratch.stage(src.mapInArrow(_featurise, f"id {kind}, x array<double>"), "features")
    known = label_rows(labels, label_col).filter(training)
    share = known.agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")).first()
    prior = ((share.t or 0) + 0.5) / (share.n + 1)
    good = known.filter("label = 1").select(F.col("_label_id").alias("good")).distinct()
    x = scratch.stage(x.join(good, F.col("id") == F.col("good"), "left").select("id", "x", F.col("good").isNotNull().alias("trusted")), "rows")
    scratch.drop("features")
    count = x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("trusted").cast("long")).alias("p")).first()
    matrix = lambda c: np.array(c.to_pylist(), np.float64).reshape(len(c), len(NAMES))

    def few(df, n):
        # by hash, so that each task sends its share of about FIT_ROWS rows only
        share = min(1.0, FIT_ROWS / max(n or 0, 1))
        drawn = df.filter(F.pmod(F.xxhash64("id", "x"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
        return matrix(drawn.orderBy(F.xxhash64("id"), "id").select("x").toArrow().column("x"))

    positive, unlabelled = few(x.filter("trusted"), count.p), few(x, count.n)
    if not len(positive) or not len(unlabelled):
        return x.select(F.col("id").alias(id_col), F.lit(float(prior)).alias("score"))
    stats = x.agg(*(f(F.col("x")[i]).alias(f"{n}{i}") for i in range(len(NAMES)) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([stats[f"m{i}"] for i in range(len(NAMES))])
    scale = np.array([max(stats[f"s{i}"], 1e-6) for i in range(len(NAMES))])
    net = fit(positive, unlabelled, prior, mean, scale)
    adam = Adam(net.weights)
    for _ in range(PASSES):
        adam(risk_gradient(_whole_table(x, net), prior, net.weights), PASS_RATE)

    def run(batches):
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(len(batch), len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(net.logits(rows), -700, 700))))], ["_id", "score"])

    return x.select("id", "x").mapInArrow(run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)
