"""Embedding whitening by a weighted covariance over distinct vectors.

Equal vectors are grouped first, so everything but the last join works on each
distinct vector once, with its number of copies as its weight:

1. every entry ``c`` becomes the integer ``floor(scale * c) + offset``, and
   equal integer vectors are counted (combined before the shuffle);
2. exact sums per dimension give the mean; each task centres its vectors and
   adds up one weighted ``d x d`` product; the products are added on the
   executors down to at most ``FAN_IN``, which the driver adds;
3. the ``d x d`` covariance is decomposed on the driver (its size depends on
   the vectors' length only);
4. each distinct vector is whitened once, the whitened vectors' covariance is
   measured in the same way, and the rows are joined back.

A vector that very many rows share would load one task of that last join, so
vectors with more than one ``1 / HOT`` of all rows (fewer than ``HOT`` of them,
whatever the data) are broadcast, and only the others are joined by a shuffle.

Rows whose vector is null, or holds a null, NaN or infinite entry, take no part.
Shorter vectors are taken as if filled up with zeros. Repeated rows are rows like
others, each with its own result. A null id stays a null id. Entries beyond
2**62 / scale saturate there. Columns other than the id and the vector are not
read. Directions without variance (one vector only, fewer vectors than
dimensions) have a null ``whitened`` entry and take no part in
``identity_error``; without any direction left it is null. An empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polylabel.llm import common as C

FAN_IN = 64  # matrices that the driver adds up at most
HOT = 1000
LIMIT = 1 << 62
BATCH = 4096  # vectors worked on at once


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(id, x): the usable rows' vectors in integers."""
    v = F.col(vector_col)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    x = F.transform(v, lambda c: F.least(F.greatest(F.floor(F.lit(float(scale)) * c.cast("double")), F.lit(-LIMIT)), F.lit(LIMIT)) + F.lit(offset))
    return vectors.filter(v.isNotNull() & ~F.exists(v, bad)).select(F.col(id_col).alias("id"), x.alias("x"))


def _matrices(batches, column: str, width: int, fill: int):
    """Arrow batches as (slice, integer matrix, weights), at most ``BATCH``
    rows at once; short rows are filled up."""
    for batch in batches:
        for at in range(0, len(batch), BATCH):
            part = batch.slice(at, BATCH)
            x = part.column(part.schema.get_field_index(column))
            counts = x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = x.flatten().to_numpy(zero_copy_only=False)
            if (counts == width).all():
                m = flat.reshape(len(part), width)
            else:
                m = np.full((len(part), width), fill, flat.dtype)
                m[np.repeat(np.arange(len(part)), counts), C.ranges(np.zeros(len(part)), counts)] = flat
            w = part.column(part.schema.get_field_index("w")).to_numpy(zero_copy_only=False) if "w" in part.schema.names else None
            yield part, m, w


def _exact(terms: int, *bounds) -> type:
    """int64 where a sum of ``terms`` products below ``bounds`` fits, else
    Python integers."""
    top = terms
    for b in bounds:
        top *= int(b)
    return np.int64 if top < LIMIT else object


def _sums(width: int, offset: int):
    def run(batches):
        total = [0] * width
        for _, m, w in _matrices(batches, "x", width, offset):
            y = m - offset
            kind = _exact(1, np.abs(y).max(initial=0) + 1, int(w.sum()) + 1)
            total = [a + int(b) for a, b in zip(total, (y.astype(kind) * w.astype(kind)[:, None]).sum(0))]
        if width:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total, pa.decimal128(38, 0))], ["dim", "s"])
    return run


class Centre:
    """The exact mean: ``offset + at + rest / n`` per dimension, in integers."""

    def __init__(self, sums: list[int], n: int, offset: int):
        self.n, self.offset = n, offset
        self.at = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, m: np.ndarray) -> np.ndarray:
        return (m - self.offset - self.at).astype(np.float64) - self.rest / self.n

    def deviations(self, m: np.ndarray) -> list:
        """Sum over the dimensions of (n * x - S) ** 2, as exact integers;
        null beyond 38 digits."""
        y = m - self.offset - self.at
        top = np.abs(y).max(initial=0) + 1
        a = y.astype(_exact(len(self.at), top, top))
        b = y.astype(_exact(len(self.at), top, self.rest.max(initial=0) + 1))
        rest = [int(r) for r in self.rest]
        c = sum(r * r for r in rest)
        squares, cross = (a * a).sum(1), (b * (self.rest if b.dtype != object else np.array(rest, object))).sum(1)
        out = [self.n * self.n * int(s) - 2 * self.n * int(t) + c for s, t in zip(squares, cross)]
        return [v if v < 10 ** 38 else None for v in out]


def _product(matrix):
    """One weighted product per task: sum of w * v v' over its vectors, ``v``
    being what ``matrix`` makes of a batch."""
    def run(batches):
        total = None
        for v, w in matrix(batches):
            p = (v * w[:, None]).T @ v
            total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % FAN_IN], pa.int32()),
                                              pa.array([total.tobytes()], pa.binary())], ["g", "m"])
    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(m.as_py()) for m in table.column("m"))
    return pa.table({"g": table.column("g")[:1], "m": pa.array([total.tobytes()], pa.binary())})


def weighted_product(df: DataFrame, matrix, width: int) -> np.ndarray:
    parts = df.mapInArrow(_product(matrix), "g int, m binary").groupBy("g").applyInArrow(_add, "g int, m binary")
    return sum((np.frombuffer(r.m) for r in parts.collect()), np.zeros(width * width)).reshape(width, width)


def directions(v: np.ndarray, components: int):
    """(values, vectors as columns) of the largest eigenvalues, falling; every
    vector's entry of largest size is positive."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    top = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(top < 0, -1.0, 1.0)


def _whiten(width: int, centre: Centre, turn: np.ndarray, dead: np.ndarray):
    def run(batches):
        for part, m, w in _matrices(batches, "x", width, centre.offset):
            z = centre.centred(m) @ turn
            flat = pa.array(z.reshape(-1), mask=np.tile(dead, len(z)))
            offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(w), pa.array(centre.deviations(m), pa.decimal128(38, 0)), pa.ListArray.from_arrays(offsets, flat)],
                ["x", "w", "deviation", "whitened"])
    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32,
           scale: int = 64, offset: int = 1_000_000, weights: str = "counts", scratch: C.Scratch | None = None) -> DataFrame:
    """One row per usable row of ``vectors``: (id, n, deviation, whitened,
    explained, identity_error). ``n`` is the number of vectors fitted on,
    ``deviation`` the exact sum over dimensions of (n * x - S) ** 2 as a
    decimal, ``whitened`` and ``explained`` list the first ``components``
    directions (all, if there are fewer dimensions), ``identity_error`` is the
    largest absolute entry of the whitened covariance minus the identity.
    ``weights`` is "counts" (fit on all rows) or "one" (on distinct vectors)."""
    if weights not in ("counts", "one"):
        raise ValueError(f"weights: {weights}")
    spark = vectors.sparkSession
    scratch = scratch or C.Scratch(spark, "whitening")
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    rows = scratch.stage(quantised(vectors, id_col, vector_col, scale, offset), "rows")
    weight = F.count(F.lit(1)) if weights == "counts" else F.lit(1).cast("long")
    distinct = scratch.stage(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"), weight.alias("w")), "distinct")
    size = distinct.agg(F.sum("w").alias("n"), F.sum("copies").alias("rows"), F.max(F.size("x")).alias("width"), F.max("copies").alias("top")).first()
    n, width = size["n"], size["width"]
    if not n:
        return spark.createDataFrame([], schema)
    fit = distinct.select("x", "w")
    sums = {r.dim: int(r.s) for r in fit.mapInArrow(_sums(width, offset), "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()}
    centre = Centre([sums[i] for i in range(width)], n, offset)

    def centred(batches):
        for _, m, w in _matrices(batches, "x", width, offset):
            yield centre.centred(m), w

    covariance = weighted_product(fit, centred, width) / n
    values, axes = directions(covariance, components)
    trace = float(np.trace(covariance))
    live = values > max(trace, 0.0) * width * np.finfo(float).eps * 4
    turn = axes / np.sqrt(np.where(live, values, 1.0))
    done = scratch.stage(fit.mapInArrow(_whiten(width, centre, turn, ~live), "x array<bigint>, w bigint, deviation decimal(38,0), whitened array<double>"), "done")

    def alive(batches):
        for _, z, w in _matrices(batches, "whitened", len(values), 0):
            yield z[:, live], w

    kept = int(live.sum())
    error = float(np.abs(weighted_product(done, alive, kept) / n - np.eye(kept)).max()) if kept else None
    explained = [float(e) / trace if ok else 0.0 for e, ok in zip(values, live)] if trace > 0 else [None] * len(values)

    hot_count = max(size["rows"] // HOT, 1)
    right = done.select("x", "deviation", "whitened")
    if size["top"] > hot_count:
        # fewer than HOT vectors can have more than a HOT-th of the rows each
        hot = distinct.filter(F.col("copies") > hot_count).select("x")
        often = rows.join(F.broadcast(right.join(F.broadcast(hot), "x", "left_semi")), "x")
        joined = often.unionByName(rows.join(F.broadcast(hot), "x", "left_anti").join(right, "x"))
    else:
        joined = rows.join(right, "x")
    return joined.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                         F.lit(explained).cast("array<double>").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
