"""Exact top-k by integer inner product, with MaxScore pruning per shard.

The dimensions are the terms. Candidates are dealt into shards and queries
into blocks, both of bounded size; a task gets one shard and one block. For a
query the bound of a term is the most it can add on this shard (0 if the term
is absent). Terms are ordered by bound; those whose bounds together stay below
the query's current k-th score are non-essential: a candidate that has none
of the other, essential terms cannot enter. Essential postings are traversed
and summed; then the non-essential terms are probed from the largest bound
down, only for candidates whose score plus the bounds still open reaches the
threshold. The k best of every shard are merged per query. Nothing is
approximate: equal scores go to the smaller id, and ties stay competitive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 32_768
BLOCK_QUERIES = 4_096
STRIDE = 4_096  # candidates between updates of the threshold
PROBE = 8       # terms probed at a time


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, w): distinct usable rows, ``w`` the components as
    ``floor(scale * x)``. Rows with a null id, a null vector, or a null or
    non-finite component take no part."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & usable)
            .select(F.col(id_col).alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("w")).distinct())


def _matrix(col, width: int) -> np.ndarray:
    lens = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lens), width), np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def _typed(c: np.ndarray, q: np.ndarray):
    """Sums in float64 where they are exact there, else in Python integers."""
    most = lambda a: max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))
    if most(c) * most(q) * max(1, c.shape[1]) < 1 << 53:
        return c.astype(np.float64), q.astype(np.float64)
    return c.astype(object), q.astype(object)


def shard_top_k(ids: np.ndarray, c: np.ndarray, q_id, q: np.ndarray, k: int, own: bool):
    """Positions and scores of the k best candidates of one query (``ids``
    ascending); ``own`` leaves out the candidates with the query's id."""
    hi, lo = c.max(axis=0), c.min(axis=0)
    terms = np.flatnonzero(q != 0)
    bound = np.maximum(np.maximum(q[terms] * hi[terms], q[terms] * lo[terms]), 0)
    order = np.argsort(bound, kind="stable")  # ascending: non-essential first
    terms, bound = terms[order], bound[order]
    upto = np.concatenate([np.zeros(1, bound.dtype), np.cumsum(bound)])
    best_at, best, least = np.zeros(0, np.int64), np.zeros(0, c.dtype), None
    for at in range(0, len(ids), STRIDE):
        part = c[at:at + STRIDE]
        rows = np.arange(len(part))
        if own:
            rows = rows[ids[at:at + STRIDE] != q_id]
        n_non = 0 if least is None else int(np.searchsorted(upto[1:], least, "left"))
        essential = terms[n_non:]
        if least is not None and upto[n_non] < least:
            rows = rows[(part[rows][:, essential] != 0).any(axis=1)] if len(essential) else rows[:0]
        score = part[rows][:, essential] @ q[essential]
        while n_non and len(rows):
            if least is not None:
                alive = score + upto[n_non] >= least
                rows, score = rows[alive], score[alive]
            group = terms[max(0, n_non - PROBE):n_non]
            score = score + part[rows][:, group] @ q[group]
            n_non -= len(group)
        best_at, best = np.concatenate([best_at, at + rows]), np.concatenate([best, score])
        if len(best) > k:
            keep = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[keep], best[keep]
        if len(best) == k:
            least = best.min()
    keep = np.lexsort((best_at, -best))
    return best_at[keep], best[keep]


def top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 256, exclude_own: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): for every usable row of ``queries``
    its k highest inner products with the usable rows of ``vectors`` (all, if
    there are fewer), equal scores by smaller id. Vectors of unequal length
    are padded with zeros. Rows equal in id and vector count once; one id with
    two query vectors is ranked for each. Empty tables give no rows. Scores
    must fit a long."""
    q = quantised(queries, id_col, vector_col, scale)
    c = quantised(vectors, id_col, vector_col, scale)
    n = vectors.count()
    n_queries = queries.count()
    shards = max(-(-n // SHARD_ROWS), 4 * vectors.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    deal = lambda parts: F.pmod(F.xxhash64("id", "w"), F.lit(parts)).cast("int")
    left = c.select(deal(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "w")
    right = q.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), deal(blocks).alias("block"), "id", "w")
    kind = vectors.schema[id_col].dataType.simpleString()

    def search(cand: pa.Table, ask: pa.Table) -> pa.Table:
        cand = cand.sort_by("id")
        cols = [x.column("w").combine_chunks() for x in (cand, ask)]
        cols = [x if isinstance(x, pa.ListArray) else pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], pa.list_(pa.int64())) for x in cols]
        width = max([1, *(int(np.diff(x.offsets.to_numpy()).max(initial=0)) for x in cols)])
        m, qs = _typed(*(_matrix(x, width) for x in cols))
        ids, q_ids = cand.column("id").to_numpy(), ask.column("id").to_numpy()
        out = [shard_top_k(ids, m, q_ids[i], qs[i], k, exclude_own) if len(ids) else (np.zeros(0, np.int64), np.zeros(0)) for i in range(len(q_ids))]
        sizes = [len(x) for x, _ in out]
        at = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(out)), sizes)
        scores = pa.array([int(s) for _, x in out for s in x], pa.int64())
        return pa.table({"query_id": ask.column("id").take(pa.array(row)), "query_key": ask.column("key").take(pa.array(row)),
                         "vec_id": cand.column("id").take(pa.array(at)), "score": scores})

    part = (left.groupBy("shard", "block").cogroup(right.withColumn("key", F.xxhash64("w")).groupBy("shard", "block"))
            .applyInArrow(search, f"query_id {kind}, query_key bigint, vec_id {kind}, score bigint"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
