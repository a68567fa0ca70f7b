import math
import random

import numpy as np
import pytest

from polylabel.llm import maxscore, queries


def brute(rows, ask, k):
    use = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.setdefault((i, tuple(math.floor(256 * x) for x in v)))
    out = set()
    for i, q in use:
        if ask(i):
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in use if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def check(spark, rows, k=5, ask=lambda i: i % 5 == 0):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, label int, w string")
    got = {tuple(r) for r in maxscore.top_k(df.filter("vec_id % 5 = 0"), df, k).collect()}
    assert got == brute(rows, ask, k)


def test_random_sparse_signed_and_ties(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1), 0.5]) for _ in range(12)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)] + [rows[7], rows[10]]  # ties, repeated rows
    rows += [(400, None), (405, [None] * 12), (410, [float("nan")] * 12), (415, [float("inf")] * 12), (None, [1.0] * 12), (420, []), (425, [0.0] * 12),
             (430, [-1.0] * 12), (431, [0.25])]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(5, [1.0, 2.0])], [(0, [1.0]), (1, [-3.0]), (2, [-4.0])]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_large_components_stay_exact(spark):
    check(spark, [(i, [1e6 + i, 3e6 - i / 256, -2e6]) for i in range(12)])


def test_small_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 2)
    monkeypatch.setattr(maxscore, "BLOCK_QUERIES", 3)
    rng = random.Random(4)
    check(spark, [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(120)], k=7)


def test_pruning_drops_nothing():
    rng = np.random.default_rng(5)
    c = np.floor(rng.normal(0, 60, (20_000, 32)) * (rng.random((20_000, 32)) < 0.3)).astype(np.float64)
    ids = np.arange(20_000)
    for q in c[::2000]:
        at, s = maxscore.shard_top_k(ids, c, -1, q, 10, False)
        full = c @ q
        want = np.lexsort((ids, -full))[:10]
        assert at.tolist() == want.tolist() and s.tolist() == full[want].tolist()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {tuple(r) for r in queries.op5_maxscore(spark, sf).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows, lambda i: i % 50 == 0, 5)
