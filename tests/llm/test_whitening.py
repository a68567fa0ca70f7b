import math
from collections import Counter

import numpy as np
import pytest

from polylabel.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, x array<bigint>, w int, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, [1], 5, "n") for i, v in rows], SCHEMA)


def brute(rows, components=32, distinct=False):
    """Plain covariance of the listed vectors, by the contract's formulas."""
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in ok), default=0)
    xs = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] + [1000000] * (width - len(v)) for _, v in ok]
    fit = list(map(list, {tuple(x) for x in xs})) if distinct else xs
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    rows_c = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in xs])
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return [i for i, _ in ok], n, deviation, rows_c @ axes / np.sqrt(np.maximum(values, 1e-300)), values / (values.sum() if components >= width else np.trace(centred.T @ centred / n))


def vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) * 3
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]


def same(got, rows, **kw):
    ids, n, deviation, white, explained = brute(rows, **kw)
    assert Counter((r.vec_id, int(r.deviation)) for r in got) == Counter(zip(ids, deviation))
    by_id = {r.vec_id: r for r in got}
    z = np.array([by_id[i].whitened for i in ids])
    signs = np.sign((z * white).sum(0))
    assert np.abs(z * signs - white).max() < 1e-6
    assert all(r.n == n and np.allclose(r.explained, explained, rtol=1e-9) and r.identity_error < 1e-9 for r in got)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_brute_force(spark, weights):
    rows = vectors(300, 6, 1)
    rows += [(1000 + i, rows[0][1]) for i in range(400)]  # one vector holds most rows: the broadcast path
    rows += [(None, rows[1][1]), (5000, None), (5001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5002, [math.nan] * 6), (5003, [math.inf] + [0.0] * 5)]
    got = whitening.whiten(table(spark, rows), weights=weights).collect()
    assert len(got) == 701
    same(got, rows, distinct=weights == "one")


def test_cold_join_and_fewer_components(spark):
    rows = vectors(2500, 5, 2)
    got = whitening.whiten(table(spark, rows), components=3).collect()
    assert all(len(r.whitened) == len(r.explained) == 3 for r in got)
    same(got, rows, components=3)


def test_short_vectors_are_filled_up(spark):
    rows = vectors(60, 3, 3) + [(100 + i, [float(i), 1.0]) for i in range(9)] + [(200, [])]
    same(whitening.whiten(table(spark, rows)).collect(), rows)


def test_without_variance(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    one, = whitening.whiten(table(spark, [(1, [0.5, -0.25])])).collect()
    assert (one.n, int(one.deviation), one.whitened, one.identity_error) == (1, 0, [None, None], None)
    flat = whitening.whiten(table(spark, [(i, [float(i), 2.0]) for i in range(4)])).collect()
    assert all(r.whitened[1] is None and r.whitened[0] is not None and r.explained == [1.0, 0.0] and r.identity_error < 1e-9 for r in flat)


def test_exact_beyond_doubles():
    """Deviations stay exact where products leave 64 bits."""
    m = np.array([[1000000 + (1 << 40), 1000000], [1000000 - (1 << 40), 1000003]])
    sums = [int(s) for s in (m - 1000000).sum(0)]
    c = whitening.Centre([s * 10 ** 9 + 7 for s in sums], 2 * 10 ** 9, 1000000)
    want = [sum((2 * 10 ** 9 * (int(a) - 1000000) - (s * 10 ** 9 + 7)) ** 2 for a, s in zip(row, sums)) for row in m]
    assert c.deviations(m) == [v if v < 10 ** 38 else None for v in want]
    small = np.array([[1000000 + (1 << 20), 1000001]])
    c = whitening.Centre([5, 7], 10 ** 9, 1000000)
    assert c.deviations(small) == [sum((10 ** 9 * (int(a) - 1000000) - s) ** 2 for a, s in zip(small[0], (5, 7)))]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op13_embedding_whitening"](spark, sf)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, n, deviation, white, explained = brute(rows)
    got = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(got) == len(rows) * 32
    z = np.array([[got[i, k].whitened for k in range(1, 33)] for i in ids])
    assert np.abs(z * np.sign((z * white).sum(0)) - white).max() < 1e-6
    assert all(got[i, 1].deviation == d and got[i, 1].n == n for i, d in zip(ids, deviation))
    assert np.allclose([got[ids[0], k].explained for k in range(1, 33)], explained)
