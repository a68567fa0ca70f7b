"""Training by epochs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polylabel.operators import metrics as M
from polylabel.operators import model as MD
from polylabel.operators import trainer as TR
from polylabel.schema import LabelSet

LS = LabelSet(("pos", "odd"))


def corpus(spark, n=400, seed=1):
    """Two noisy labels, so that the best loss is finite."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice("good great bad awful the a of it so very".split()) for _ in range(r.randint(1, 9))]
        mood = sum(w in ("good", "great") for w in words) - sum(w in ("bad", "awful") for w in words)
        rows.append((i, " ".join(words), int(mood + r.gauss(0, 1.5) > 0), int("so" in words) ^ int(r.random() < 0.2)))
    return spark.createDataFrame(rows, "row_id long, text string, pos int, odd int")


def loss(scored):
    z = scored.withColumns({LS.true(n): F.col(n) for n in LS.names})
    return M.bce_loss(z, LS).first()["bce_loss"]


def test_gradient_by_differences():
    """One step with no history of steps moves each weight against its slope."""
    rng = np.random.default_rng(2)
    row, ids, x = np.array([0, 0, 1, 2, 2]), np.array([0, 2, 1, 0, 1]), rng.normal(size=5)
    y, weight = rng.integers(0, 2, (3, 2)).astype(float), np.array([1.0, 2.0, 0.5])
    w = rng.normal(size=(4, 2))
    total = lambda v: float((TR._loss(TR._margins(v, 3, row, ids, x), y) * weight[:, None]).sum()) / 3
    moved, g = w.copy(), np.zeros((4, 2))
    assert TR._batch_step(moved, g, row, ids, x, y, weight, 0.1, 0.0) == pytest.approx(total(w) * 3)
    for at in np.ndindex(w.shape):
        up, down = w.copy(), w.copy()
        up[at] += 1e-6
        down[at] -= 1e-6
        slope = (total(up) - total(down)) / 2e-6
        assert np.sqrt(g[at]) == pytest.approx(abs(slope), abs=1e-6)
        assert moved[at] == pytest.approx(w[at] - 0.1 * np.sign(slope), abs=1e-4) or abs(slope) < 1e-6


def test_loss_comes_near_the_optimum(spark, tmp_path):
    df = corpus(spark).cache()
    run = TR.fit_epochs(df, df, f"{tmp_path}/r", LS, epochs=12, n_shards=2, weight_decay=0.0, patience=99)
    best = loss(MD.score(MD.train(df, LS, reg_param=0.0, max_iter=100, num_features=64), df, keep=()))
    rows = run.history.orderBy("epoch").collect()
    assert len(rows) == 12 and rows[0].val_loss > rows[-1].val_loss
    assert best <= rows[-1].val_loss + 1e-9 <= best * 1.03
    assert loss(run.models[-1](df)) == pytest.approx(rows[-1].val_loss, abs=1e-6)
    again = TR.fit_epochs(df.repartition(5), df, f"{tmp_path}/again", LS, epochs=2, n_shards=2, weight_decay=0.0, patience=99)
    assert np.allclose(again.models[1].weights, run.models[1].weights, atol=1e-9)  # whatever the layout


def test_stops_where_early_stop_says(spark, tmp_path):
    df = corpus(spark, 200, 3)
    run = TR.fit_epochs(df, df, f"{tmp_path}/r", LS, epochs=9, n_shards=2, patience=2, min_delta=0.02)
    fold = MD.early_stop(run.history, patience=2, min_delta=0.02).first()
    assert run.stopped_early == fold.stopped_early and fold.n_epochs == len(run.models)
    if run.stopped_early:
        assert fold.stop_epoch == len(run.models) - 1


def test_weights_decay_and_tables(spark, tmp_path):
    df = corpus(spark, 120, 4)
    plain, small = (TR.fit_epochs(df, df, f"{tmp_path}/{d}", LS, epochs=2, n_shards=1, weight_decay=d, patience=9).models[-1] for d in (0.0, 0.5))
    assert np.abs(small.weights[:-1]).sum() < np.abs(plain.weights[:-1]).sum()
    table = plain.table(spark)
    assert table.columns == ["token", "pos", "odd"] and table.count() == len(plain.vocabulary.tokens) + 1
    weighted = df.withColumn("w", F.when(F.col("pos") == 1, 3.0).otherwise(1.0))
    heavy = TR.fit_epochs(weighted, df, f"{tmp_path}/w", LS, epochs=2, n_shards=1, weight_decay=0.0, weight_col="w", patience=9).models[-1]
    assert heavy.weights[-1, 0] > plain.weights[-1, 0]


def test_tokens_are_looked_up_once(spark):
    """Coded columns give what the vocabulary finds in the words, and logits
    from them are those of the texts."""
    df = corpus(spark, 50, 7).unionByName(spark.createDataFrame([(50, None, 0, 0), (51, "unseen", 1, 0), (52, "", 0, 1)], "row_id long, text string, pos int, odd int"))
    v = TR.learn_vocabulary(corpus(spark, 50, 7), 6)
    coded = v.coded(df.select("row_id", TR.tokens(F.coalesce("text", F.lit(""))).alias("words"), "pos"), "words")
    assert coded.columns == ["row_id", "pos", "_ids", "_tf"]
    texts = {r.row_id: r.text or "" for r in df.collect()}
    for r in coded.collect():
        words = texts[r.row_id].split()
        assert dict(zip(r._ids, r._tf)) == {v.tokens.index(w): words.count(w) for w in words if w in v.tokens} and r._ids == sorted(r._ids)
    model = TR.EpochModel(v, np.random.default_rng(1).normal(size=(7, 2)), LS)
    key = lambda d: sorted(map(tuple, d.select("row_id", "logit_pos", "logit_odd").collect()))
    assert key(model.coded_logits(coded)) == key(model.logits(df))
