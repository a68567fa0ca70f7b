"""Run selection folds, a small training smoke test, attributions, and
stream = batch (T6)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from inputs import SF001
from polylabel.operators import explain as X
from polylabel.operators import features as FE
from polylabel.operators import metrics as M
from polylabel.operators import model as MD
from polylabel.schema import DEFAULT_LABELS as L
from polylabel.schema import LabelSet
from polylabel.sources import fixtures as FX
from polylabel.streaming import metrics as SM


def test_early_stop_and_top_epochs(spark):
    f1 = [0.80, 0.90, 0.9005, 0.9009, 0.9008, 0.95]
    hist = spark.createDataFrame([("r", i, v) for i, v in enumerate(f1)], "run string, epoch int, val_f1 double")
    r = MD.early_stop(hist).first()
    assert r["stop_epoch"] == 4 and r["best_val_f1"] == pytest.approx(0.90) and r["best_epoch"] == 1
    top = sorted(x["epoch"] for x in MD.top_epochs(hist).collect())
    assert top == [3, 4, 5]  # best three (0.95, 0.9009, 0.9008) and the last (5)


def test_train_score_explain(spark):
    ls = LabelSet(("pos",))
    rows = [(i, ("good great fine " if i % 2 else "bad awful poor ") + "the a", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, text string, pos int")
    model = MD.train(df, ls, max_iter=30, reg_param=0.0, num_features=64)
    scored = MD.score(model, df.select("row_id", "text")).join(
        df.select("row_id", F.col("pos").alias("true_pos")), "row_id")
    acc = M.per_label_metrics(scored, ls).first()["accuracy"]
    assert acc == 1.0
    contrib = X.token_contributions(model, df.select("row_id", "text"))
    top = X.top_tokens(contrib, "attribution", 1).filter("row_id = 1").first()
    assert top["token"] in ("good", "great", "fine") and top["attribution"] > 0
    assert -1.0 <= top["weight"] <= 1.0
    # the margin rebuilt from token contributions equals MLlib's probability
    p_ml = scored.filter("row_id = 1").first()["prob_pos"]
    assert contrib.filter("row_id = 1").first()["prob"] == pytest.approx(p_ml, rel=1e-6)


def test_every_token_and_text_is_explained(spark):
    ls = LabelSet(("pos",))
    rows = [(i, "good the" if i % 2 else "bad the", i % 2) for i in range(20)]
    model = MD.train(spark.createDataFrame(rows, "row_id long, text string, pos int"), ls, num_features=3)
    docs = spark.createDataFrame([(1, "good unseen unseen"), (2, "unseen"), (3, "..."), (4, None), (5, "the")],
                                 "row_id long, text string")
    contrib = X.token_contributions(model, docs, drop_tokens=("the",))
    got = {(r["row_id"], r["token"]): r for r in contrib.collect()}
    assert {k: r["tf"] for k, r in got.items()} == {
        (1, "good"): 1, (1, "unseen"): 2, (2, "unseen"): 1, (3, None): 0, (4, None): 0, (5, None): 0}
    assert all((r["attribution"] == r["occlusion"] == r["weight"] == 0) == (t != "good") for (_, t), r in got.items())
    assert {r["prob"] for (i, _), r in got.items() if i > 1} == {got[2, "unseen"]["prob"]}
    examples = spark.createDataFrame([(7, "pos", "FP", 1, 2), (7, "pos", "FN", 1, 4)],
                                     "annotator_id long, label string, kind string, example_no int, text_id long")
    out = X.example_attributions(examples, contrib).collect()
    assert sorted((r["row_id"], r["token"]) for r in out) == [(2, "unseen"), (4, None)]


def test_encode_shapes(spark):
    lab = FX.labelled(spark, SF001)
    enc = FE.encode(lab, FE.build_vocabulary(lab, vocab_size=300), max_length=16).collect()
    for r in enc:
        assert len(r["input_ids"]) == 16 and len(r["attention_mask"]) == 16
        assert r["input_ids"][0] == FE.BOS_ID
        real = sum(r["attention_mask"])
        assert r["input_ids"][real - 1] == FE.EOS_ID
        assert real == min(r["n_tokens"], 14) + 2
        assert r["truncated"] == (r["n_tokens"] > 14)


def test_stream_equals_batch(spark):
    tmp = tempfile.mkdtemp(prefix="polylabel-stream-")
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    docs.repartition(4, "doc_id").write.parquet(os.path.join(tmp, "docs"))
    stream = SM.read_parquet_stream(spark, os.path.join(tmp, "docs"), docs.schema, files_per_trigger=1)
    got = SM.streaming_per_label_metrics(FX.scored_from_docs(stream, L), L)
    batch = M.per_label_metrics(FX.scored(spark, SF001), L)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_grouped_stream_equals_batch(spark):
    """H1 keyed accumulators: per-group (here per language) counts in state."""
    tmp = tempfile.mkdtemp(prefix="polylabel-stream-g-")
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    docs.repartition(3, "doc_id").write.parquet(os.path.join(tmp, "docs"))
    stream = SM.read_parquet_stream(spark, os.path.join(tmp, "docs"), docs.schema, files_per_trigger=1)
    got = SM.streaming_per_label_metrics(FX.scored_from_docs(stream, L), L, group_cols=("lang",))
    batch = M.per_label_metrics(FX.scored(spark, SF001), L, group_cols=("lang",))
    cols = ["lang", "label", "tp", "fp", "fn", "tn"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_train_and_select_and_explain_corpus(spark):
    """K5 + K6 on a small separable corpus."""
    from polylabel.plans import evaluation as EV
    ls = LabelSet(("pos",))
    rows = [(i, ("good great fine " if i % 2 else "bad awful poor ") + "the a", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, text string, pos int")
    model, hist, top, stop = EV.train_and_select(df, df, ls, epochs=(1, 2, 3, 4))
    assert hist.count() == 4 and stop.count() == 1
    assert 1 <= top.count() <= 4
    out = EV.explain_corpus(model, df.select("row_id", "text"), k=2)
    assert out["top_attribution"].filter("row_id = 1").count() == 2
    assert out["scores"].count() == 40


def test_stream_of_one_file_and_of_none(spark):
    schema = spark.read.parquet(f"{SF001}/documents.parquet").schema
    stream = SM.read_parquet_stream(spark, f"{SF001}/documents.parquet", schema)
    got = SM.streaming_per_label_metrics(FX.scored_from_docs(stream, L), L)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, M.per_label_metrics(FX.scored(spark, SF001), L).collect()))
    empty = tempfile.mkdtemp(prefix="polylabel-none-")
    with pytest.raises(FileNotFoundError):
        SM.read_parquet_stream(spark, empty, schema)


def test_restarted_sink_writes_each_row_once(spark):
    tmp = tempfile.mkdtemp(prefix="polylabel-restart-")
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    docs.filter("doc_id % 2 = 0").write.parquet(f"{tmp}/in")
    run = lambda: SM.write_stream(SM.read_parquet_stream(spark, f"{tmp}/in", docs.schema), f"{tmp}/out", available_now=True).awaitTermination()
    run()
    assert spark.read.parquet(f"{tmp}/out").count() == docs.filter("doc_id % 2 = 0").count()
    docs.filter("doc_id % 2 = 1").write.mode("append").parquet(f"{tmp}/in")
    run()
    run()
    ids = [r.doc_id for r in spark.read.parquet(f"{tmp}/out").select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_shared_model_trains_with_the_library_default(spark, monkeypatch):
    from polylabel.plans import catalog as K
    seen = []
    monkeypatch.setattr(K.MD, "train", lambda *a, **kw: seen.append(kw))
    monkeypatch.setattr(K, "_MODELS", {})
    K._split_and_model(spark, SF001)
    assert seen and all("max_iter" not in kw for kw in seen)


def test_vocabulary_and_fits_go_by_size(spark, monkeypatch):
    """Words of equal count are told apart by their order, whatever the
    layout; features come in few partitions, large ones are fitted one by one."""
    df = spark.createDataFrame([(i, f"w{i:03d} w{i % 7}", i % 2) for i in range(60)], "row_id long, text string, pos int")
    want = sorted((f"w{i}" for i in range(7)), key=lambda w: (-len(range(int(w[1]), 60, 7)), w)) + [f"w{i:03d}" for i in range(13)]
    for layout in (df, df.repartition(40), df.orderBy(F.desc("row_id"))):
        assert MD.fit_features(layout, num_features=20).stages[1].vocabulary == want
    fm = MD.fit_features(df)
    wide = df.repartition(60)
    cached, feats, at_once = MD.cached_features(fm, wide, ["pos"])
    assert feats.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and feats.count() == 60 and at_once > 1
    cached.unpersist()
    pools = []
    monkeypatch.setattr(MD, "FIT_BYTES", 1)
    real = MD.ThreadPoolExecutor
    monkeypatch.setattr(MD, "ThreadPoolExecutor", lambda max_workers: pools.append(max_workers) or real(max_workers))
    MD.train(df, LabelSet(("pos",)), max_iter=1)
    MD.epoch_history(df, df, LabelSet(("pos",)), epochs=(1, 2)).collect()
    assert pools and set(pools) == {1}


def test_contributions_shuffle_texts_only(spark):
    """Tokens are neither shuffled nor sorted; the largest ones are those that
    ``top_tokens`` finds among all, also where ids repeat or are null."""
    ls = LabelSet(("pos", "odd"))
    rows = [(i, " ".join(f"w{i * k % 23}" for k in range(1, 2 + i % 11)), i % 2, i % 3 % 2) for i in range(60)]
    model = MD.train(spark.createDataFrame(rows, "row_id long, text string, pos int, odd int"), ls, num_features=18)
    docs = spark.createDataFrame([r[:2] for r in rows] + [r[:2] for r in rows[:9]] + [(None, "w1 w2"), (None, "w2 zz"), (99, None), (98, "..")], "row_id long, text string")
    full = X.token_contributions(model, docs)
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Sort [token" not in plan
    assert {r.token: r.tf for r in full.filter("row_id is null and label_index = 0").collect()} == {"w1": 1, "w2": 2, "zz": 1}
    for by in ("attribution", "occlusion"):
        few = X.token_contributions(model, docs, largest=(by, 3))
        want, got = (X.top_tokens(c, by, 3).select("row_id", "label", "rank", "token", "tf", "weight").collect() for c in (full, few))
        assert sorted(map(str, got)) == sorted(map(str, want)) and few.count() == len(got) < full.count()


def test_epochs_of_one_run_are_those_of_their_own_fits(spark, monkeypatch):
    """``epoch_history`` fits no model per epoch; its models are MLlib's, and
    its metrics those of their scores, also where ids repeat or are null."""
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from polylabel.operators import metrics as M
    from polylabel.operators import model as MD
    from polylabel.schema import LabelSet

    rng, ls = random.Random(1), LabelSet(("a", "b", "c"))
    rows = []
    for i in range(150):
        words = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randint(0, 25))]
        rows.append((i % 140 if i else None, " ".join(words), int(rng.random() < 0.3 or "w1" in words), int("w2" in words), 1))
    df = spark.createDataFrame(rows, "row_id long, text string, a int, b int, c int").repartition(3)
    fm, epochs = MD.fit_features(df), (1, 4, 7)
    idf = fm.stages[2].idf.toArray()
    weights, shifts = MD.training_path(MD._blocks(MD._counts(fm, df, ls.names), 3, len(idf)), idf, 3, max(epochs), 0.01)
    truth, want = df.select("row_id", *(F.col(n).alias(ls.true(n)) for n in ls.names)), []
    for e in epochs:
        fit = MD.train(df, ls, max_iter=e, features_model=fm)
        for k, n in enumerate(ls.names):
            assert np.allclose(weights[e, k], fit.per_label[n].coefficients.toArray() * idf, rtol=0, atol=1e-9)
            assert shifts[e, k] == fit.per_label[n].intercept or abs(shifts[e, k] - fit.per_label[n].intercept) < 1e-9
        scored = MD.score(fit, df.select("row_id", "text")).join(truth, "row_id")
        s = M.summary_from_sums(M.metric_sums(scored, ls), ls).first()
        want.append((s["macro_f1"], s["macro_precision"], s["macro_recall"], s["macro_accuracy"]))
    monkeypatch.setattr(MD, "train", None)
    got = MD.epoch_history(df, df, ls, epochs=epochs).orderBy("epoch").collect()
    assert [tuple(r)[2:] for r in got] == want and [r.epoch for r in got] == [0, 1, 2]
    assert MD.epoch_history(df, df, ls, epochs=epochs, features_model=fm).orderBy("epoch").collect() == got
    import pytest
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        MD.epoch_history(df.withColumn("a", F.lit(2)), df, ls, epochs=(1,))
