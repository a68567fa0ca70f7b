"""Sources and sinks (A7, A8, A10-A14) and the composite entry points."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from inputs import SF001
from polylabel.operators import features as FE
from polylabel.plans import corpus as K
from polylabel.plans import evaluation as EV
from polylabel.schema import DEFAULT_LABELS as L
from polylabel.sources import fixtures as FX
from polylabel.sources import readers as R
from polylabel.sources import sinks


def test_read_annotations_glob(spark):
    d = tempfile.mkdtemp(prefix="polylabel-ann-")
    header = "text,text_id," + ",".join(L.names) + "\n"
    with open(os.path.join(d, "human_annotations_A1.csv"), "w") as f:
        f.write(header + '"hi, ""there""",0,1,0,0,0,0\n' + "yo,1,0,1,0,0,0\n")
    with open(os.path.join(d, "human_annotations_B_7.csv"), "w") as f:
        f.write(header + "x,1,0,0,1,0,0\n")
    df = R.read_annotations(spark, d)
    got = sorted((r["annotator_id"], r["text_id"], r["text"]) for r in df.collect())
    assert got == [("7", 1, "x"), ("A1", 0, 'hi, "there"'), ("A1", 1, "yo")]
    assert R.read_annotations(spark, d, annotators=["A1"]).count() == 2


def test_sinks_roundtrip(spark):
    out = tempfile.mkdtemp(prefix="polylabel-sink-")
    scored = FX.scored(spark, SF001)
    split = scored.withColumn("split", F.when(F.col("row_id") % 10 == 0, "val").otherwise("train"))
    sinks.write_splits(split, os.path.join(out, "splits"))
    back = spark.read.parquet(os.path.join(out, "splits"))
    assert back.filter("split = 'val'").count() == split.filter("split = 'val'").count()
    sinks.write_detailed_predictions(scored, os.path.join(out, "detailed"), fmt="csv")
    back_csv = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
                .csv(os.path.join(out, "detailed")))
    assert back_csv.count() == scored.count()
    assert sinks.slim_predictions(scored).columns == ["row_id"] + L.pred_cols + L.true_cols
    text = sinks.write_metric_table(scored, os.path.join(out, "metrics"))
    assert "MACRO AVERAGES" in text
    assert spark.read.parquet(os.path.join(out, "metrics")).count() == 5 * 5 + 12


def test_cached_encoding(spark):
    out = tempfile.mkdtemp(prefix="polylabel-enc-")
    lab = FX.labelled(spark, SF001)
    a = FE.cached_encoding(lab, out, max_length=32, vocab_size=200)
    before = set(os.listdir(out))
    b = FE.cached_encoding(lab.orderBy("row_id"), out, max_length=32, vocab_size=200)  # the same rows: from the cache
    assert a.count() == b.count() == lab.count() and set(os.listdir(out)) == before
    c = FE.cached_encoding(lab.filter("row_id % 2 = 0"), out, max_length=32, vocab_size=200)  # other rows: anew
    assert c.count() == lab.filter("row_id % 2 = 0").count()


@pytest.mark.parametrize("order", ["balance_then_split", "split_then_balance"])
def test_build_corpus_orders(spark, order):
    lab = FX.labelled(spark, SF001).withColumn("text", F.col("text"))
    built = K.build_corpus([lab.drop("lang")], L, order=order)
    corpus = built.corpus.cache()
    n_orig = lab.count()
    assert corpus.filter("copy_no = 0").count() == n_orig
    counts = {r["split"]: r["n_rows"] for r in built.split_counts.collect()}
    assert sum(counts.values()) == corpus.count()
    if order == "split_then_balance":
        # no copy of a validation text is in training
        val_ids = corpus.filter("split = 'val'").select("origin_id")
        assert corpus.filter("split = 'train' AND copy_no > 0").join(val_ids, "origin_id").count() == 0
    assert {r["label"] for r in built.after.collect()} == set(L.names)


def test_evaluate_and_compare(spark):
    scored = FX.scored(spark, SF001)
    rep = EV.evaluate(scored, L)
    assert rep["per_label"].count() == 5 and rep["summary"].count() == 1
    assert rep["metric_table"].count() == 37
    cmp = EV.compare_annotators(scored, FX.annotations(spark, SF001), L)
    assert cmp["agreement"].select("annotator_id").distinct().count() == 3
    assert cmp["unmatched"].count() == 0


def test_evaluate_refuses_unlabelled(spark):
    from polylabel.schema import LabelSet
    ls = LabelSet(("a",))
    df = spark.createDataFrame([(1, None, 1), (2, None, 0)], "row_id long, true_a int, pred_a int")
    with pytest.raises(ValueError, match="unlabelled"):
        EV.evaluate(df, ls)


def test_score_with_map_in_pandas(spark):
    from polylabel.operators import model as MD

    def scorer(batches):
        for pdf in batches:  # a stand-in external model: longer texts score higher
            p = (pdf["text"].str.len() / 10.0).clip(0, 1)
            yield pdf[["row_id"]].assign(prob_x=p, pred_x=(p > 0.5).astype("int32"))

    df = spark.createDataFrame([(1, "abc"), (2, "abcdefghij")], "row_id long, text string")
    out = {r["row_id"]: (r["prob_x"], r["pred_x"])
           for r in MD.score_with(df, scorer, "row_id long, prob_x double, pred_x int").collect()}
    assert out == {1: (0.3, 0), 2: (1.0, 1)}


def test_weights_truthiness(spark):
    from polylabel.operators import sampling as S
    from polylabel.schema import LabelSet
    ls = LabelSet(("a", "b"))
    df = spark.createDataFrame([(1, 1, 0), (2, None, 1), (3, 0, 0), (4, 1, 1)], "row_id long, a int, b int")
    w = {r["row_id"]: r["weight"] for r in S.sample_weights(df, ls).collect()}
    # counts a = 2, b = 2; a null value counts as present (Q8); no label weighs 1.0 (Q6)
    assert w == {1: 0.5, 2: 1.0, 3: 1.0, 4: 1.0}


def test_read_labelled_csv_quoting(spark):
    from polylabel.schema import labelled_schema
    d = tempfile.mkdtemp(prefix="polylabel-csv-")
    path = os.path.join(d, "dev.csv")
    with open(path, "w") as f:
        f.write("id,text,anger,fear,joy,sadness,surprise\n")
        f.write('a1,"He said ""no"", then left",1,0,0,0,0\n')
        f.write('a2,"""  I\'m like ""sure.",0,0,1,0,0\n')
        f.write('a3,"two\nlines",,,,,\n')
    df = R.validate_labelled(R.read_labelled_csv(spark, path, schema=labelled_schema()))
    rows = {r["id"]: r for r in df.collect()}
    assert rows["a1"]["text"] == 'He said "no", then left'
    assert rows["a2"]["text"] == '"  I\'m like "sure.'
    assert rows["a3"]["text"] == "two\nlines" and rows["a3"]["anger"] is None
    from polylabel.schema import MissingColumnsError
    with pytest.raises(MissingColumnsError):
        R.validate_labelled(df.drop("joy", "fear"))


def test_multi_split_ingest(spark):
    """A3 + A6 + D22: per-split frames tagged (validation -> val) and counted."""
    mk = lambda n: spark.createDataFrame([(f"t{i}", [2]) for i in range(n)], "text string, labels array<int>")
    frames = {"train": mk(5), "validation": mk(2), "test": mk(3)}
    tagged = R.tag_split({k: R.map_list_corpus(v) for k, v in frames.items()})
    counts = {r["split"]: r["n_rows"] for r in R.split_counts(tagged).collect()}
    assert counts == {"train": 5, "val": 2, "test": 3}


def test_label_info(spark):
    """K2: counts, co-occurrence (symmetric, diagonal = counts) and combinations."""
    info = K.label_info(FX.labelled(spark, SF001), L)
    counts = {r["label"]: r["count"] for r in info["counts"].collect()}
    co = {(r["label_a"], r["label_b"]): r["n"] for r in info["cooccurrence"].collect()}
    assert all(co[(a, a)] == counts[a] for a in L.names)
    assert all(co[(a, b)] == co[(b, a)] for a in L.names for b in L.names)
    assert sum(r["n"] for r in info["combinations"].collect()) == FX.labelled(spark, SF001).count()
