"""Annotator agreement against the FIXTURES 3.4 goldens and error analysis."""

import pytest
from pyspark.sql import functions as F

from inputs import SF01
from polylabel.operators import agreement as AG
from polylabel.operators import discrepancy as D
from polylabel.schema import DEFAULT_LABELS as L
from polylabel.sources import fixtures as FX
from polylabel.sources import readers as R


@pytest.fixture(scope="module")
def joined(spark):
    return AG.join_annotations(FX.scored(spark, SF01), FX.annotations(spark, SF01), L).cache()


def test_annotator_goldens(joined):
    rows = AG.agreement(joined, L).collect()
    by = {}
    for r in rows:
        a = by.setdefault(r["annotator_id"], {"n": r["n"], "ham": r["hamming_loss"],
                                              "exact": r["exact_match_ratio"], "err": 0})
        a["err"] += r["fp"] + r["fn"]
    assert by["A1"]["n"] == 1000 and by["A1"]["err"] == 453 and round(by["A1"]["exact"] * 1000) == 593
    assert by["A2"]["n"] == 500 and by["A2"]["err"] == 228 and round(by["A2"]["exact"] * 500) == 298
    assert by["A3"]["n"] == 334 and by["A3"]["err"] == 152 and round(by["A3"]["exact"] * 334) == 196
    assert by["A1"]["ham"] == pytest.approx(0.0906) and by["A3"]["ham"] == pytest.approx(0.091018)


def test_examples_first_three_and_totals(joined):
    ex = AG.disagreement_examples(joined, L, k=3).collect()
    groups = {}
    for r in ex:
        groups.setdefault((r["annotator_id"], r["label"], r["kind"]), []).append(r)
    for key, rs in groups.items():
        assert len(rs) <= 3 and sorted(r["example_no"] for r in rs) == list(range(1, len(rs) + 1))
        assert all(r["n_total"] >= len(rs) for r in rs)
    # all five labels are reported (not only the last one)
    assert {k[1] for k in groups} == set(L.names)


def test_fp_fn_totals_equal_missing_extra(spark, joined):
    me = {r["label"]: r for r in D.missing_extra(joined, L).collect()}
    ag = AG.agreement(joined, L).groupBy("label").agg(F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).collect()
    for r in ag:
        assert me[r["label"]]["n_extra"] == r["fp"] and me[r["label"]]["n_missing"] == r["fn"]


def test_worklist_and_unmatched(spark):
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "row_id long, text string")
    ann = spark.createDataFrame([("A", 0), ("A", 1), ("B", 4), ("B", 9)], "annotator_id string, text_id long")
    wl = R.annotation_worklist(texts, ann, ["A", "B"]).collect()
    assert sorted((r["annotator_id"], r["text_id"]) for r in wl) == \
        [("A", 2), ("A", 3), ("A", 4), ("B", 0), ("B", 1), ("B", 2), ("B", 3)]
    un = {r["annotator_id"]: r["n_unmatched"] for r in AG.unmatched_annotations(texts, ann).collect()}
    assert un == {"B": 1}


def test_latest_annotations(spark):
    df = spark.createDataFrame([("A", 1, 0, 1), ("A", 1, 1, 2), ("A", 2, 1, 1)],
                               "annotator_id string, text_id long, anger int, ingest_seq int")
    got = sorted((r["text_id"], r["anger"]) for r in R.latest_annotations(df).collect())
    assert got == [(1, 1), (2, 1)]


def test_threshold_advice_rules(spark):
    from polylabel.schema import LabelSet
    ls = LabelSet(("x",))
    rows = [(1, 0, "good text here")] * 8 + [(0, 1, "bad words here")] * 2
    df = spark.createDataFrame(rows, "pred_x int, true_x int, text string")
    r = D.threshold_advice(df, ls).first()
    assert (r["fp"], r["fn"], r["fp_ratio"], r["advice"]) == (8, 2, 0.8, "raise threshold")
    assert r["fp_words"] == "good, here, text" and r["fn_words"] == "bad, here, words"


def test_confusion_pairs_no_explode(spark):
    from polylabel.schema import LabelSet
    ls = LabelSet(("a", "b", "c"))
    rows = [(1, 0, 0, 0, 1, 1), (1, 0, 0, 0, 1, 0), (0, 1, 0, 1, 0, 0)]
    df = spark.createDataFrame(rows, "true_a int, true_b int, true_c int, pred_a int, pred_b int, pred_c int")
    got = [(r["true_label"], r["pred_label"], r["n"], r["rank"]) for r in
           D.confusion_pairs(df, ls).orderBy("rank").collect()]
    assert got == [("a", "b", 2, 1), ("a", "c", 1, 2), ("b", "a", 1, 3)]


def test_error_words_explode_a_text_once(spark):
    """A text with several errors is exploded once; counts stay by label and kind."""
    from polylabel.schema import LabelSet

    ls = LabelSet(("x", "y"))
    rows = [("A", "foo foo bar", 1, 0, 0, 1), ("A", "foo baz", 0, 1, 1, 1), ("B", "bar", 1, 1, 1, 1), (None, "qux qux it", 0, 0, 1, 0), ("B", None, 1, 0, 0, 0)]
    df = spark.createDataFrame(rows, "annotator_id string, text string, true_x int, true_y int, pred_x int, pred_y int")
    out = D.error_words(df, ls, group_cols=("annotator_id",), top=2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert out.columns == ["annotator_id", "label", "label_index", "kind", "word", "n", "rank"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        ("A", "x", 0, "fn", "foo", 2, 1), ("A", "x", 0, "fn", "bar", 1, 2), ("A", "y", 1, "fp", "foo", 2, 1), ("A", "y", 1, "fp", "bar", 1, 2),
        ("A", "x", 0, "fp", "baz", 1, 1), ("A", "x", 0, "fp", "foo", 1, 2), (None, "x", 0, "fp", "qux", 2, 1)], key=str)
