"""The shipped labelled CSV (FIXTURES 2.3), read in place when present."""

import os

import pytest
from pyspark.sql import functions as F

from inputs import CSV
from polylabel.functions import text as TF
from polylabel.operators import metrics as M
from polylabel.operators import sampling as S
from polylabel.operators import stats as ST
from polylabel.schema import DEFAULT_LABELS as L
from polylabel.schema import labelled_schema
from polylabel.sources import readers as R

pytestmark = pytest.mark.skipif(not CSV or not os.path.exists(CSV),
                                reason="set POLYLABEL_DEV_CSV to the labelled CSV fixture")


@pytest.fixture(scope="module")
def dev(spark):
    df = R.read_labelled_csv(spark, CSV, schema=labelled_schema())
    df = R.validate_labelled(df).withColumn("row_id", F.regexp_extract("id", r"(\d+)$", 1).cast("long"))
    return df.cache()


def test_quoting(dev):
    assert dev.count() == 116
    assert dev.filter(F.col("row_id") == 20).first()["text"] == '"  I\'m like "sure.'


def test_counts_and_histogram(spark, dev):
    got = {r["label"]: r["count"] for r in ST.label_counts(dev).collect()}
    assert got == {"anger": 16, "fear": 63, "joy": 31, "sadness": 35, "surprise": 31}
    hist = sorted(tuple(r)[:2] for r in M.cardinality_histogram(dev, L.names, include_zero=True).collect())
    assert hist == [(0, 13), (1, 46), (2, 42), (3, 14), (4, 1)]


def test_cooccurrence(dev):
    m = {(r["label_a"], r["label_b"]): r["n"] for r in ST.label_cooccurrence(dev).collect()}
    expect = [[16, 10, 0, 8, 5], [10, 63, 6, 27, 21], [0, 6, 31, 1, 7], [8, 27, 1, 35, 5], [5, 21, 7, 5, 31]]
    for i, a in enumerate(L.names):
        for j, b in enumerate(L.names):
            assert m[(a, b)] == expect[i][j]


def test_combinations(dev):
    combos = {r["labels"]: r["n"] for r in ST.label_combinations(dev).collect()}
    assert len(combos) == 19
    assert combos["joy"] == 19 and combos["fear, sadness"] == 17 and combos["fear"] == 14
    assert combos["fear, surprise"] == 13 and combos["none"] == 13


def test_quotas_and_weights(spark, dev):
    plan = {r["label"]: r["quota"] for r in S.oversample_plan(dev).collect()}
    assert plan == {"anger": 47, "fear": 0, "joy": 32, "sadness": 28, "surprise": 32}
    w = {r["row_id"]: r["weight"] for r in S.sample_weights(dev).select("row_id", "weight").collect()}
    assert sum(w.values()) == pytest.approx(18.0)
    assert w[1] == pytest.approx(1 / 16)
    assert w[3] == pytest.approx(1 / 16 + 1 / 63 + 1 / 35 + 1 / 31)


def test_split_size(dev):
    split = S.stratified_split(dev)
    assert split.filter("split = 'val'").count() == 12
    assert split.count() == 116


def test_top_words(dev):
    words = dev.select(F.explode(TF.word_tokens("text")).alias("w")).groupBy("w").count() \
        .orderBy(F.desc("count"), "w").limit(6).collect()
    assert [(r["w"], r["count"]) for r in words] == [("the", 73), ("and", 61), ("was", 28), ("that", 20),
                                                      ("this", 16), ("with", 11)]
