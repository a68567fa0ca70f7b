"""Label pairs of large label sets."""

import itertools
import random
from collections import Counter

from inputs import SF001
from polylabel.operators import discrepancy as D
from polylabel.operators import label_pairs as LP
from polylabel.operators import stats as ST
from polylabel.plans.catalog import _joined
from polylabel.schema import DEFAULT_LABELS as L
from polylabel.sources import fixtures as FX


def test_equals_the_wide_forms_for_few_labels(spark):
    lab = FX.labelled(spark, SF001)
    few = {(r.index_a, r.index_b): r.n for r in ST.label_cooccurrence(lab, L).collect() if r.n}
    got = {(r.a, r.b): r.n for r in LP.cooccurrence(lab, LP.present_ids(L.names)).collect()}
    assert got == few
    scored = _joined(spark, SF001)
    want = [(r.true_index, r.pred_index, r.n, r["rank"]) for r in D.confusion_pairs(scored, L).collect()]
    top = LP.ranked_confusions(LP.dense_ids(scored, L), "true_ids", "pred_ids", 25).collect()
    assert sorted((r.true_id, r.pred_id, r.n, r["rank"]) for r in top) == sorted(want) and want


def test_a_thousand_labels_against_brute_force(spark):
    rng = random.Random(5)
    pick = lambda: rng.choice([None, [], [rng.choice([None, rng.randrange(1000)]) for _ in range(rng.randrange(30))]])
    data = [(pick(), pick()) for _ in range(150)] + [(list(range(1000)), [999, 999, None])]
    df = spark.createDataFrame(data, "t array<int>, p array<int>").repartition(5)
    clean = lambda x: {v for v in x or [] if v is not None}
    pairs, wrong = Counter(), Counter()
    for t, p in data:
        t, p = clean(t), clean(p)
        pairs.update(itertools.product(t, t))
        wrong.update(itertools.product(t - p, p - t))
    assert {(r.a, r.b): r.n for r in LP.cooccurrence(df, "t").collect()} == pairs
    assert {(r.a, r.b): r.n for r in LP.cooccurrence(df, "t", symmetric=False).collect()} == {k: n for k, n in pairs.items() if k[0] <= k[1]}
    assert {(r.true_id, r.pred_id): r.n for r in LP.confusions(df, "t", "p").collect()} == wrong


def test_shuffles_pairs_not_rows(spark):
    """What is exchanged is the map side's partial counts."""
    df = spark.createDataFrame([([1, 2],)], "ids array<int>")
    plan = LP.cooccurrence(df, "ids", symmetric=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("partial_count") and plan.count("Exchange hashpartitioning") == 1


def test_empty_table_and_null_flags(spark):
    none = spark.createDataFrame([], "t array<int>, p array<int>")
    assert LP.cooccurrence(none, "t").count() == 0 and LP.confusions(none, "t", "p").count() == 0
    one = spark.createDataFrame([(1, None, 0)], "a int, b int, c int")
    assert one.select(LP.present_ids(["a", "b", "c"])).first()[0] == [0]
