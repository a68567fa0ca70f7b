"""Balancing, splitting and sampling invariants."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inputs import SF01
from polylabel.operators import sampling as S
from polylabel.operators import stats as ST
from polylabel.schema import DEFAULT_LABELS as L
from polylabel.sources import fixtures as FX


@pytest.fixture(scope="module")
def lab(spark):
    return FX.labelled(spark, SF01).cache()


def test_flag_lowest_k_matches_brute_force(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("key", S.selection_key("row_id"))
    ks = spark.createDataFrame([(0, 17), (1, 1000), (2, 0)], "g long, k long")
    for digits in (1, 2, 3):
        got = S.flag_lowest_k(df, ["g"], ks, "key", "row_id", "sel", bucket_digits=digits)
        sel = {r[0] for r in got.filter("sel").select("row_id").collect()}
        w = Window.partitionBy("g").orderBy("key", "row_id")
        brute = df.join(ks, "g").withColumn("rn", F.row_number().over(w)).filter("rn <= k")
        assert sel == {r[0] for r in brute.select("row_id").collect()}
        assert got.count() == 5000


def test_oversample_exact_quotas(spark, lab):
    plan = {r["label"]: r for r in S.oversample_plan(lab).collect()}
    assert {k: v["quota"] for k, v in plan.items()} == {"anger": 129, "fear": 0, "joy": 156,
                                                        "sadness": 121, "surprise": 134}
    out = S.oversample(lab).cache()
    synth = out.filter(F.col("copy_no") > 0)
    per = {r["copy_label"]: r["count"] for r in synth.groupBy("copy_label").count().collect()}
    assert per == {"anger": 129, "joy": 156, "sadness": 121, "surprise": 134}
    after = {r["label"]: r["count"] for r in ST.label_counts(out).collect()}
    target = max(v["count"] for v in plan.values())
    assert all(c >= target for c in after.values())
    # copies keep the labels of their origin and carry the trigger label
    bad = synth.join(lab.select(F.col("row_id").alias("origin_id"), *[F.col(n).alias("o_" + n) for n in L.names]),
                     "origin_id").filter(" OR ".join(f"{n} <> o_{n}" for n in L.names))
    assert bad.count() == 0


def test_oversample_independent_of_partitioning(spark, lab):
    a = S.oversample(lab.repartition(3)).select("origin_id", "copy_label", "copy_no", F.md5("text")).collect()
    b = S.oversample(lab.repartition(11)).select("origin_id", "copy_label", "copy_no", F.md5("text")).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_oversample_chunked_copies(spark):
    # one rare row with a huge multiplier is spread in chunks
    rows = [(i, "a b c d e", 1 if i < 2 else 0, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id long, text string, anger int, fear int")
    from polylabel.schema import LabelSet
    out = S.oversample(df, LabelSet(("anger", "fear")), copy_chunk=7)
    assert out.filter("copy_label = 'anger'").count() == 48
    assert out.filter("copy_label = 'anger'").select("origin_id", "copy_no").distinct().count() == 48


def test_swap_delete_semantics(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], 0, 1, 3, 2), (["a", "b", "c"], 2, 0, 1, 0)],
                               "w array<string>, kind int, pa int, pb int, pd int")
    from polylabel.functions import text as TF
    got = [r[0] for r in df.select(TF.swap_delete("w", "kind", "pa", "pb", "pd")).collect()]
    assert got == [["a", "d", "c", "b", "e"], ["a", "b", "c"]]


def test_stratified_split_invariants(spark, lab):
    split = S.stratified_split(lab).cache()
    assert split.count() == 1000
    assert split.filter("split = 'val'").count() == 100
    assert split.select("row_id").distinct().count() == 1000
    # every stratum keeps roughly 10% in validation
    per = split.groupBy("stratum").agg(F.sum(F.when(F.col("split") == "val", 1).otherwise(0)).alias("v"),
                                       F.count(F.lit(1)).alias("n")).collect()
    assert all(abs(r["v"] - 0.1 * r["n"]) < 1 for r in per)


def test_weights_sum_invariant(spark, lab):
    w = S.sample_weights(lab)
    total = w.agg(F.sum("weight")).first()[0]
    zero = lab.filter(" + ".join(L.names) + " = 0").count()
    assert total == pytest.approx(len(L) + zero)


def test_weighted_sample_and_shards(spark, lab):
    w = S.sample_weights(lab)
    s = S.weighted_sample(w, "weight", 50)
    assert s.count() == 50 and s.select("row_id").distinct().count() == 50
    sh = S.training_shards(lab, n_shards=4, batch_size=32)
    per = sh.groupBy("shard", "batch_in_shard").count().collect()
    assert all(r["count"] == 32 for r in per)
    # one short batch of the whole epoch goes, not one per shard
    assert sh.count() == lab.count() // 32 * 32 == sh.select("row_id").distinct().count()
    assert S.training_shards(lab, 4, 32, drop_last=False).count() == lab.count()


def test_split_allocation_of_billions(spark):
    strata = spark.createDataFrame([("10000", 6_000_000_001), ("01000", 6_000_000_000), ("00100", 7)], "stratum string, n_s long")
    got = {r["stratum"]: r for r in S.split_allocation(None, L, 0.1, strata=strata).collect()}
    total = 12_000_000_008
    assert sum(r["k"] for r in got.values()) == -(-total // 10)
    train = total - -(-total // 10)
    assert all(abs(r["n_train"] - train * r["n_s"] / total) < 1 + 1e-6 for r in got.values())


def test_augmentation_rules(spark):
    from polylabel.schema import LabelSet
    rows = [(i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate([3, 4, 12, 40] * 25)]
    df = spark.createDataFrame(rows, "row_id long, text string")
    out = S.augment_train_text(df).join(df.withColumnRenamed("text", "orig"), "row_id").collect()
    for r in out:
        n = len(r["orig"].split())
        if n <= 4:
            assert r["text"] == r["orig"]
        else:
            words = r["text"].split()
            assert sorted(words) == sorted(r["orig"].split()) or len(words) >= n - n // 10
    assert LabelSet(("x",))


def test_bootstrap_mode_quotas(spark, lab):
    out = S.oversample(lab, mode="bootstrap").filter("copy_no > 0")
    per = {r["copy_label"]: r["count"] for r in out.groupBy("copy_label").count().collect()}
    assert per == {"anger": 129, "joy": 156, "sadness": 121, "surprise": 134}
    # every copy comes from a row that carries its trigger label
    assert out.filter(" OR ".join(f"(copy_label = '{n}' AND {n} <> 1)" for n in L.names)).count() == 0


def test_weighted_sample_large_k_path_is_exact(spark, lab):
    w = S.sample_weights(lab)
    small = {r["row_id"] for r in S.weighted_sample(w, "weight", 300).collect()}
    large = {r["row_id"] for r in S.weighted_sample(w, "weight", 300, top_k_limit=10, accuracy=1000).collect()}
    assert small == large and len(large) == 300


def test_rank_draws_reach_every_rank(spark):
    from polylabel.functions import text as TF
    n = 1 << 40
    df = spark.range(200).select(S.rank_draw(1, F.lit(n), F.col("id"), "boot").alias("wide"),
                                 S.rank_draw(1, F.lit(1 << 32), F.col("id"), "boot").alias("border"),
                                 S.rank_draw(1, F.lit(7), F.col("id"), "boot").alias("small"),
                                 TF.draw(1, F.col("id"), "boot", digits=15).alias("draw"))
    rows = df.collect()
    # one rule at every size, on both sides of 2^32
    assert all((r["wide"], r["border"], r["small"]) == (r["draw"] % n, r["draw"] % (1 << 32), r["draw"] % 7) for r in rows)
    assert max(r["wide"] for r in rows) > n * 0.9 and min(r["wide"] for r in rows) < n * 0.1
