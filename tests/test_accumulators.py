"""Metric accumulators of a stream on storage."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from inputs import SF001
from polylabel.operators import metrics as M
from polylabel.schema import DEFAULT_LABELS as L
from polylabel.sources import fixtures as FX
from polylabel.streaming import accumulators as AC
from polylabel.streaming import metrics as SM


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('scored')}/rows"
    d = F.col("row_id")
    run = F.when(d % 3 != 0, F.concat(F.lit("r"), d % 3))  # null is a run of its own
    FX.scored(spark, SF001).select("row_id", run.alias("run"), F.when(d % 2 == 0, "train").otherwise("val").alias("phase"),
                                   (d % 4).alias("epoch"), *L.true_cols, *L.pred_cols).repartition(4, "row_id").write.parquet(path)
    return path


def stream(spark, path):
    return SM.read_parquet_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)


def rows(df):
    return sorted(map(str, df.select(*AC.KEYS, "label", "tp", "fp", "fn", "tn", "support").collect()))


def want(spark, path):
    return rows(M.per_label_metrics(spark.read.parquet(path), L, AC.KEYS))


def test_equals_the_batch_query_and_keeps_two_versions(spark, scored, tmp_path):
    path = f"{tmp_path}/acc"
    AC.accumulate(stream(spark, scored), path).awaitTermination()
    assert rows(AC.per_label(spark, path)) == want(spark, scored)
    assert len(AC.versions(spark, path)) == 2
    AC.accumulate(stream(spark, scored), path).awaitTermination()  # nothing new
    assert rows(AC.per_label(spark, path)) == want(spark, scored)


@pytest.mark.parametrize("when", ["before", "inside", "after"])
def test_killed_and_started_again(spark, scored, tmp_path, when):
    path = f"{tmp_path}/acc"
    good = AC.upsert(path, AC.KEYS)

    def dies(totals, batch_id):
        if batch_id == 2 and when == "inside":  # a version that was not written to its end
            totals.limit(1).write.mode("overwrite").parquet(f"{path}/state/version=2")
            os.remove(f"{path}/state/version=2/_SUCCESS")
        if batch_id != 2 or when == "after":
            good(totals, batch_id)
        if batch_id == 2:
            raise RuntimeError("killed")

    with pytest.raises(StreamingQueryException):
        AC.accumulate(stream(spark, scored), path, sink=dies).awaitTermination()
    assert AC.versions(spark, path)[-1] == (2 if when == "after" else 1)
    AC.accumulate(stream(spark, scored), path).awaitTermination()
    assert rows(AC.per_label(spark, path)) == want(spark, scored)


def test_a_batch_again_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/acc"
    put = AC.upsert(path, ["k"])
    table = lambda *r: spark.createDataFrame(list(r), "k string, n long")
    assert AC.read_state(spark, path) is None
    put(table(("a", 1), (None, 5)), 0)
    for _ in range(2):
        put(table(("a", 3), ("b", 1), (None, 6)), 1)
        assert {tuple(r) for r in AC.read_state(spark, path).collect()} == {("a", 3), ("b", 1), (None, 6)}
    put(table(), 2)
    assert AC.read_state(spark, path).count() == 3
