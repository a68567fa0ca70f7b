"""Training shards on storage."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from inputs import SF001
from polylabel.operators import sampling as S
from polylabel.sources import fixtures as FX
from polylabel.sources import shards as SH


def rows(spark, n=330):
    return spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))


def listed(spark, path):
    """Every shard's rows in the order of its one file."""
    out = {}
    for folder in sorted(glob.glob(f"{path}/rows/shard=*")):
        files = glob.glob(f"{folder}/*.parquet")
        assert len(files) == 1
        out[os.path.basename(folder)] = [tuple(r) for r in spark.read.parquet(files[0]).coalesce(1).collect()]
    return out


def test_files_do_not_depend_on_the_layout(spark, tmp_path):
    SH.write_shards(rows(spark), f"{tmp_path}/a", 5)
    SH.write_shards(rows(spark).repartition(13).orderBy(F.desc("row_id")), f"{tmp_path}/b", 5)
    a, b = listed(spark, f"{tmp_path}/a"), listed(spark, f"{tmp_path}/b")
    assert a == b and sum(map(len, a.values())) == 330 // 32 * 32
    for found in a.values():
        assert [r[2] for r in found] == list(range(len(found)))  # sorted by position


def test_manifest_and_ranges(spark, tmp_path):
    path = f"{tmp_path}/s"
    manifest = SH.write_shards(rows(spark), path, 5).collect()
    assert [r.first_batch for r in manifest] == [sum(q.batches for q in manifest[:k]) for k in range(len(manifest))]
    want = {(r.row_id, r.shard, r.position, r.batch_in_shard) for r in S.training_shards(rows(spark), 5).collect()}
    every = SH.read_batches(spark, path).collect()
    assert {(r.row_id, r.shard, r.position, r.batch_in_shard) for r in every} == want
    n = max(r.batch for r in every) + 1
    assert sorted(r.batch for r in every) == [b for b in range(n) for _ in range(32)]
    for first, last in ((0, 1), (3, 7), (n - 1, None), (0, n), (n, None), (4, 4)):
        got = SH.read_batches(spark, path, first, last).collect()
        assert {(r.row_id, r.batch) for r in got} == {(r.row_id, r.batch) for r in every if first <= r.batch < (n if last is None else last)}
    # a range opens only the folders of the shards that hold it
    assert len(SH.read_batches(spark, path, 0, 1).select("shard").distinct().collect()) == 1
    plan = SH.read_batches(spark, path, 0, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "shard" in plan.split("PartitionFilters")[1].split("]")[0]


def test_short_batches_stay_without_drop_last(spark, tmp_path):
    SH.write_shards(rows(spark, 50), f"{tmp_path}/s", 3, batch_size=8, drop_last=False)
    back = SH.read_batches(spark, f"{tmp_path}/s").collect()
    assert sorted(r.row_id for r in back) == list(range(50))


def test_written_once(spark, tmp_path):
    df = FX.labelled(spark, SF001).select("row_id", "text")
    SH.write_shards(df, f"{tmp_path}/s", 2)
    with pytest.raises(Exception, match="(?i)exists"):
        SH.write_shards(df, f"{tmp_path}/s", 2)


def test_empty_table(spark, tmp_path):
    assert SH.write_shards(rows(spark, 0), f"{tmp_path}/s", 2).collect() == []


def test_large_shards_are_written_in_runs(spark, tmp_path, monkeypatch):
    """No task writes all rows of a large shard; the rows stay as they were."""
    monkeypatch.setattr(SH, "FILE_ROWS", 32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        SH.write_shards(rows(spark, 1500), f"{tmp_path}/s", 2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(len(glob.glob(f"{tmp_path}/s/rows/shard={k}/*.parquet")) > 3 for k in range(2))
    every = SH.read_batches(spark, f"{tmp_path}/s").drop("batch").select("row_id", "shard", "position", "batch_in_shard")
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, S.training_shards(rows(spark, 1500), 2).select(*every.columns).collect()))
