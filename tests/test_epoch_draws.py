"""Draws with replacement."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from polylabel.operators import epoch_draws as ED


def brute(weights, k, seed=42):
    """Every draw by a walk along the line."""
    usable = {i: w for i, w in weights.items() if w is not None and 0 < w < math.inf}
    bits = ED.BITS - math.frexp(sum(usable.values()))[1]
    order = sorted(usable, key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i))
    sizes = [math.floor(usable[i] * 2.0 ** bits) for i in order]
    total, out = sum(sizes), []
    for j in range(k):
        at = int(hashlib.md5(f"{seed}:{j}:with replacement".encode()).hexdigest()[:15], 16) * total >> 60
        for i, s in zip(order, sizes):
            if at < s:
                out.append((j, i))
                break
            at -= s
    return out


@pytest.mark.parametrize("weights", [
    {i: 1.0 for i in range(50)},
    {i: 1 / (i + 1) for i in range(300)},
    {1: 1e9, 2: 1e-9, 3: 3.0},
    {1: None, 2: 0.0, 3: -1.0, 4: math.inf, 5: math.nan, 6: 0.25, 7: 0.5},
    {9: 1e-6},
], ids=["even", "falling", "one heavy", "unusable", "one light"])
def test_draws_against_brute_force(spark, weights):
    df = spark.createDataFrame(list(weights.items()), "row_id long, w double")
    for part in (df, df.repartition(7)):
        got = sorted(tuple(r) for r in ED.weighted_draws(part, "w", 400).collect())
        assert got == brute(weights, 400)


def test_multiplicities_follow_the_weights(spark):
    """A row of a third of the weight is spread over many cells and comes a
    third of the time."""
    df = spark.range(2001).select(F.col("id").alias("row_id"), F.when(F.col("id") == 7, 1000.0).otherwise(1.0).alias("w"))
    k = 30_000
    times = {r.row_id: r.times for r in ED.drawn_counts(df, "w", k).collect()}
    assert sum(times.values()) == k
    assert abs(times[7] - k / 3) < 4 * math.sqrt(k * 2 / 9)
    chi = sum((times.get(i, 0) - 10) ** 2 / 10 for i in range(2001) if i != 7 and k / 3000 == 10)
    assert abs(chi - 2000) < 5 * math.sqrt(2 * 2000)


def test_nothing_to_draw(spark):
    none = spark.createDataFrame([], "row_id string, w double")
    assert ED.weighted_draws(none, "w", 5).collect() == [] and ED.weighted_draws(none, "w", 5).columns == ["draw", "row_id"]
    some = spark.createDataFrame([("a", 1.0)], "row_id string, w double")
    assert ED.weighted_draws(some, "w", 0).collect() == []
    assert sorted(tuple(r) for r in ED.weighted_draws(some, "w", 2).collect()) == [(0, "a"), (1, "a")]
