"""Draws with replacement, in proportion to weights (F6): what a weighted
sampler draws for an epoch.

Weights become whole numbers: units of a power of two, the largest that keeps
their total under 2^59. Laid end to end, in the order of the rows' seeded keys,
they make a line; draw j is the point at the 60-bit fraction of (seed, j) of
that line, and takes the row whose span it falls into. So every draw is
independent and the number of draws exact, and a row's share is exact to one unit.

1. Rows are bucketed by the leading hex digits of their key; totals per bucket
   (4096 rows, broadcast) give each bucket's start, a running sum inside the
   bucket each row's start.
2. The line is cut into ``CELLS`` cells of equal length. A row goes to each cell
   that its span touches (rows + CELLS copies at most, so a row of a third of
   the weight is spread over a third of the cells), a draw to the cell of its
   point.
3. Inside a cell, rows and draws are sorted by place, and a draw takes the last
   row that starts before it: no pairs are listed. As keys are hashes, light and
   heavy rows are mixed evenly, and no cell has many more rows than others.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as TF
from .sampling import DEFAULT_SEED, selection_key

CELLS = 4096
BITS = 59


def _units(rows: DataFrame) -> int:
    """The exponent of two that turns weights into units. The total is summed
    in decimals, so it does not depend on the order of rows."""
    total = rows.agg(F.sum(F.col("w").cast("decimal(38,18)"))).first()[0]
    return BITS - math.frexp(float(total or 0))[1]


def _usable(weight_col: str):
    return (F.col(weight_col) > 0) & (F.col(weight_col) < float("inf"))


def weighted_draws(df: DataFrame, weight_col: str, k: int, seed: int = DEFAULT_SEED, id_col: str = "row_id") -> DataFrame:
    """(draw, ``id_col``): ``k`` draws with replacement, numbered from 0.

    Rows with a null, zero, negative, infinite or NaN weight are never drawn;
    if no row can be drawn, the result is empty. Weights count to 18 decimals, and
    a total of 10^20 or more is an error. Ids are to be distinct; rows that share
    one are drawn by each row's weight."""
    rows = df.select(F.col(id_col).alias("id"), F.col(weight_col).cast("double").alias("w")).filter(_usable("w") & ~F.isnan("w"))
    rows = rows.withColumn("key", selection_key("id", seed)).withColumn("bucket", F.substring("key", 1, 3))
    units = 2.0 ** _units(rows)
    rows = rows.withColumn("size", F.floor(F.col("w") * F.lit(units)).cast("long")).filter("size > 0")
    totals = rows.groupBy("bucket").agg(F.sum("size").alias("total"))
    every = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = totals.withColumn("before", F.sum("total").over(every) - F.col("total")).drop("total")  # 4096 rows at most
    line = totals.agg(F.sum("total")).first()[0] or 0
    if not line:
        return rows.select(F.lit(0).cast("long").alias("draw"), F.col("id").alias(id_col)).limit(0)
    inside = Window.partitionBy("bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.col("before") + F.sum("size").over(inside)
    spans = rows.join(F.broadcast(starts), "bucket").withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size"))
    width = line // CELLS + 1
    cell = lambda c: F.expr(f"{c} div {width}")
    spans = spans.select(F.explode(F.sequence(cell("start"), cell("(stop - 1)"))).alias("cell"), F.col("start").alias("at"), "id",
                         F.lit(None).cast("long").alias("draw"))
    point = (TF.draw(seed, F.col("draw"), "with replacement", digits=15).cast("decimal(19,0)") * F.lit(line).cast("decimal(19,0)")).cast("decimal(38,0)")
    draws = df.sparkSession.range(k).withColumnRenamed("id", "draw").withColumn("point", point).withColumn("at", F.expr(f"point div {1 << 60}"))
    kind = rows.schema["id"].dataType
    draws = draws.select(cell("at").alias("cell"), "at", F.lit(None).cast(kind).alias("id"), "draw")
    by_place = (Window.partitionBy("cell").orderBy("at", F.col("draw").isNotNull())
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = F.last(F.when(F.col("draw").isNull(), F.struct("id")), ignorenulls=True).over(by_place)
    both = spans.unionByName(draws).withColumn("taken", taken)
    return both.filter("draw is not null").select("draw", F.col("taken.id").alias(id_col))


def drawn_counts(df: DataFrame, weight_col: str, k: int, seed: int = DEFAULT_SEED, id_col: str = "row_id") -> DataFrame:
    """(``id_col``, times): how often each drawn row was drawn."""
    return weighted_draws(df, weight_col, k, seed, id_col).groupBy(id_col).agg(F.count(F.lit(1)).alias("times"))
