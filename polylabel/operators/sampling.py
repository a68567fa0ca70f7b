"""Balancing, splitting and sampling (F1-F8).

Every random choice is a seeded md5 of the row key (``functions.text.draw``
/ ``selection_key``), so results are stable under task retries, executor
loss and repartitioning, and DuckDB can rebuild them.

Exact per-group "lowest k by hash" selection (oversampling remainders,
stratified split) never ranks a whole group in one task: rows are bucketed
by the leading hex digits of their hash, a small (group, bucket) histogram
locates the boundary bucket of each group, whole buckets below it are taken,
and only the boundary bucket is ranked. A group holding a third of the
table is thus spread over thousands of buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as TF
from ..schema import DEFAULT_LABELS, LabelSet, require_columns
from ..session import bounded_broadcast
from .stats import label_counts

DEFAULT_SEED = 42


def selection_key(row_id, seed: int = DEFAULT_SEED) -> Column:
    """md5(``<row_id>:<seed>``) as 32 hex digits; ties broken by row_id."""
    rid = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(rid.cast("string"), F.lit(f":{seed}")))


def bucket_histogram(df: DataFrame, group_cols, key_col: str, bucket_digits: int = 3) -> DataFrame:
    """Row counts per (group, leading ``bucket_digits`` hex digits of the
    key): at most groups x 16^digits rows, built with a partial aggregation."""
    b = F.substring(F.col(key_col), 1, bucket_digits)
    return df.groupBy(*group_cols, b.alias("_bucket")).agg(F.count(F.lit(1)).alias("_cnt"))


def flag_lowest_k(df: DataFrame, group_cols, k_table: DataFrame, key_col: str, tie_col: str,
                  out_col: str = "selected", bucket_digits: int = 3, hist: DataFrame | None = None) -> DataFrame:
    """Flags, per group, the ``k`` rows with the lowest (key, tie) — exact.

    ``k_table`` has the group columns and ``k`` (one row per group). The
    (group, bucket) decision table has at most groups x 16^bucket_digits
    rows; it is counted and broadcast only below ``BROADCAST_MAX_ROWS``
    (many strata fall back to a shuffle join). Only rows of a boundary bucket
    go through a window, and that window is partitioned by (group, bucket)."""
    group_cols = list(group_cols)
    if hist is None:
        hist = bucket_histogram(df, group_cols, key_col, bucket_digits)
    df = df.withColumn("_bucket", F.substring(F.col(key_col), 1, bucket_digits))
    w = Window.partitionBy(*group_cols).orderBy("_bucket") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dec = (hist.join(k_table.select(*group_cols, F.col("k").alias("_k")), group_cols, "left")
           .withColumn("_cum", F.sum("_cnt").over(w))
           .withColumn("_before", F.col("_cum") - F.col("_cnt"))
           .withColumn("_k", F.coalesce("_k", F.lit(0)))
           .withColumn("_mode", F.when(F.col("_cum") <= F.col("_k"), F.lit(2))
                       .when(F.col("_before") >= F.col("_k"), F.lit(0)).otherwise(F.lit(1)))
           .withColumn("_need", F.col("_k") - F.col("_before"))
           .select(*group_cols, "_bucket", "_mode", "_need"))
    j = df.join(bounded_broadcast(dec), group_cols + ["_bucket"], "left")
    whole = j.filter(F.col("_mode") != 1).withColumn(out_col, F.col("_mode") == 2)
    edge_w = Window.partitionBy(*group_cols, "_bucket").orderBy(key_col, tie_col)
    edge = (j.filter(F.col("_mode") == 1)
            .withColumn(out_col, F.row_number().over(edge_w) <= F.col("_need")))
    return whole.unionByName(edge).drop("_bucket", "_mode", "_need")


# ------------------------------------------------------------ oversampling

def oversample_plan(df: DataFrame, labels: LabelSet = DEFAULT_LABELS) -> DataFrame:
    """D6 + F1 quotas: per label, count, target (max count), quota =
    target - count, and the split of the quota into full copies of every row
    with the label plus a remainder. Labels with no rows get no quota
    (``skipped``)."""
    counts = label_counts(df, labels)
    w = Window.partitionBy(F.lit(0))  # over the L-row count table only
    c = counts.withColumn("target", F.max("count").over(w))
    q = F.col("target") - F.col("count")
    return c.select(
        "label", "label_index", "count", "target",
        F.when(F.col("count") > 0, q).cast("long").alias("quota"),
        F.when(F.col("count") > 0, F.floor(q / F.col("count"))).cast("long").alias("full_copies"),
        F.when(F.col("count") > 0, F.pmod(q, F.col("count"))).cast("long").alias("remainder"),
        (F.col("count") == 0).alias("skipped"))


def _plan_literals(plan_rows):
    return {r["label"]: (int(r["full_copies"] or 0), int(r["remainder"] or 0), int(r["quota"] or 0))
            for r in plan_rows}


def _copy_text(synth: DataFrame, seed: int, id_col: str, augment: bool):
    """Text of synthetic copies: B23 swap/delete with per-copy draws seeded
    by (seed, row, label, copy number). The word array and the draws are
    materialised as columns first; inside the array lambdas they would be
    re-evaluated for every element."""
    if not augment:
        return synth, F.col("text")
    rid, lab, cno = F.col(id_col), F.col("copy_label"), F.col("copy_no")
    synth = synth.withColumns({
        "_w": TF.words(F.col("text")),
        "_kind": F.pmod(TF.draw(seed, rid, lab, cno, "kind"), 3),
        "_d1": TF.draw(seed, rid, lab, cno, "a"),
        "_d2": TF.draw(seed, rid, lab, cno, "b"),
        "_d3": TF.draw(seed, rid, lab, cno, "d"),
    })
    synth = synth.withColumns(TF.swap_delete_positions("_w", "_d1", "_d2", "_d3"))
    return synth, F.array_join(TF.swap_delete("_w", "_kind", "_pa", "_pb", "_pd"), " ")


def oversample(df: DataFrame, labels: LabelSet = DEFAULT_LABELS, seed: int = DEFAULT_SEED,
               id_col: str = "row_id", augment: bool = True, copy_chunk: int = 4096,
               plan_rows=None, include_original: bool = True, mode: str = "exact") -> DataFrame:
    """F1 + F2 + F3 + C2: oversample every label up to the largest label
    count. Quotas come from the original table; the source rows of label l
    are the rows having l; copies keep all labels and ``source`` (so other
    labels may overshoot). Each row of label l gets ``floor(q/n)`` copies,
    plus one for the ``q mod n`` rows with the lowest seeded hash, so the
    total per label is exactly the quota.

    Copies are generated in chunks of ``copy_chunk`` that are spread over
    tasks before the final explode, so a rare label with a huge multiplier
    does not put millions of copies on one task. Synthetic text is the B23
    swap/delete augmentation with per-copy seeded draws.

    Output: origin_id, copy_label (null for originals), copy_no (0 for
    originals), text, labels..., source.
    """
    require_columns(df, [id_col, "text"] + list(labels.names), "labelled table")
    if plan_rows is None:
        plan_rows = oversample_plan(df, labels).collect()  # L rows
    if mode == "bootstrap":
        return oversample_bootstrap(df, labels, seed, id_col, augment, plan_rows, include_original)
    if mode != "exact":
        raise ValueError(f"unknown oversampling mode {mode!r}")
    plan = _plan_literals(plan_rows)
    active = [n for n in labels.names if plan.get(n, (0, 0, 0))[2] > 0]
    base = df.withColumn("_key", selection_key(id_col, seed))
    extra_cols = [c for c in ("source",) if c in df.columns]
    originals = df.select(F.col(id_col).alias("origin_id"), F.lit(None).cast("string").alias("copy_label"),
                          F.lit(0).cast("long").alias("copy_no"), "text", *labels.names, *extra_cols)
    if not active:
        return originals
    # one (row, label) pair per active label the row carries: at most L per row
    pairs = base.select("*", F.explode(F.filter(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in active]),
                                                 lambda x: x.isNotNull())).alias("copy_label"))
    k_rows = [(n, plan[n][1]) for n in active]
    spark = df.sparkSession
    k_table = spark.createDataFrame(k_rows, "copy_label string, k long")
    flagged = flag_lowest_k(pairs, ["copy_label"], k_table, "_key", id_col, out_col="_extra")
    full = F.create_map(*[x for n in active for x in (F.lit(n), F.lit(plan[n][0]))])
    copies = (F.element_at(full, F.col("copy_label")) + F.col("_extra").cast("long"))
    with_n = flagged.withColumn("_copies", copies).filter(F.col("_copies") > 0)
    chunked = with_n.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"),
                                       F.floor((F.col("_copies") - 1) / copy_chunk).cast("long"))))
    max_copies = max(plan[n][0] + (1 if plan[n][1] else 0) for n in active)
    if max_copies > copy_chunk:
        # some row needs more copies than one chunk: spread its chunks over tasks
        chunked = chunked.repartition(id_col, "copy_label", "_chunk")
    lo = F.col("_chunk") * copy_chunk + 1
    hi = F.least(F.col("_copies"), (F.col("_chunk") + 1) * copy_chunk)
    synth = chunked.withColumn("copy_no", F.explode(F.sequence(lo, hi)))
    synth, text = _copy_text(synth, seed, id_col, augment)
    synth = synth.select(F.col(id_col).alias("origin_id"), "copy_label", "copy_no",
                         text.alias("text"), *labels.names, *extra_cols)
    return originals.unionByName(synth) if include_original else synth


def rank_draw(seed: int, n, *parts) -> Column:
    """A rank below ``n``: a 60-bit draw modulo ``n``."""
    return F.pmod(TF.draw(seed, *parts, digits=15), n)


def oversample_bootstrap(df: DataFrame, labels: LabelSet = DEFAULT_LABELS, seed: int = DEFAULT_SEED,
                         id_col: str = "row_id", augment: bool = True, plan_rows=None,
                         include_original: bool = True) -> DataFrame:
    """each of the q_l synthetic rows of label l copies a row drawn
    uniformly with replacement from the n_l rows having l (draw j picks the
    row of rank pmod(md5(seed:label:j), n_l), see ``rank_draw``).

    Ranks inside a label come from the bucket histogram: rank = rows in lower
    buckets + position inside the bucket, so no window spans a whole label.
    The draws (q rows, generated from the plan counts) are equi-joined to the
    ranked rows on (label, rank)."""
    if plan_rows is None:
        plan_rows = oversample_plan(df, labels).collect()
    plan = {r["label"]: (int(r["count"]), int(r["quota"] or 0)) for r in plan_rows}
    active = [n for n in labels.names if plan.get(n, (0, 0))[1] > 0]
    extra_cols = [c for c in ("source",) if c in df.columns]
    originals = df.select(F.col(id_col).alias("origin_id"), F.lit(None).cast("string").alias("copy_label"),
                          F.lit(0).cast("long").alias("copy_no"), "text", *labels.names, *extra_cols)
    if not active:
        return originals
    spark = df.sparkSession
    pairs = (df.withColumn("_key", selection_key(id_col, seed))
             .select("*", F.explode(F.filter(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in active]),
                                             lambda x: x.isNotNull())).alias("copy_label")))
    hist = bucket_histogram(pairs, ["copy_label"], "_key")
    w = Window.partitionBy("copy_label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding,
                                                                        Window.currentRow)
    offsets = hist.withColumn("_before", F.sum("_cnt").over(w) - F.col("_cnt")).select(
        "copy_label", "_bucket", "_before")
    in_bucket = Window.partitionBy("copy_label", "_bucket").orderBy("_key", id_col)
    ranked = (pairs.withColumn("_bucket", F.substring("_key", 1, 3))
              .join(F.broadcast(offsets), ["copy_label", "_bucket"])
              .withColumn("_rank", F.col("_before") + F.row_number().over(in_bucket) - 1))
    # q_l draws per label from one range: label boundaries are literals
    total, bounds = 0, []
    for n in active:
        bounds.append((n, total, plan[n][0]))
        total += plan[n][1]
    j = F.col("id")
    label_of = None
    start_of = None
    n_of = None
    for n, start, cnt in reversed(bounds):  # highest start first: first true branch wins
        cond = j >= start
        label_of = F.when(cond, F.lit(n)) if label_of is None else label_of.when(cond, F.lit(n))
        start_of = F.when(cond, F.lit(start)) if start_of is None else start_of.when(cond, F.lit(start))
        n_of = F.when(cond, F.lit(cnt)) if n_of is None else n_of.when(cond, F.lit(cnt))
    draws = (spark.range(total).select(label_of.alias("copy_label"), (j - start_of).alias("_j"), n_of.alias("_n"))
             .withColumn("_rank", rank_draw(seed, F.col("_n"), F.col("copy_label"), F.col("_j"), "boot"))
             .withColumn("copy_no", F.col("_j") + 1))
    synth = draws.join(ranked, ["copy_label", "_rank"])
    synth, text = _copy_text(synth, seed, id_col, augment)
    synth = synth.select(F.col(id_col).alias("origin_id"), "copy_label", F.col("copy_no").cast("long"),
                         text.alias("text"), *labels.names, *extra_cols)
    return originals.unionByName(synth) if include_original else synth


# ---------------------------------------------------------------- splitting

def stratum_col(labels: LabelSet = DEFAULT_LABELS) -> Column:
    """Full label combination as a compact string key, e.g. ``10010``."""
    return F.concat(*[F.when(F.col(n) == 1, F.lit("1")).otherwise(F.lit("0")) for n in labels.names])


def split_allocation(df: DataFrame, labels: LabelSet = DEFAULT_LABELS,
                     test_size: float = 0.1, strata: DataFrame | None = None) -> DataFrame:
    """F4 quotas: n_val = ceil(test_size * n); the train share is allocated
    per stratum by largest remainder (ties: larger stratum, then stratum key),
    the rest of each stratum goes to validation. The strata table has at most
    min(2^L, n) rows, so its single-partition window is bounded."""
    if strata is None:
        strata = df.select(stratum_col(labels).alias("stratum")).groupBy("stratum") \
            .agg(F.count(F.lit(1)).alias("n_s"))
    allw = Window.partitionBy(F.lit(0))
    s = strata.withColumn("n", F.sum("n_s").over(allw))
    s = s.withColumn("n_val_total", F.ceil(F.col("n") * F.lit(float(test_size))).cast("long"))
    s = s.withColumn("n_train_total", F.col("n") - F.col("n_val_total"))
    # quotient and remainder in decimals: the product passes 2^63 from about 6e9 rows a stratum
    wide = F.col("n_train_total").cast("decimal(19,0)") * F.col("n_s").cast("decimal(19,0)")
    s = s.withColumn("_wide", wide.cast("decimal(38,0)")).withColumn("_floor", F.expr("_wide div n"))
    s = s.withColumn("_rem", F.col("_wide") - F.col("_floor").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)"))
    s = s.withColumn("_short", F.col("n_train_total") - F.sum("_floor").over(allw))
    rank_w = Window.partitionBy(F.lit(0)).orderBy(F.col("_rem").desc(), F.col("n_s").desc(), F.col("stratum"))
    s = s.withColumn("_rank", F.row_number().over(rank_w))
    n_train = F.col("_floor") + F.when(F.col("_rank") <= F.col("_short"), 1).otherwise(0)
    return s.select("stratum", "n_s", n_train.cast("long").alias("n_train"),
                    (F.col("n_s") - n_train).cast("long").alias("k"))


def stratified_split(df: DataFrame, labels: LabelSet = DEFAULT_LABELS, test_size: float = 0.1,
                     seed: int = DEFAULT_SEED, id_col: str = "row_id") -> DataFrame:
    """adds ``split`` in {train, val}; within each stratum the rows with
    the lowest seeded hash go to validation."""
    keyed = df.withColumn("stratum", stratum_col(labels)).withColumn("_key", selection_key(id_col, seed))
    # one pass builds the (stratum, bucket) histogram; stratum sizes are its sums
    hist = bucket_histogram(keyed, ["stratum"], "_key")
    strata = hist.groupBy("stratum").agg(F.sum("_cnt").alias("n_s"))
    alloc = split_allocation(df, labels, test_size, strata=strata)
    flagged = flag_lowest_k(keyed, ["stratum"], alloc.select("stratum", "k"), "_key", id_col, "_val",
                            hist=hist)
    return flagged.withColumn("split", F.when(F.col("_val"), F.lit("val")).otherwise(F.lit("train"))) \
        .drop("_val", "_key")


# ----------------------------------------------------------------- weights

def sample_weights(df: DataFrame, labels: LabelSet = DEFAULT_LABELS, no_label_weight: float = 1.0,
                   counts_rows=None) -> DataFrame:
    """F5 (+E5): weight = sum over present labels of 1/count(label); rows with
    no label weigh ``no_label_weight``. "Present" follows truthiness: any
    non-zero value and null count. The L global counts are one tiny
    aggregate collected to the driver and inlined as literals."""
    if counts_rows is None:
        counts_rows = label_counts(df, labels).select("label", "count").collect()
    counts = {r["label"]: int(r["count"]) for r in counts_rows}
    terms = []
    for n in labels.names:
        present = F.col(n).isNull() | (F.col(n) != 0)
        c = counts.get(n, 0)
        inv = F.lit(1.0 / c) if c else F.lit(0.0)
        terms.append(F.when(present, inv).otherwise(F.lit(0.0)))
    w = terms[0]
    for t in terms[1:]:
        w = w + t
    return df.withColumn("weight", F.when(w > 0, w).otherwise(F.lit(float(no_label_weight))))


def weighted_sample(df: DataFrame, weight_col: str, k: int, seed: int = DEFAULT_SEED,
                    id_col: str = "row_id", top_k_limit: int = 100_000,
                    accuracy: int = 1_000_000) -> DataFrame:
    """k rows without replacement, probability proportional to weight
    (Efraimidis-Spirakis: the k largest ln(u)/w, ties by id).

    Small k: a top-k (TakeOrderedAndProject keeps k rows per task). Large k
    (above ``top_k_limit``), where one task must not hold k rows: an
    approximate quantile gives a threshold that provably keeps at least k
    candidates (rank error <= n/accuracy), and only the few surplus
    candidates (about n/accuracy rows) are found by a small top-k and removed
    with an anti join, so the exact sample stays distributed."""
    u = (TF.draw(seed, F.col(id_col), "u", digits=15).cast("double") + F.lit(0.5)) / F.lit(float(1 << 60))
    keyed = df.withColumn("es_key", F.log(u) / F.col(weight_col))
    if k <= top_k_limit:
        return keyed.orderBy(F.col("es_key").desc(), F.col(id_col)).limit(int(k))
    n = keyed.count()
    if k >= n:
        return keyed
    q = max(0.0, 1.0 - k / n - 2.0 / accuracy)
    t_low = keyed.agg(F.percentile_approx("es_key", q, accuracy).alias("t")).first()["t"]
    cand = keyed.filter(F.col("es_key") >= F.lit(t_low))
    surplus = cand.count() - k
    if surplus <= 0:
        return cand
    drop = cand.orderBy(F.col("es_key").asc(), F.col(id_col).desc()).limit(int(surplus)).select(id_col)
    return cand.join(drop, id_col, "left_anti")


# ------------------------------------------------------------------ shards

def training_shards(df: DataFrame, n_shards: int, batch_size: int = 32, seed: int = DEFAULT_SEED,
                    id_col: str = "row_id", drop_last: bool = True) -> DataFrame:
    """F7 re-aimed: shuffled training batches written as shards. Rows go to
    shard ``pmod(draw, n_shards)``, are ordered by their seeded key inside the
    shard, and get ``batch_in_shard = position // batch_size``. What is left
    over in the shards beyond their full batches is batched together as one
    more shard, numbered ``n_shards``. With ``drop_last`` the last short batch
    of that shard goes: fewer than ``batch_size`` rows of an epoch.

    Positions come from the (shard, key bucket) histogram plus a rank inside
    the bucket, so no window holds a whole shard; the rows left over are fewer
    than ``n_shards * batch_size``, so ranking them is bounded."""
    keyed = (df.withColumn("shard", F.pmod(TF.draw(seed, F.col(id_col), "shard"), F.lit(int(n_shards))))
             .withColumn("_key", selection_key(id_col, seed)))
    hist = bucket_histogram(keyed, ["shard"], "_key")
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (hist.withColumn("_start", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
              .withColumn("_n", F.sum("_cnt").over(Window.partitionBy("shard"))).drop("_cnt"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_key", id_col)
    out = (keyed.withColumn("_bucket", F.substring("_key", 1, 3)).join(starts, ["shard", "_bucket"])
           .withColumn("position", F.col("_start") + F.row_number().over(inside) - 1)
           .withColumn("_full", F.col("_n") - F.pmod(F.col("_n"), F.lit(batch_size))))
    whole = out.filter("position < _full")
    rest = out.filter("position >= _full")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("shard", "position")) - 1
    rest = rest.withColumn("position", rank.cast("long")).withColumn("shard", F.lit(int(n_shards)).cast("long"))
    if drop_last:
        rest = (rest.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
                .filter(F.col("position") < F.col("_n") - F.pmod(F.col("_n"), F.lit(batch_size))))
    both = whole.unionByName(rest).withColumn("batch_in_shard", F.floor(F.col("position") / batch_size).cast("long"))
    return both.drop("_key", "_n", "_bucket", "_start", "_full")


# ------------------------------------------------------- train-time views

def augment_train_text(df: DataFrame, seed: int = DEFAULT_SEED, id_col: str = "row_id",
                       epoch: int = 0, p_drop: float = 0.3, p_swap: float = 0.3) -> DataFrame:
    """B21 + B22 on a training view: with probability p_drop, drop the
    positions of ``n//10`` draws (with replacement); with probability
    p_swap, swap two drawn positions (may coincide); the swap wins when both
    fire; texts of 4 words or fewer are unchanged. Draws are seeded by
    (seed, row, epoch)."""
    rid = F.col(id_col)
    scale = F.lit(4294967296.0)
    df = df.withColumn("_w", TF.words("text"))
    n = F.size(F.col("_w"))
    n_drop = F.floor(n / 10).cast("int")
    drop_idx = F.transform(F.sequence(F.lit(1), F.greatest(n_drop, F.lit(1))),
                           lambda k: F.pmod(TF.draw(seed, rid, epoch, "drop", k), n))
    # draws become columns before the array lambdas read them
    df = df.withColumns({
        "_fd": TF.draw(seed, rid, epoch, "pdrop").cast("double") / scale < F.lit(p_drop),
        "_fs": TF.draw(seed, rid, epoch, "pswap").cast("double") / scale < F.lit(p_swap),
        "_di": F.when(n_drop > 0, drop_idx).otherwise(F.array().cast("array<bigint>")),
        "_s1": F.when(n > 0, F.pmod(TF.draw(seed, rid, epoch, "s1"), n)),
        "_s2": F.when(n > 0, F.pmod(TF.draw(seed, rid, epoch, "s2"), n)),
    })
    aug = TF.dropout_and_swap("_w", "_fd", "_fs", "_di", "_s1", "_s2")
    out = F.when(F.size("_w") > 4, F.array_join(aug, " ")).otherwise(F.col("text"))
    return df.withColumn("text", out).drop("_w", "_fd", "_fs", "_di", "_s1", "_s2")


def training_views(train: DataFrame, val: DataFrame, augment: bool = True, seed: int = DEFAULT_SEED,
                   id_col: str = "row_id", epoch: int = 0):
    """F8: (augmented train view, untouched validation view)."""
    t = augment_train_text(train, seed, id_col, epoch) if augment else train
    return t, val
