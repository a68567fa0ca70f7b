"""Toxicity by class-conditional Kneser-Ney language models.

Two character models of order ``ORDER``, of toxic and of ordinary documents,
read the text as words (case folded) between single spaces. For class c, an
n-gram ``g = h x`` with history ``h`` and suffix ``g'`` has the probability

    P_c(x | h) = (max(a_c(g) - D, 0) + D N_c(h .) P_c(g')) / a_c(h .)

where ``a_c`` counts documents at the highest order (an n-gram's repetitions in
a text count once, copies of a text each count with their own label) and
different left neighbours below it, and ``N_c(h .)`` different continuations. Below the
shortest n-grams both classes back off to the same distribution, of their
counts together. Likewise an n-gram whose class counts do not depart from what
its suffix lets expect (G-test under ``G_LEAST``; how n-gram models are pruned
by relative entropy) is judged by its suffix, so a rare expression is smoothed
through counts that it shares with others, and one never seen tells nothing.
Being of characters, the models know an unseen form of a word by its parts.

A document's score is its log-likelihood under the toxic model less that under
the ordinary one, per character. The difference at a position is a sum of
terms, one per kept n-gram ending there, so it needs one table of (n-gram,
term). Counting covers every training document; tasks combine counts before
the shuffle. The terms go to the tasks in blocks of at most ``BLOCK_TERMS``;
each further block costs a scan. Training rows outside the counts turn scores
into probabilities by a logistic fit on at most ``FIT_ROWS`` of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polylabel.llm import common as C

ORDER = 5
D = 0.75
G_LEAST = 15.0
STRONG = 4.0  # nats from which a term alone counts as a sign
BLOCK_TERMS = 1_000_000
FIT_ROWS = 50_000
BROADCAST_BYTES = 64 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def stream(column) -> tuple[str, np.ndarray, np.ndarray]:
    """(characters, their code points, per-text offsets): every text's words,
    case folded, each led by a space, and a space after the last."""
    buf, offs = C.utf8(column)
    starts, ends, ptr = C.words(buf, offs, C.ALNUM_WIDE)
    n = ends - starts
    words_of = np.diff(ptr)
    text = np.repeat(np.arange(len(words_of)), words_of)
    # before a word: the spaces of the words up to it and of the texts ended
    some = np.cumsum(words_of > 0)
    at = np.cumsum(n) - n + np.arange(len(n)) + 1 + (some[text] - 1 if len(n) else 0)
    out = np.full(int(n.sum()) + len(n) + int((words_of > 0).sum()), 0x20, np.uint8)
    out[C.ranges(at, n)] = _FOLD[buf[C.ranges(starts, n)]]
    sizes = np.zeros(len(words_of), np.int64)
    np.add.at(sizes, text, n + 1)
    sizes += words_of > 0
    chars = out.tobytes().decode("utf-8", "replace")
    cp = np.frombuffer(chars.encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    return chars, cp, heads[np.concatenate([[0], np.cumsum(sizes)])]


def grams(cp: np.ndarray, ptr: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the n-grams inside the texts."""
    h = C.rolling(C.mix(cp.astype(C.U64) + C.U64(1)), order)
    at = np.flatnonzero(C.inside(ptr, order, len(h)))
    return at, h[at]


def _count(batches):
    for batch in C.chunks(batches):
        chars, cp, ptr = stream(batch.column(0))
        at, h = grams(cp, ptr, ORDER)
        doc = np.searchsorted(ptr, at, "right") - 1
        # each n-gram once per text; rows are never cut, so the layout tells nothing
        _, once = np.unique(C.mix(h + C.mix(doc.astype(C.U64))), return_index=True)
        at, h, label = at[once], h[once], batch.column(1).to_numpy()[doc[once]]
        _, first, of = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(of, minlength=len(first))
        toxic = np.bincount(of[label == 1], minlength=len(first))
        yield pa.RecordBatch.from_arrays(
            [pa.array([chars[i:i + ORDER] for i in at[first].tolist()], pa.string()), pa.array(n - toxic), pa.array(toxic)], ["g", "a0", "a1"])


def count_grams(rows: DataFrame) -> DataFrame:
    """(g, a0, a1): occurrences of every n-gram of the highest order in the
    ordinary and the toxic texts of ``rows`` (text, label)."""
    one = rows.select("text", F.col("label").cast("int").alias("label")).mapInArrow(_count, "g string, a0 bigint, a1 bigint")
    return one.groupBy("g").agg(F.sum("a0").alias("a0"), F.sum("a1").alias("a1"))


def _g(c0: Column, c1: Column, share: Column) -> Column:
    """G statistic of class counts against an expected toxic share."""
    n = c0 + c1
    part = lambda c, e: F.when(c > 0, c * F.log(c / e)).otherwise(0.0)
    return 2 * (part(c1, n * share) + part(c0, n * (1 - share)))


def terms(counts: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(g, value): the terms of the kept n-grams of every order, a term being
    what an n-gram's log ratio adds to its suffix's. None if a class has no
    n-grams."""
    levels = {ORDER: scratch.stage(counts, f"order{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        left = levels[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(
            *(F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in ("a0", "a1")))
        levels[k] = scratch.stage(left, f"order{k}")
    kept, below = None, None
    for k in range(1, ORDER + 1):
        total = levels[k].agg(F.sum("a0").alias("t0"), F.sum("a1").alias("t1"), F.count(F.lit(1)).alias("v")).first()
        t0, t1 = float(total.t0 or 0), float(total.t1 or 0)
        if not t0 or not t1:
            return levels[k].filter("false").select("g", F.lit(0.0).alias("value"))
        t = levels[k].withColumn("h", F.substring("g", 1, k - 1)).withColumn("s", F.substring("g", 2, k - 1))
        if k == 1:
            both = (F.col("a0") + F.col("a1") + 0.5) / (t0 + t1 + 0.5 * total.v)
            t = t.withColumn("q0", both).withColumn("q1", both).withColumn("low", F.lit(0.0))
        else:
            t = t.join(below.select(F.col("g").alias("s"), F.col("p0").alias("q0"), F.col("p1").alias("q1"), F.col("ratio").alias("low")), "s")
        hist = levels[k].groupBy(F.substring("g", 1, k - 1).alias("h")).agg(
            F.sum("a0").alias("r0"), F.sum("a1").alias("r1"), *(F.count(F.when(F.col(f"a{c}") > 0, 1)).alias(f"n{c}") for c in (0, 1)))
        t = t.join(hist, "h")
        prob = lambda c: F.when(F.col(f"r{c}") > 0, (F.greatest(F.col(f"a{c}") - D, F.lit(0.0)) + D * F.col(f"n{c}") * F.col(f"q{c}"))
                                / F.col(f"r{c}")).otherwise(F.col(f"q{c}"))
        share = 1 / (1 + F.exp(-F.col("low")) * (t0 / t1))
        t = (t.withColumn("p0", prob(0)).withColumn("p1", prob(1))
             .withColumn("tell", _g(F.col("a0").cast("double"), F.col("a1").cast("double"), share) >= G_LEAST)
             .withColumn("ratio", F.when(F.col("tell"), F.log(F.col("p1") / F.col("p0"))).otherwise(F.col("low"))))
        below = scratch.stage(t.select("g", "p0", "p1", "ratio", (F.col("ratio") - F.col("low")).alias("value"), "tell"), f"model{k}")
        own = below.filter("tell").select("g", "value")
        kept = own if kept is None else kept.unionByName(own)
    return scratch.stage(kept, "terms")


def _score(shared, kind: str):
    def run(batches):
        tables = shared.value
        for batch in C.chunks(batches):
            _, cp, ptr = stream(batch.column(1))
            total, strong = np.zeros(len(batch)), np.zeros(len(batch))
            for order, look, values in tables:
                at, h = grams(cp, ptr, order)
                hit, k = look.find(h)
                doc = np.searchsorted(ptr, at[hit], "right") - 1
                total += np.bincount(doc, values[k], len(batch))
                strong += np.bincount(doc, np.maximum(values[k] - STRONG, 0), len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.diff(ptr)), pa.array(total), pa.array(strong)], ["id", "text_key", "size", "llr", "strong"])
    return run


def _tables(rows: pa.Table) -> list:
    """Lookups of a block of terms, by order."""
    by: dict[int, list] = {}
    for g, v in zip(rows.column("g").to_pylist(), rows.column("value").to_pylist()):
        by.setdefault(len(g), []).append((g, v))
    out = []
    for order, own in sorted(by.items()):
        cp = np.frombuffer("".join(g for g, _ in own).encode("utf-32-le"), np.uint32)
        key = C.rolling(C.mix(cp.astype(C.U64) + C.U64(1)), order)[::order]
        at = np.argsort(key)
        out.append((order, C.Lookup(key), np.array([v for _, v in own])[at]))
    return out


def log_ratios(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, size, llr, strong) per distinct row of (id, text): the
    toxic less the ordinary log-likelihood, the characters that it is the sum
    over, and the sum of what single terms have above ``STRONG``."""
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    kind = src.schema["id"].dataType.simpleString()
    blocks = max(1, -(-kept.count() // BLOCK_TERMS))
    out = None
    for i in range(blocks):
        rows = kept.filter(F.pmod(F.xxhash64("g"), F.lit(blocks)) == i).toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(_tables(rows))
        part = (src.select("id", "text", "text_key").mapInArrow(_score(shared, kind), f"id {kind}, text_key bigint, size bigint, llr double, strong double")
                .groupBy("id", "text_key").agg(*(F.max(c).alias(c) for c in ("size", "llr", "strong"))))
        out = part if out is None else out.unionByName(part)
    return out if blocks == 1 else out.groupBy("id", "text_key").agg(
        F.max("size").alias("size"), F.sum("llr").alias("llr"), F.sum("strong").alias("strong"))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients and intercept (last) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    ridge = l2 * np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _inputs() -> list[Column]:
    """Inputs of the logistic fit: the log-likelihood ratio per character, its
    signed root (so that a mild rate already counts), the same by the root of
    the length, and likewise the strong terms."""
    n = F.greatest(F.col("size"), F.lit(1)).cast("double")
    per, strong = F.col("llr") / n, F.col("strong") / n
    return [per, F.signum(per) * F.sqrt(F.abs(per)), F.col("llr") / F.sqrt(n), F.sqrt(strong), F.log1p("strong")]


def label_rows(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(id, label): one row per labelled id; rows with a null id or a label
    other than 0 and 1 are left out, and of an id's labels the largest counts."""
    return (labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
            .groupBy(F.col(id_col).alias("_label_id")).agg(F.max(label).cast("int").alias("label")))


def with_label(df: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """Join labels onto rows that carry texts: by broadcast while the label
    rows are proven to fit ``BROADCAST_BYTES``, else by a shuffle join."""
    small = rows.count() * 32 <= BROADCAST_BYTES
    return df.join(F.broadcast(rows) if small else rows, df[id_col] == rows["_label_id"]).drop("_label_id")


def toxicity(docs: DataFrame, labels: DataFrame, training: Column, calibration: Column, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per distinct (id, text) of ``docs``: the id, ``text_key`` (the
    text's ``xxhash64``), ``size`` (characters modelled), ``llr_per_char`` and
    ``score`` (0 to 1).

    ``training`` says, of the column ``_label_id``, which labelled ids may be
    learned from, and ``calibration`` which of these are kept out of the
    counts for the logistic fit. Null and empty texts and texts without words
    score as a ratio of 0. Repeated rows give one row, an id with two texts a
    row for each. If the labels lack a class there is nothing to compare: all
    ratios are 0, and all scores the smoothed share of toxic labels. Extra
    columns of either table are ignored."""
    scratch = C.Scratch(docs.sparkSession, "toxicity")
    known = scratch.stage(label_rows(labels, label_col).filter(training), "labels")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = count_grams(with_label(src, known.filter(~calibration), "id"))
    scored = scratch.stage(log_ratios(docs, terms(counts, scratch), id_col, text_col), "scored")
    fit = (scored.join(known.filter(calibration), F.col("id") == F.col("_label_id"))
           .orderBy(F.xxhash64("id", "text_key"), "id").limit(FIT_ROWS).select(*(c.alias(f"x{i}") for i, c in enumerate(_inputs())), "label"))
    rows = fit.toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = np.column_stack([rows.column(f"x{i}").to_numpy() for i in range(len(_inputs()))]) if len(y) else np.zeros((0, len(_inputs())))
    if len(y) and 0 < y.sum() < len(y):
        b = fit_logistic(x, y)
    else:
        share = known.agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")).first()
        p = ((share.t or 0) + 0.5) / (share.n + 1)
        b = np.array([0.0, 1.0, 0.0, 0.0, 0.0, np.log(p / (1 - p))])
    z = sum((c * float(v) for c, v in zip(_inputs(), b)), F.lit(float(b[-1])))
    return scored.select(F.col("id").alias(id_col), "text_key", "size", _inputs()[0].alias("llr_per_char"),
                         (1 / (1 + F.exp(-z))).alias("score"))


def fold(column: str, parts: int) -> Column:
    """The remainder of the id's CRC-32 (of its decimal text)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def standard(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``toxicity`` with the usual folds: labels are learned from ids whose
    CRC-32 leaves a remainder other than 2 by 4, a fifth of them calibrating."""
    return toxicity(docs, labels, fold("_label_id", 4) != 2, F.floor(F.crc32(F.col("_label_id").cast("string").cast("binary")) / 4) % 5 == 0)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, columns
    unchanged."""
    bad = standard(docs, labels).filter(F.col("score") >= threshold).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["_key"]), "left_anti")
