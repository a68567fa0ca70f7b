"""N-gram Jaccard join: components of documents whose sets of word shingles
have a Jaccard similarity of at least 0.8, by token-combination prefixes.

A document's tokens are its distinct shingles. Any two linked documents share
at least ``ceil(0.8 n)`` of either one's ``n`` tokens, so a prefix of
``floor(0.2 n) + 1`` tokens in one global order must meet. The order puts rare
tokens first. Where a prefix needs tokens of the frequent class, a single
frequent token would give huge buckets, so that class is indexed by
combinations of two: it is dealt into subclasses by hash, the prefix is
extended until the tokens it holds, less one for each subclass it touches,
reach ``floor(0.2 n) + 1`` (a pair that shared at most one token of each
subclass and no rare one would miss too many), and every two prefix tokens of
one subclass form a key. The number of subclasses depends on the size band of
the smaller document, so a document is indexed for its own band and, where a
smaller partner can lie in it, for the band below.

Token counts come from all documents: tasks send sorted blocks of hashed
tokens, combined per block, to hash ranges that add them up. The frequent class
is the tokens with more than ``FREQUENT`` documents, at most ``MAX_FREQUENT``
of them, the most frequent first; as the result does not depend on the class,
that bound (which makes the class small enough to send to every task) only
affects speed. Documents with equal sets are one node, so copies cost no
pairs. Rare prefix tokens that no other node's prefix holds are missing from
every partner whose prefix ends no earlier in the order, which bounds what a
node can share with these (``room``). Candidates that pass are verified exactly and joined into components in ``pairs``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polylabel.llm import common as C
from polylabel.llm import pairs

FREQUENT = 32
MAX_FREQUENT = 1 << 20


def shingle_sets(column, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted unique token hashes, tokens per text). Fewer than ``k`` words
    make one token, no words none."""
    buf, offs = C.utf8(column)
    starts, ends, ptr = C.words(buf, offs, C.NON_SPACE)
    h = C.span_hash(C.prefix_hash(buf, C.FOLDED), starts, ends)
    s = C.rolling(h, k)
    out, counts = [], np.zeros(len(offs) - 1, np.int64)
    for i, (a, b) in enumerate(zip(ptr[:-1].tolist(), ptr[1:].tolist())):
        if b - a >= k:
            t = np.sort(s[a:b - k + 1])
            t = t[np.concatenate([[True], t[1:] != t[:-1]])]
        elif b > a:
            t = C.rolling(h[a:b], b - a)
        else:
            continue
        out.append(t)
        counts[i] = len(t)
    return (np.concatenate(out) if out else np.zeros(0, C.U64)), counts


def _signature(k: int):
    def run(batches):
        for batch in C.chunks(batches, max_bytes=C.SET_BYTES):
            t, n = shingle_sets(batch.column(1), k)
            at = np.concatenate([[0], np.cumsum(n)])
            sums = []
            for salt in (0, 0xA5A5A5A55A5A5A5A):
                c = np.concatenate([np.zeros(1, C.U64), np.cumsum(C.mix(t ^ C.U64(salt)), dtype=C.U64)])
                sums.append(pa.array((c[at[1:]] - c[at[:-1]]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *sums], ["node", "n", "s1", "s2"])
    return run


def _first_of_each(t: np.ndarray, n: np.ndarray):
    """(row, tokens) of the rows of a chunk, equal sets once."""
    at, seen = np.concatenate([[0], np.cumsum(n)]), set()
    for i in range(len(n)):
        own = t[at[i]:at[i + 1]]
        if len(own) and (key := own.tobytes() if len(own) < 64 else hash(own.tobytes())) not in seen:
            seen.add(key)
            yield i, own


def _token_blocks(k: int, parts: int):
    def run(batches):
        for batch in C.chunks(batches):
            own = [x for _, x in _first_of_each(*shingle_sets(batch.column(1), k))]
            if own:
                yield pairs.blocks(np.concatenate(own), parts)
    return run


def frequent_tokens(src: DataFrame, total: int, k: int, scratch: C.Scratch):
    """(parts, tokens, counts): the frequent class, tokens ascending."""
    parts = pairs.parts_for(total)
    counts = scratch.stage(pairs.more_than(src.mapInArrow(_token_blocks(k, parts), pairs.BLOCK_SCHEMA), FREQUENT), "counts")
    level = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    held, floor = 0, None
    for lv, c in steps:  # the most frequent levels that fit
        if held + c > MAX_FREQUENT:
            break
        held, floor = held + c, lv
    if floor is None:
        return parts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.filter(level >= floor).sort("token").toArrow()
    return parts, rows.column("token").to_numpy(), rows.column("n").to_numpy()


def _subclasses(band: int) -> int:
    return max(1, (1 << band) // 8)


def prefix_keys(rare: np.ndarray, frequent: np.ndarray, n: int) -> np.ndarray:
    """Keys of one document: ``rare`` and ``frequent`` are its tokens in the
    global order, ``n`` their number. Keys of single tokens are odd, those of
    combinations even."""
    need = n // 5 + 1
    one = C.mix(rare[:need]) | C.U64(1)
    if len(rare) >= need:
        return one
    keys = [one]
    band = n.bit_length() - 1
    bands = [band] + [band - 1] * (band > 0 and -(-4 * n // 5) < 1 << band)
    for b in bands:
        g = C.mix(frequent ^ C.U64(0x5BD1E995)) % C.U64(_subclasses(b))
        order = np.argsort(g, kind="stable")
        head = np.ones(len(g), bool)
        head[1:] = g[order][1:] != g[order][:-1]
        new = np.empty(len(g), bool)
        new[order] = ~head  # not the first of its subclass: counts towards the need
        reach = np.flatnonzero(np.cumsum(new) >= need - len(rare))
        if not len(reach):
            continue  # one token only: a similar set is an equal set
        stop = reach[0] + 1
        chosen, cls = frequent[:stop], g[:stop]
        for c in np.unique(cls):
            own = np.sort(chosen[cls == c])
            i, j = np.triu_indices(len(own), 1)
            keys.append(C.mix(own[i] * C.U64(0x9E3779B97F4A7C15) + C.mix(own[j]) + C.U64(b)) & ~C.U64(1))
    return np.unique(np.concatenate(keys))


def _prefixes(k: int, shared):
    def run(batches):
        parts, tokens, counts = shared.value
        bits = C.U64(64 - 32 - (parts.bit_length() - 1))
        for batch in C.chunks(batches, max_bytes=C.SET_BYTES):
            t, n = shingle_sets(batch.column(1), k)
            count = np.zeros(len(t), np.int64)
            if len(tokens):
                own = (t >> bits).view(np.int64)
                at = np.searchsorted(tokens, own)
                at[at == len(tokens)] = 0
                count = np.where(tokens[at] == own, counts[at], 0)
            ptr = np.concatenate([[0], np.cumsum(n)])
            some = np.flatnonzero(n)
            keys, singles = [], np.zeros(len(some), np.int64)
            for i, (a, b) in enumerate(zip(ptr[some].tolist(), ptr[some + 1].tolist())):
                own, often = t[a:b], count[a:b] > 0
                if often.any():
                    # ascending by count; within a count by hash, as the stable sort keeps it
                    order = np.argsort(count[a:b][often], kind="stable")
                    rare = own[~often]
                    keys.append(prefix_keys(rare, own[often][order], b - a))
                    singles[i] = min(len(rare), (b - a) // 5 + 1)
                else:
                    keys.append(C.mix(own[:(b - a) // 5 + 1]) | C.U64(1))
                    singles[i] = len(keys[-1])
            flat = np.concatenate(keys) if keys else np.zeros(0, C.U64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.array(n[some]), pa.array(singles),
                 C.lists(flat.view(np.int64), [len(x) for x in keys], pa.int64())], ["node", "n", "singles", "keys"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """One row per input row: the id, ``n_shingles`` (distinct ``k``-word
    shingles) and ``component_id`` (the smallest id reachable over links, its
    own included).

    Words are runs between ASCII white space with A-Z lower-cased. Texts of
    fewer than ``k`` words have one shingle; null and empty texts and texts
    without words have none, link with nothing and are their own component.
    Rows with one id are one node; repeated rows each give a row. A row with a
    null id links with nothing and has a null component. Other columns are
    ignored. Ties need no rule, as components do not depend on an order."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "ngram-join")
    src = docs.select(F.col(id_col).alias("node"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["node"].dataType.simpleString()
    sets = lambda column: shingle_sets(column, k)
    own = scratch.stage(src.mapInArrow(_signature(k), f"node {kind}, n bigint, s1 bigint, s2 bigint"), "own")
    some = own.filter("n > 0 and node is not null")
    # equal sets: one node each, and their ids' rows
    rep = some.groupBy("n", "s1", "s2").agg(F.min("node").alias("rep"))
    of = scratch.stage(some.join(rep, ["n", "s1", "s2"]).select("node", "rep", "n").distinct(), "classes")

    parts, tokens, counts = frequent_tokens(src, int(own.agg(F.sum("n")).first()[0] or 0), k, scratch)
    shared = spark.sparkContext.broadcast((parts, tokens, counts))
    reps = of.select(F.col("rep").alias("node"), "n").distinct()
    prefixes = scratch.stage(
        src.filter("node is not null").mapInArrow(_prefixes(k, shared), f"node {kind}, n bigint, singles bigint, keys array<bigint>")
        .join(reps, ["node", "n"], "left_semi").distinct(), "prefixes")
    close = pairs.meeting_keys(prefixes, scratch)
    found = close.filter(F.col("key").bitwiseAND(F.lit(1)) == 1).groupBy("node").agg(F.count(F.lit(1)).alias("found"))
    info = prefixes.select("node", "n", "singles").join(found, "node", "left").select(
        "node", "n", (F.col("n") - F.col("singles") + F.coalesce("found", F.lit(0))).alias("room"))
    members = scratch.stage(close.join(info, "node"), "members")
    scratch.drop("prefixes", "close", "counts")
    comps = pairs.resolve(members, lambda nodes: src.join(nodes, "node", "left_semi"), sets, scratch)
    # an id with several texts ties their classes together
    ties = of.filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    whole = C.components(comps.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(ties), scratch)
    out = own.select(F.col("node").alias("_n"), F.col("n").alias("n_shingles")).join(
        whole.select(F.col("node").alias("_m"), "component"), F.col("_n") == F.col("_m"), "left")
    return out.select(F.col("_n").alias(id_col), "n_shingles", F.coalesce("component", "_n").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of its
    component, columns unchanged. Rows that share the kept id all stay, as do
    rows with a null id."""
    drop = near_duplicates(docs, id_col, text_col, k).filter(F.col("component_id") != F.col(id_col)).select(
        F.col(id_col).alias("_gone")).distinct()
    left = docs.join(drop, docs[id_col] == drop["_gone"], "left_anti")
    return left
