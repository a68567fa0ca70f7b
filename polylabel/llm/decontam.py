"""Benchmark decontamination: which words of a document lie inside a passage
of a benchmark item, by a prefix-filtered set join.

A window is ``window`` consecutive words of an item (a shorter item is one
window). A window occurs in a document when all its words do, in order, so
the required overlap of its shingle set is total and the prefix that must be
joined is one shingle: the rarest one over all documents. Hence

1. the items' shingles (``SHINGLE`` words, fewer for shorter windows) are
   counted over all documents; a window with a shingle that no document has
   cannot occur and is left out;
2. each remaining window is indexed by its rarest shingle only;
3. a document's shingles are looked up; a match fixes where the window would
   start, and length and position bounds drop those that do not fit;
4. the words of the remaining item-sized windows are compared one by one.

The index is read in blocks of ``BLOCK_KEYS`` keys or ``BLOCK_WINDOWS``
windows, so what tasks receive is bounded however large the benchmark is;
each further block costs one more scan of the documents, and results of
blocks are merged per document. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polylabel.llm import common as C

SHINGLE = 3
BLOCK_KEYS = 2_000_000
BLOCK_WINDOWS = 200_000


def _doc_words(batch, table=C.ALNUM_WIDE):
    buf, offs = C.utf8(batch.column(1))
    starts, ends, ptr = C.words(buf, offs, table)
    return C.span_hash(C.prefix_hash(buf, C.FOLDED), starts, ends), ptr


def _windows(window: int):
    def run(batches):
        for batch in C.chunks(batches):
            h, ptr = _doc_words(batch)
            ids, lens, hashes, counts = [], [], [], []
            for i in range(len(batch)):
                own = h[ptr[i]:ptr[i + 1]]
                if not len(own):
                    continue
                k = min(window, len(own))
                view = np.lib.stride_tricks.sliding_window_view(own, k)
                ids.extend([i] * len(view))
                lens.extend([k] * len(view))
                hashes.append(view.astype(np.int64, copy=False).reshape(-1) if view.dtype == np.int64
                              else np.ascontiguousarray(view).view(np.int64).reshape(-1))
                counts.extend([k] * len(view))
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), C.lists(flat, counts, pa.int64())], ["item_id", "words"])
    return run


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """(item_id, words): every distinct window of every item, ``words`` being
    the hashes of its words. Items without words have none."""
    kind = items.schema[id_col].dataType.simpleString()
    src = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_windows(window), f"item_id {kind}, words array<bigint>").distinct()


def _shingles(words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window row, offset, hash) of each shingle; ``words`` is a matrix padded
    with zeros, ``lens`` the windows' lengths."""
    rows, offs, keys = [], [], []
    for size in np.unique(np.minimum(lens, SHINGLE)):
        own = np.flatnonzero(np.minimum(lens, SHINGLE) == size)
        for o in range(words.shape[1] - size + 1):
            fit = own[lens[own] >= o + size]
            if len(fit):
                part = words[fit, o:o + size]
                s = part[:, 0].copy()
                q = 1
                for t in range(1, size):
                    q = (q * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF | 1
                    s += part[:, t] * C.U64(q)
                rows.append(fit)
                offs.append(np.full(len(fit), o))
                keys.append(C.mix(s + C.U64(size)))
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, C.U64)
    return np.concatenate(rows), np.concatenate(offs), np.concatenate(keys)


def _matrix(lists_) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(x) for x in lists_], np.int64)
    m = np.zeros((len(lens), max(1, int(lens.max(initial=1)))), np.int64)
    for i, x in enumerate(lists_):
        m[i, :len(x)] = x
    return m.view(C.U64), lens


def _count(shared):
    def run(batches):
        sizes, keys = shared.value
        look = C.Lookup(keys)
        total = np.zeros(len(look.keys), np.int64)
        for batch in C.chunks(batches):
            h, ptr = _doc_words(batch)
            for size in sizes:
                s = C.rolling(h, size)
                at, k = look.find(s)
                ok = C.inside(ptr, size, len(s))[at]
                total += np.bincount(k[ok], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(look.keys[some].view(np.int64)), pa.array(total[some])], ["key", "n"])
    return run


def _match(shared):
    def run(batches):
        words, lens, wid, look, ptr_w, win, off, sizes = shared.value
        for batch in C.chunks(batches):
            h, ptr = _doc_words(batch)
            found, begin = [], []
            for size in sizes:
                s = C.rolling(h, size)
                at, k = look.find(s)
                n = ptr_w[k + 1] - ptr_w[k]
                e = C.ranges(ptr_w[k], n)
                w, start = win[e], np.repeat(at, n) - off[e]
                doc = np.searchsorted(ptr, np.repeat(at, n), "right") - 1
                # length and position: the whole window inside the document
                ok = (start >= ptr[doc]) & (start + lens[w] <= ptr[doc + 1])
                w, start = w[ok], start[ok]
                for t in range(words.shape[1]):
                    ok = (lens[w] <= t) | (h[np.minimum(start + t, max(len(h) - 1, 0))] == words[w, t])
                    w, start = w[ok], start[ok]
                found.append(w)
                begin.append(start)
            w = np.concatenate(found) if found else np.zeros(0, np.int64)
            start = np.concatenate(begin) if begin else w
            doc = np.searchsorted(ptr, start, "right") - 1
            mark = np.zeros(len(h) + 1, np.int64)
            np.add.at(mark, start, 1)
            np.add.at(mark, start + lens[w], -1)
            inside = np.cumsum(mark[:-1]) > 0
            # intervals of hit words, cut at document borders
            edge = inside.copy()
            edge[1:] &= ~inside[:-1]
            heads = ptr[:-1][ptr[:-1] < ptr[1:]]
            edge[heads] = inside[heads]
            tail = inside.copy()
            tail[:-1] &= ~inside[1:]
            tails = ptr[1:][ptr[:-1] < ptr[1:]] - 1
            tail[tails] = inside[tails]
            lo, hi = np.flatnonzero(edge), np.flatnonzero(tail) + 1
            of = np.searchsorted(ptr, lo, "right") - 1
            n_int = np.bincount(of, minlength=len(batch))
            pairs = np.unique(np.stack([doc, w]), axis=1) if len(w) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.diff(ptr)),
                 C.lists(lo - ptr[of], n_int, pa.int64()), C.lists(hi - ptr[of], n_int, pa.int64()),
                 C.lists(wid[pairs[1]], np.bincount(pairs[0], minlength=len(batch)), pa.int64())],
                ["doc_id", "text_key", "n_words", "lo", "hi", "wids"])
    return run


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """One row per distinct (id, text) of ``docs``: the id, ``text_key`` (a
    64-bit hash of the text), ``n_words``, ``n_hit`` (words inside an
    occurrence of any item's window), ``spans`` (array of struct(lo, hi): the
    hit words as merged half-open word ranges), ``item_ids`` (items with an
    occurring window, sorted as strings) and ``contaminated``.

    Null or empty texts, and texts without words, have no words and no hits;
    items without words have no windows; an empty benchmark hits nothing.
    Repeated rows give one row; one id with two texts gives a row for each.
    Other columns of either input are ignored."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "decontam")
    sc = spark.sparkContext
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.xxhash64(F.col(text_col).cast("string")).alias("text_key"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    owned = scratch.stage(
        benchmark_windows(items, item_id_col, item_text_col, window)
        .select("item_id", "words", F.xxhash64("words").alias("wid")), "windows")
    distinct = owned.groupBy("wid").agg(F.first("words").alias("words"))
    n_windows = distinct.count()
    n_blocks = -(-n_windows // BLOCK_WINDOWS)
    per_scan = max(1, BLOCK_KEYS // (BLOCK_WINDOWS * window))

    # 1. how often each shingle of a window occurs in the documents
    def block(df, i, n):
        rows = df.filter(F.pmod(F.col("wid"), F.lit(n)) == i).toArrow()
        words_, lens = _matrix(rows.column("words").to_pylist())
        return rows.column("wid").to_numpy(), words_, lens

    counts = None
    for first in range(0, n_blocks, per_scan):
        sizes, keys = set(), []
        for i in range(first, min(n_blocks, first + per_scan)):
            _, words_, lens = block(distinct, i, n_blocks)
            keys.append(np.unique(_shingles(words_, lens)[2]))
            sizes |= {int(x) for x in np.unique(np.minimum(lens, SHINGLE))}
        shared = sc.broadcast((sorted(sizes), np.unique(np.concatenate(keys))))
        part = src.select("doc_id", "text").mapInArrow(_count(shared), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
        part = scratch.stage(part, f"counts{first}")
        counts = part if counts is None else counts.unionByName(part)
    # 2. the rarest shingle of each window that can occur
    blocks = []
    if counts is not None:
        index = scratch.stage(
            distinct.mapInArrow(_window_shingles, "wid bigint, words array<bigint>, off int, key bigint")
            .join(counts.groupBy("key").agg(F.max("n").alias("n")), "key", "left")
            .groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "off")).alias("rarest"),
                                F.first("words").alias("words"))
            .filter("rarest.n > 0").select("wid", "words", F.col("rarest.off").alias("off"), F.col("rarest.key").alias("key")),
            "index")
        n_index = index.count()
        blocks = [(index, i, -(-n_index // BLOCK_WINDOWS)) for i in range(-(-n_index // BLOCK_WINDOWS))]
    # 3. and 4. look up, bound, verify
    matched = None
    for df, i, n in blocks or [(None, 0, 1)]:
        if df is None:
            wid, words_, lens = np.zeros(0, np.int64), np.zeros((0, 1), C.U64), np.zeros(0, np.int64)
            key, off = np.zeros(0, C.U64), np.zeros(0, np.int64)
        else:
            rows = df.filter(F.pmod(F.col("wid"), F.lit(n)) == i).toArrow()
            words_, lens = _matrix(rows.column("words").to_pylist())
            wid, key, off = (rows.column(c).to_numpy() for c in ("wid", "key", "off"))
            key = key.view(C.U64)
        order = np.argsort(key, kind="stable")
        uniq, head = np.unique(key[order], return_index=True)
        shared = sc.broadcast((words_, lens, wid, C.Lookup(uniq), np.append(head, len(key)), order, off.astype(np.int64)[order],
                               sorted({int(x) for x in np.unique(np.minimum(lens, SHINGLE))})))
        part = src.select("doc_id", "text", "text_key").mapInArrow(
            _match(shared), f"doc_id {id_type}, text_key bigint, n_words bigint, lo array<bigint>, hi array<bigint>, wids array<bigint>")
        matched = part if matched is None else matched.unionByName(part)
    per_doc = scratch.stage(
        matched.groupBy("doc_id", "text_key").agg(
            F.max("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("lo", "hi")))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("wids"))).alias("wids")), "docs")
    hit = (per_doc.filter(F.size("wids") > 0).select("doc_id", "text_key", F.explode("wids").alias("wid"))
           .join(owned.select("wid", "item_id"), "wid")
           .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")))
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("bigint"), s["hi"] - F.greatest(a["to"], s["lo"]))).alias("n"),
                              F.greatest(a["to"], s["hi"]).alias("to")), lambda a: a["n"])
    left = per_doc.drop("wids").withColumn("n_hit", covered)
    out = left.join(hit.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key"),
                    F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key")), "left")
    return out.select(F.col("doc_id").alias(id_col), "text_key", "n_words", "n_hit", "spans",
                      F.coalesce("item_ids", F.array().cast(T.ArrayType(T.StringType()))).alias("item_ids"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def _window_shingles(batches):
    for batch in batches:
        if not len(batch):
            continue
        words_, lens = _matrix(batch.column(1).to_pylist())
        row, off, key = _shingles(words_, lens)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
             pa.array(off, pa.int32()), pa.array(key.view(np.int64))], ["wid", "words", "off", "key"])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows that hold an item's window, columns unchanged."""
    bad = contamination(docs, items, id_col, text_col, **kw).filter("contaminated").select(
        F.col(id_col).alias("_bad_id"), F.col("text_key").alias("_bad_key"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad_id"])
                     & (F.xxhash64(docs[text_col].cast("string")) == bad["_bad_key"]), "left_anti")
