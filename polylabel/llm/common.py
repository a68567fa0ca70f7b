"""Shared helpers of the llm operators.

Three groups: Arrow text chunks and vectorised word hashing (used inside
``mapInArrow`` tasks), staged Parquet tables in the session's shared folder,
and distributed connected components.

Text never crosses a task whole: tasks see Arrow batches, which ``chunks``
cuts at row boundaries into slices of about ``CHUNK_BYTES`` so that the numpy
work arrays stay small; a single longer text forms a slice of its own.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polylabel.session import ensure_checkpoint_dir

CHUNK_BYTES = 2 << 20
SET_BYTES = 512 << 10  # of text whose sets of hashes are made at a time, a quarter of the work arrays
U64 = np.uint64


# ------------------------------------------------------------------ Arrow text

def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty. Zero copy unless
    the column has nulls."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1]
    offsets = offsets.astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batches, column: str = "text", max_bytes: int = CHUNK_BYTES):
    """Cut Arrow batches at row boundaries into slices of at most
    ``max_bytes`` of text (a longer row is a slice of its own)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        _, offs = utf8(col)
        row, n = 0, len(col)
        while row < n:
            end = int(np.searchsorted(offs, offs[row] + max_bytes, "right")) - 1
            end = min(n, max(end, row + 1))
            yield batch.slice(row, end - row)
            row = end


def byte_table(members: bytes) -> np.ndarray:
    """256 booleans, true at the given byte values."""
    t = np.zeros(256, bool)
    t[np.frombuffer(members, np.uint8)] = True
    return t


# Words between ASCII white space: every byte but space, tab, LF, VT, FF, CR.
NON_SPACE = ~byte_table(bytes([0x20, *range(0x09, 0x0E)]))
# Words of ASCII digits, ASCII letters and every non-ASCII character.
ALNUM_WIDE = byte_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """(starts, ends, ptr): byte spans of the maximal runs of ``table`` bytes
    inside each text; texts' words are ``ptr[i]:ptr[i + 1]``. The delimiters
    of every table here are ASCII, so UTF-8 bytes give the same words as code
    points."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = table[buf]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    lo, hi = offs[:-1][offs[:-1] < offs[1:]], offs[1:][offs[:-1] < offs[1:]] - 1
    first[lo] = w[lo]
    last[hi] = w[hi]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


# ------------------------------------------------------------------ hashing

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers = {"n": -1}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): a bijection, so it adds no collisions."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _pow(n: int):
    if _powers["n"] < n:
        n = max(n, CHUNK_BYTES + 4096)
        for k, base in (("p", _P), ("inv", _P_INV)):
            a = np.full(n + 1, base, U64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=U64)
        _powers["n"] = n
    return _powers["p"], _powers["inv"]


def _byte_values(fold: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019)) | U64(1)
    if fold:
        v[0x41:0x5B] = v[0x61:0x7B]
    return v


FOLDED, EXACT = _byte_values(True), _byte_values(False)


def prefix_hash(buf: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any byte span.
    With ``FOLDED`` values ASCII letters hash alike in either case."""
    p, _ = _pow(len(buf))
    c = np.empty(len(buf) + 1, U64)
    c[0] = 0
    np.cumsum(values[buf] * p[:len(buf)], out=c[1:])
    return c


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inv = _pow(len(c) - 1)
    h = (c[ends] - c[starts]) * inv[starts]
    return mix(h ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


def window_hash(c: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """``span_hash`` from each of ``bounds`` to the one ``k`` further on."""
    _, inv = _pow(len(c) - 1)
    at = c[bounds]
    h = at[k:] - at[:-k]
    h *= inv[bounds[:-k]]
    h ^= (bounds[k:] - bounds[:-k]).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(h)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive items of ``h`` (length ``len(h)-k+1``,
    none if shorter). Positions that cross a text's end are the caller's to
    leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    s, q = h[:n].copy(), 1
    for t in range(1, k):
        q = (q * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF | 1
        s += h[t:t + n] * U64(q)
    return mix(s + U64(k))


def inside(ptr: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the first ``n`` positions start ``k`` words of one text."""
    ok = np.ones(max(n, 0), bool)
    for t in range(1, k):
        at = ptr[1:-1] - t
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + count)``."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(np.asarray(starts, np.int64) - (np.cumsum(counts) - counts), counts)


class Lookup:
    """Sorted keys behind a bitmap of their low bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.mask = U64((1 << max(12, min(24, int(len(keys) * 16).bit_length()))) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(keys & self.mask).astype(np.int64)] = True

    def find(self, s: np.ndarray):
        """(positions in ``s``, index of the key) of the values that are keys."""
        if not len(self.keys):
            z = np.zeros(0, np.int64)
            return z, z
        at = np.flatnonzero(self.bits[(s & self.mask).astype(np.int64)])
        k = np.searchsorted(self.keys, s[at])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == s[at]
        return at[hit], k[hit]


SIEVE_BITS = 27  # a sieve has 16 MB at most


class Sieve:
    """Which of ``2 ** bits`` equal ranges of 64-bit hashes hold a hash of some
    set. It only spares work: a hash that it lets through need not be of the
    set, so an exact join follows."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def lets(self, h: np.ndarray) -> np.ndarray:
        cell = h.view(U64) >> U64(64 - self.bits)
        return (self.words[(cell >> U64(6)).view(np.int64)] >> (cell & U64(63))) & U64(1) != 0


def sieve(hashes: DataFrame, column, total: int) -> Sieve:
    """The sieve of a column of evenly spread hashes, about ``total`` of them.
    Words of 64 ranges are made by an aggregation, so what comes to the driver
    has a bound, however many hashes there are."""
    bits = min(max(16, int(total).bit_length() + 3), SIEVE_BITS)
    cells = hashes.select(F.shiftrightunsigned(column, 64 - bits).alias("cell"))
    rows = cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("ranges")).toArrow()
    words = np.zeros(1 << (bits - 6), U64)
    words[rows.column("word").to_numpy()] = rows.column("ranges").to_numpy().view(U64)
    return Sieve(words, bits)


def lists(values: np.ndarray, counts, kind) -> pa.Array:
    """A list column from flat values and per-row counts."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


# ------------------------------------------------------------------ staging

class Scratch:
    """Intermediate Parquet tables of one operator call, in the shared folder
    the session names in ``spark.checkpoint.dir`` (see
    ``session.ensure_checkpoint_dir``). A staged table cuts the lineage,
    survives a lost executor, and lets the shuffle files behind it go.
    ``drop`` deletes a table that nothing reads any more."""

    def __init__(self, spark, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.made = 0

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.mode("errorifexists").parquet(path)
        self.paths[name] = path
        # Shuffle files go when the driver's JVM collects the finished plan.
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# ------------------------------------------------------------------ components

def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table (a, b): one row (node, component)
    per node that has an edge, component being the smallest reachable node.

    Distributed union-find by alternating large-star and small-star steps:
    each round is two aggregations and two joins over the edges (with a hashed
    side that has each node once), staged in the shared folder, and the number of rounds is logarithmic in the longest
    chain. No edge list, component or neighbourhood is gathered anywhere; a
    node with very many neighbours only enters through a ``min`` (combined
    before the shuffle) and a join that the planner may split.
    """
    e = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = scratch.stage(e, "edges0")
    last = "edges0"
    # On a star forest (every b has one a, no a is a b) nothing changes.
    for k in range(1, max_rounds + 1):
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.max("up").alias("up"), F.sum("down").alias("down")).filter("down + up > 1 and down > 0").isEmpty():
            break
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(low.hint("shuffle_hash"), "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        low2 = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low2.hint("shuffle_hash"), "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        nxt = scratch.stage(small.filter("a <> b").distinct(), f"edges{k}")
        scratch.drop(last)
        e, last = nxt, f"edges{k}"
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
