"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds the polynomial hash of each of its prefixes, modulo
the prime 2**31 - 1, once for each of two bases. A span's hash follows from the
two prefixes at its ends, so any two spans are compared in constant time, and
the longest common extension of two positions is found by binary search.

A fingerprint is what stays of these arrays: the length and hash of the text,
prefix hashes at multiples of a power of two (at most ``LADDER`` of them), the
hashes of the suffixes of the same lengths, and the ``SKETCH`` smallest distinct
hashes of its spans of ``SPAN`` code points. Two fingerprints show how far two
texts agree from their starts and from their ends (binary search over the
lengths that both hold), which answers for one edited passage, and the sketches
estimate the share of common spans, which answers for moved or scattered ones.
The likeness is the larger of both; it is 1 for equal texts.

Texts are worked on in slices of ``SLICE`` code points, so the arrays stay small
for any length. Bytes that are no UTF-8 are read as replacement characters.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polylabel.llm import common as C

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_812_433_253)
LADDER, SKETCH, SPAN, SLICE = 32, 32, 12, 1 << 18
_INVERSES = tuple(pow(b, -1, PRIME) for b in BASES)
_powers: dict[int, np.ndarray] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for 0 <= x < 2**62, without a division."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n, by doubling; kept for the next call."""
    have = _powers.get(base, np.ones(1, np.int64))
    while len(have) <= n:
        have = np.concatenate([have, _mod(have * pow(base, len(have), PRIME))])
    _powers[base] = have
    return have[:n + 1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def prefix_array(codes: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the prefixes of length 0 to n: the sum of (code + 1) * base ** i."""
    out = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(_mod((codes + 1) * powers(base, len(codes))[:-1]), out=out[1:])
    return _mod(out)


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each span, whatever its place."""
    return _mod(_mod(prefix[ends] - prefix[starts] + PRIME) * powers(_INVERSES[which], int(starts.max(initial=0)))[starts])


class Prefixes:
    """The prefix arrays of one text, for span equality and extensions."""

    def __init__(self, text: str):
        codes = code_points(text)
        self.n = len(codes)
        self.arrays = [prefix_array(codes, b) for b in BASES]

    def equal(self, i, other: Prefixes, j, length) -> np.ndarray:
        """Whether the spans of ``length`` code points from i here and from j
        in ``other`` are equal (arrays or numbers)."""
        i, j, length = (np.asarray(x, np.int64) for x in (i, j, length))
        return np.logical_and.reduce([span_hashes(a, i, i + length, k) == span_hashes(b, j, j + length, k)
                                      for k, (a, b) in enumerate(zip(self.arrays, other.arrays))])

    def extension(self, i, other: Prefixes, j, backward: bool = False) -> np.ndarray:
        """Length of the longest common extension from i here and j in
        ``other`` (of the spans that end there, if ``backward``), by binary
        search for all given positions at once."""
        i, j = np.broadcast_arrays(np.asarray(i, np.int64), np.asarray(j, np.int64))
        low = np.zeros(i.shape, np.int64)
        high = np.minimum(i, j) if backward else np.minimum(self.n - i, other.n - j)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(i - mid, other, j - mid, mid) if backward else self.equal(i, other, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


# ------------------------------------------------------------- fingerprints

def _step(n: int) -> int:
    return 1 << max(0, (-(-n // LADDER) - 1).bit_length())


def _smallest(h: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values."""
    few = np.unique(h if len(h) <= 4 * k else np.partition(h, 4 * k)[:4 * k])
    if len(few) < k and len(h) > 4 * k:
        few = np.unique(h)
    return few[:k]


def _scramble(h: np.ndarray) -> np.ndarray:
    return (C.mix(h.astype(C.U64)) >> C.U64(32)).astype(np.uint32)


def _undo(places: np.ndarray) -> np.ndarray:
    """The first base's inverse to the given powers."""
    if places.max(initial=0) <= SLICE:
        return powers(_INVERSES[0], int(places.max(initial=0)))[places]
    return np.array([pow(_INVERSES[0], int(p), PRIME) for p in places], np.int64)


def fingerprint(text: str) -> bytes:
    """The fingerprint of one text: (n, hash, step) and the ladders and the
    sketch, as bytes."""
    n, step = len(text), _step(len(text))
    rungs = np.arange(step, n + 1, step)
    places = np.unique(np.concatenate([rungs, n - rungs, [0, n]])).astype(np.int64)
    at_places, sketch, carry, second = np.zeros(len(places), np.int64), np.zeros(0, np.uint32), 0, 0
    for at in range(0, max(n, 1), SLICE):
        # SPAN - 1 code points of the next slice complete this one's last spans
        codes = code_points(text[at:at + SLICE + SPAN - 1])
        size = min(SLICE, n - at)
        shift, shift2 = (pow(b, at, PRIME) for b in BASES)
        prefix = prefix_array(codes, BASES[0])
        a, b = np.searchsorted(places, [at, at + size + (at + size == n)])
        at_places[a:b] = _mod(carry + _mod(prefix[places[a:b] - at] * shift))
        carry = (carry + int(prefix[size]) * shift) % PRIME
        second = (second + int(_mod((codes[:size] + 1) * powers(BASES[1], size)[:-1]).sum()) * shift2) % PRIME
        starts = np.arange(min(size, max(len(codes) - SPAN + 1, 0 if at else min(n, 1))))
        found = _smallest(_scramble(span_hashes(prefix, starts, np.minimum(starts + SPAN, len(codes)))), SKETCH)
        sketch = np.unique(np.concatenate([sketch, found]))[:SKETCH] if at else found
    prefixes = at_places[np.searchsorted(places, rungs)]
    back = at_places[np.searchsorted(places, n - rungs)]
    suffixes = _mod(_mod(at_places[-1] - back + PRIME) * _undo(n - rungs))
    cut = lambda h: (_scramble(h) >> np.uint32(8)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    full = int(at_places[-1]) << 31 | second
    return struct.pack("<QQB", n, full, len(rungs)) + cut(prefixes) + cut(suffixes) + sketch.astype("<u4").tobytes()


def _read(f: bytes):
    n, full, rungs = struct.unpack_from("<QQB", f)
    at = struct.calcsize("<QQB")
    three = lambda k: np.frombuffer(f, np.uint8, 3 * rungs, at + 3 * rungs * k).reshape(-1, 3)
    return n, full, three(0), three(1), np.frombuffer(f, "<u4", -1, at + 6 * rungs)


def _agreement(x: np.ndarray, y: np.ndarray, n: int, m: int) -> int:
    """The largest common rung up to which both ladders agree, by binary
    search: texts that agree up to a length agree up to each smaller one."""
    a, b = _step(n), _step(m)
    step = max(a, b)
    low, high = 0, min(n, m) // step
    while low < high:
        mid = (low + high + 1) // 2
        if (x[mid * step // a - 1] == y[mid * step // b - 1]).all():
            low = mid
        else:
            high = mid - 1
    return low * step


def likeness(f: bytes, g: bytes) -> float:
    """0 to 1 from two fingerprints alone; 1 for those of equal texts."""
    if f == g:
        return 1.0
    n, _, pre_n, suf_n, few_n = _read(f)
    m, _, pre_m, suf_m, few_m = _read(g)
    shared = min(_agreement(pre_n, pre_m, n, m) + _agreement(suf_n, suf_m, n, m), min(n, m))
    both = np.unique(np.concatenate([few_n, few_m]))[:SKETCH]
    common = len(np.intersect1d(both, np.intersect1d(few_n, few_m, assume_unique=True), assume_unique=True))
    return max(shared / max(n, m), common / len(both) if len(both) else 0.0)


# ---------------------------------------------------------------- operator

# Digests and fingerprints are staged as bytes, and written out at the end.
RESULT = "n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def spliced(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as
    many (or all) of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(text: str, f: bytes, following: str, g: bytes) -> tuple:
    edited = spliced(text, following)
    e = f if edited == text else fingerprint(edited)
    return len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest(), f, e, likeness(f, e), likeness(f, g)


def _texts(column: pa.Array):
    for v in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        yield (v.as_py() or b"").decode("utf-8", "replace")


def _chain(kind: pa.DataType):
    """Each row of a sorted partition against the next one. The last row has no
    next one here: it leaves with its text, and so does the first, which is
    the next one of the partition before."""
    names = ["id", "part", "first", "last", "text", *(c.split()[0] for c in RESULT.split(", "))]
    types = [kind, pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches):
        part, held, first, out = TaskContext.get().partitionId(), None, True, []
        for b in batches:
            for i, text in zip(b.column(0), _texts(b.column(1))):
                f = fingerprint(text)
                if held is not None:
                    out.append((held[0], part, first, False, held[1] if first else None, *_compare(held[1], held[2], text, f)))
                    first = False
                held = (i.as_py(), text, f)
                if len(out) >= 1000:
                    yield batch(out)
                    out = []
        if held is not None:
            out.append((held[0], part, first, True, held[1], len(held[1]), None, None, None, None, None))
            yield batch(out)
    return run


def _pairs(kind: pa.DataType):
    def run(batches):
        for b in batches:
            rows = []
            for i, text, following in zip(b.column(0), _texts(b.column(1)), _texts(b.column(2))):
                rows.append((i.as_py(), *_compare(text, fingerprint(text), following, fingerprint(following))))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:5]),
                 *(pa.array(c, pa.float64()) for c in cols[5:])], ["id", *(c.split()[0] for c in RESULT.split(", "))])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: C.Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, n_chars, the fingerprint, those of
    the text spliced with the next document's (``spliced``), and the likeness
    of the fingerprint to both. The next document is the one that follows by
    falling id; the first follows the last.

    Rows of one id are in the order of a hash of their texts, then of their
    texts; null ids come last; a null text is empty; equal rows follow one
    another. A table of one row has that row as its own next one; an empty
    table gives no rows. Columns other than these two are not read.

    Rows are dealt by ranges of (id, text hash), sorted inside the ranges, and
    streamed, so each text is shuffled once, and an id with very many texts is
    split. Only the first and the last text of each range, staged with the
    results, meet in a join."""
    spark = docs.sparkSession
    scratch = scratch or C.Scratch(spark, "fingerprints")
    kind = docs.schema[id_col].dataType.simpleString()
    arrow = pa.schema(spark.createDataFrame([], docs.select(F.col(id_col).alias("id")).schema).toArrow().schema).field("id").type
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    ranged = src.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    done = scratch.stage(ranged.mapInArrow(_chain(arrow), f"id {kind}, part bigint, first boolean, last boolean, text string, {RESULT}"), "ranges")
    # one row per range from here on
    heads = done.filter("first").select("part", F.col("text").alias("head"))
    every = Window.partitionBy(F.lit(0)).orderBy("part")
    after = heads.select("part", F.coalesce(F.lead("part").over(every), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("next"))
    ends = (done.filter("last").select("id", "part", "text").join(after, "part")
            .join(heads.withColumnRenamed("part", "next"), "next").select("id", "text", "head"))
    both = done.filter("not last").drop("part", "first", "last", "text").unionByName(ends.mapInArrow(_pairs(arrow), f"id {kind}, {RESULT}"))
    line = lambda c: F.translate(F.base64(c), "\r\n", "").alias(c)
    return both.select(F.col("id").alias(id_col), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), line("fingerprint"),
                       line("edited_fingerprint"), "near_edited", "near_next")


def extensions(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with ``common_prefix`` and ``common_suffix``: how many code
    points the two texts of each row share from the start and from the end,
    by binary search over their prefix arrays. Null texts are empty. Columns
    of these two names are replaced."""
    keep = [c for c in pairs.columns if c not in ("common_prefix", "common_suffix")]
    schema = pairs.select(*keep).schema.add("common_prefix", "long").add("common_suffix", "long")

    def run(batches):
        for b in batches:
            found = []
            for x, y in zip(_texts(b.column(keep.index(left))), _texts(b.column(keep.index(right)))):
                p, q = Prefixes(x), Prefixes(y)
                found.append((int(p.extension(0, q, 0)), int(p.extension(p.n, q, q.n, backward=True))))
            cols = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in cols)], [*keep, "common_prefix", "common_suffix"])
    return pairs.select(*keep).mapInArrow(run, schema)
