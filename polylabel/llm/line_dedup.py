"""Fuzzy line deduplication: of every group of similar lines, over all
documents, one line stays.

Lines are compared as sets of character shingles (``CHARS`` code points; a
shorter line is one shingle), surrounding ASCII white space left aside; two
lines are alike at a Jaccard similarity of 0.8 or more. Equal lines are one
node, named by a 64-bit hash. Each distinct line gets ``BANDS * ROWS`` MinHash
values: by as many permutations, or, for lines of ``LONG`` shingles or more,
by one permutation in as many bins (lines a little shorter get both, so that
any two alike lines have one kind in common). ``BANDS`` keys of ``ROWS``
values lead alike lines to a common bucket (with 12 bands of 4, a pair at 0.8
is missed with probability 0.002, at 0.85 with 0.0002). Candidates are verified
exactly and joined by distributed union-find (``pairs``). A component's first
line, by document id and then position, stays; its other lines go.

Hot lines cost no pairs: the occurrences of a node only enter a ``min``
aggregation, and a join of narrow rows that the planner may split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polylabel.llm import common as C
from polylabel.llm import pairs

CHARS, BANDS, ROWS = 8, 12, 4
LONG = 96
SLICE = 256 << 10  # bytes of text worked on at a time, so that the work arrays stay in the processor's cache
WHITE = " \t\n\x0b\x0c\r"
_SEEDS = C.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MUL = _SEEDS[::2], _SEEDS[1::2] | C.U64(1)
_SPACE = ~C.NON_SPACE


def _lines(buf: np.ndarray, offs: np.ndarray):
    """(starts, ends, text, position) of every line of every text, trimmed of
    ASCII white space; a line of white space has equal start and end."""
    cut = np.flatnonzero(buf == 0x0A)
    text_of_cut = np.searchsorted(offs, cut, "right") - 1
    n = len(offs) - 1
    starts = np.concatenate([offs[:-1], cut + 1])
    ends = np.concatenate([offs[1:], cut])
    text = np.concatenate([np.arange(n), text_of_cut])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = ends[np.lexsort((ends, np.concatenate([np.arange(n), text_of_cut])))]
    first = np.searchsorted(text, np.arange(n))
    position = np.arange(len(text)) - first[text] if len(text) else text
    some = np.flatnonzero(ends > starts)
    if not (_SPACE[buf[starts[some]]] | _SPACE[buf[ends[some] - 1]]).any():
        return starts, ends, text, position
    # trim: the first and last non-space byte inside each line
    solid = np.flatnonzero(C.NON_SPACE[buf])
    if not len(solid):
        return starts, starts, text, position
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = hi > lo
    a = np.where(some, solid[np.minimum(lo, len(solid) - 1)], starts)
    b = np.where(some, solid[np.maximum(hi - 1, 0)] + 1, starts)
    return a, b, text, position


def _shingles(buf: np.ndarray, c: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(hashes, shingles per line) of non-empty byte spans; repeated shingles
    are not yet removed."""
    head = np.flatnonzero((buf & 0xC0) != 0x80)
    lo, hi = np.searchsorted(head, starts), np.searchsorted(head, ends)
    n = np.maximum(hi - lo - CHARS + 1, 1)
    bounds = np.append(head, len(buf))
    # every window of CHARS code points, lines or not; then each line's own
    if len(head) < CHARS:
        every = np.zeros(1, C.U64)
    else:
        every = C.window_hash(c, bounds, CHARS)
    h = every[np.minimum(C.ranges(lo, n), len(every) - 1)]
    short = hi - lo < CHARS
    h[(np.cumsum(n) - n)[short]] = C.span_hash(c, starts[short], ends[short])
    return h, n


def _sorted_sets(s: np.ndarray, n: np.ndarray, bits: int = 40):
    """(line, hash) of the distinct shingles of each line, by line and then by
    hash; of a hash the leading bits, which with the line tell it apart."""
    key = np.sort((np.repeat(np.arange(len(n), dtype=C.U64) << C.U64(bits), n)) | (s >> C.U64(64 - bits)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return (key >> C.U64(bits)).astype(np.int64), key & C.U64((1 << bits) - 1)


def line_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """(sorted unique shingle hashes, shingles per line) of a column of lines.
    Lines are sorted together, those that start within ``SLICE`` bytes at a
    time, so 46 bits of a hash are left beside a line's number."""
    buf, offs = C.utf8(column)
    some = np.flatnonzero(offs[:-1] < offs[1:])
    sizes, out = np.zeros(len(offs) - 1, np.int64), [np.zeros(0, C.U64)]
    starts, ends = offs[:-1][some], offs[1:][some]
    cut = np.append(np.flatnonzero(np.diff(starts // SLICE, prepend=-1)), len(some))
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
        part = buf[starts[x]:ends[y - 1]]
        h, n = _shingles(part, C.prefix_hash(part, C.EXACT), starts[x:y] - starts[x], ends[x:y] - starts[x])
        line, t = _sorted_sets(h, n, 46)
        out.append(t)
        sizes[some[x:y]] = np.bincount(line, minlength=y - x)
    return np.concatenate(out), sizes


class _Recent:
    """Which hashes a task has not seen lately: a table with one place per
    low bits, so of lines that recur all the time nearly all go unseen again.
    It only spares work; equal lines are made one after the shuffle."""

    def __init__(self, bits: int = 18):
        self.mask = C.U64((1 << bits) - 1)
        self.seen = ~np.arange(1 << bits, dtype=C.U64)  # no hash of that place

    def new(self, h: np.ndarray) -> np.ndarray:
        at = (h & self.mask).astype(np.int64)
        new = self.seen[at] != h
        self.seen[at] = h
        return new


def _hashed(batch, column: int):
    buf, offs = C.utf8(batch.column(column))
    a, b, text, position = _lines(buf, offs)
    c = C.prefix_hash(buf, C.EXACT)
    h = np.where(b > a, C.span_hash(c, a, b), C.U64(0))
    return buf, c, a, b, text, position, h


def _distinct(a, b, h, recent: _Recent):
    """Spans and hashes of a chunk's distinct non-empty lines, less those that
    the task has seen lately."""
    keep = np.flatnonzero(b > a)
    _, first = np.unique(h[keep], return_index=True)
    keep = keep[first]
    keep = keep[recent.new(h[keep])]
    return a[keep], b[keep], h[keep]


def _min_hashes(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``BANDS * ROWS`` minima of independent permutations, line by line."""
    at = np.cumsum(n) - n
    return np.stack([np.minimum.reduceat((s ^ _XOR[r]) * _MUL[r], at) for r in range(BANDS * ROWS)], axis=1)


def _bin_minima(line: np.ndarray, s: np.ndarray, lines: int) -> np.ndarray:
    """One-permutation signatures: the least hash in each of ``BANDS * ROWS``
    bins of equal width, which is the first one there, as hashes come sorted; an
    empty bin takes the next filled one's, with the distance mixed in."""
    bins = BANDS * ROWS
    cell = line * bins + (((s >> C.U64(8)) * C.U64(bins)) >> C.U64(32)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    where, least = cell[first], s[first]
    out = np.zeros(lines * bins, C.U64)
    filled = np.zeros(lines * bins, bool)
    out[where], filled[where] = least, True
    empty = np.flatnonzero(~filled)
    own = empty // bins
    # the next filled bin of the line, or else its first one, a turn further on
    begin = np.searchsorted(where, own * bins)
    after = np.searchsorted(where, empty)
    around = np.append(where, -1)[after] // bins != own
    after[around] = begin[around]
    far = where[after] - empty + np.where(around, bins, 0)
    out[empty] = least[after] + far.astype(C.U64) * C.U64(0xD6E8FEB86659FD93)
    return C.mix(out).reshape(lines, bins)


def _band_keys(signature: np.ndarray, kind: int) -> np.ndarray:
    signature = signature.reshape(-1, BANDS, ROWS)
    keys = np.arange(kind * BANDS, (kind + 1) * BANDS, dtype=C.U64)
    for r in range(ROWS):
        keys = C.mix(keys * C.U64(0x9E3779B97F4A7C15) + signature[:, :, r])
    return keys


BAND_COLUMNS = ["node", "kind", "n", *(f"key{k}" for k in range(BANDS))]


def _bands(batches):
    recent = _Recent()
    for batch in C.chunks(batches, max_bytes=SLICE):
        buf, c, a, b, _, _, h = _hashed(batch, 0)
        a, b, h = _distinct(a, b, h, recent)
        if not len(a):
            continue
        s, n = _shingles(buf, c, a, b)
        line, least = _sorted_sets(s, n)
        size = np.bincount(line, minlength=len(a))
        at = np.cumsum(n) - n
        row, keys, kinds = [], [], []
        # a pair whose larger line is long has both in the second kind, else both in the first
        for kind, own in ((0, size < LONG), (1, size * 100 >= LONG * pairs.PERCENT)):
            own = np.flatnonzero(own)
            if len(own):
                if kind:
                    begin = np.cumsum(size) - size
                    signature = _bin_minima(np.repeat(np.arange(len(own)), size[own]), least[C.ranges(begin[own], size[own])], len(own))
                else:
                    signature = _min_hashes(s[C.ranges(at[own], n[own])], n[own])
                row.append(own)
                keys.append(_band_keys(signature, kind))
                kinds.append(np.full(len(own), kind))
        row, keys = np.concatenate(row), np.concatenate(keys).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (h[row].view(np.int64), np.concatenate(kinds), size[row], *np.ascontiguousarray(keys.T))], BAND_COLUMNS)


def _occurrences(wanted):
    """Every line's places; the first row of a wanted line that the task has
    not seen lately has the line's text too."""
    def run(batches):
        recent = _Recent()
        for batch in C.chunks(batches, max_bytes=SLICE):
            buf, _, a, b, text, position, h = _hashed(batch, 1)
            some = np.flatnonzero(b > a)
            a, size, h = a[some], (b - a)[some], h[some]
            asked = np.flatnonzero(wanted.value.lets(h))
            _, first = np.unique(h[asked], return_index=True)
            asked = asked[first]
            asked = asked[recent.new(h[asked])]
            given = np.zeros(len(some), bool)
            given[asked] = True
            size[~given] = 0
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            line = pa.StringArray.from_buffers(len(some), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[C.ranges(a, size)])),
                                               pa.py_buffer(np.packbits(given, bitorder="little")))
            rows = pa.array(text[some])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(position[some].astype(np.int32)), pa.array(h.view(np.int64)), line],
                ["id", "text_key", "pos", "node", "line"])
    return run


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, removed): for every document that loses lines, the
    positions (from 0) of those lines; ``text_key`` is the text's
    ``xxhash64``. See ``deduplicate`` for the cases."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "line-dedup")
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key")).filter("text is not null")
    kind = src.schema["id"].dataType.simpleString()
    only = src.select("text")

    # each task has left out what it saw, so rows meet once, after the shuffle; their keys
    # are plain columns, which are equal in all rows of a line and kind, and need no sort
    bands = only.mapInArrow(_bands, ", ".join(f"{c} bigint" for c in BAND_COLUMNS)).repartition("node")
    bands = scratch.stage(bands.groupBy("node", "kind").agg(*(F.min(c).alias(c) for c in BAND_COLUMNS[2:])), "bands")
    close = pairs.meeting_keys(bands.select("node", F.array(*BAND_COLUMNS[3:]).alias("keys")), scratch)
    # a line with keys of both kinds counts by its first row
    sizes = bands.filter((F.col("kind") == 0) | (F.col("n") >= LONG)).select("node", "n", F.col("n").alias("room"))
    members = scratch.stage(close.join(sizes, "node"), "members")
    scratch.drop("bands", "close")
    # few lines' texts are asked for: a sieve leaves most others out at once, the join the rest
    wanted = spark.sparkContext.broadcast(C.sieve(members, F.col("node"), members.count()))
    lines = scratch.stage(src.mapInArrow(_occurrences(wanted), f"id {kind}, text_key bigint, pos int, node bigint, line string"), "lines")

    def texts_of(nodes):
        texts = lines.filter("line is not null").select("node", "line")
        return texts.join(nodes.hint("shuffle_hash"), "node", "left_semi").groupBy("node").agg(F.min("line").alias("text"))

    comps = pairs.resolve(members, texts_of, line_sets, scratch)
    scratch.drop("members")
    # a repeated row repeats its places; a node matters that has several, or is alike to another
    place = F.struct("id", "text_key", "pos")
    name = F.xxhash64("id", "text_key", "pos")
    per_node = lines.groupBy("node").agg(F.min(name).alias("lo"), F.max(name).alias("hi")).join(comps.hint("shuffle_hash"), "node", "left")
    several = scratch.stage(per_node.filter("component is not null or lo <> hi").select("node", F.coalesce("component", "node").alias("component")), "several")
    alike = scratch.stage(lines.join(several.hint("shuffle_hash"), "node").select("component", "id", "text_key", "pos"), "alike")
    keepers = alike.groupBy("component").agg(F.min(place).alias("kept"))
    gone = alike.join(keepers.hint("shuffle_hash"), "component").filter(~place.eqNullSafe(F.col("kept")))
    out = scratch.stage(gone.groupBy("id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("removed")), "removed")
    scratch.drop("lines", "several", "alike")
    return out


def _applied(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, text, n, gone): each input row as one struct without its text, so
    that no column name can clash, with its new text, its number of lines and
    the positions of those that went."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row"), F.col(id_col).alias("id"), text.alias("text"),
                       F.xxhash64(text).alias("text_key"))
    gone = removed_lines(docs, id_col, text_col).select(F.col("id").alias("gone_id"), F.col("text_key").alias("gone_key"), "removed")
    # at most one row of positions per text, so the texts need no sort
    both = rows.join(gone.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left")
    lines = F.split("text", "\n", -1)
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    left = F.filter(lines, lambda _, i: ~F.array_contains(removed, i))
    return both.select("row", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
                       F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n"), removed.alias("gone"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every row, its text without the removed lines, and the
    columns ``n_lines`` and ``removed_lines`` (positions from 0) added.

    Lines are what "\\n" separates. Lines of white space only are never
    removed and not compared. Null texts stay null with no lines; an empty
    text is one empty line. Repeated rows (same id and text) are one document:
    each keeps the same lines. One id with two texts is two documents. A null
    id ranks before all others. Other columns, whatever their names, pass
    through (``n_lines`` and ``removed_lines`` are replaced)."""
    cols = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c)
            for c in docs.columns if c not in ("n_lines", "removed_lines")]
    return _applied(docs, id_col, text_col).select(*cols, F.col("n").alias("n_lines"), F.col("gone").alias("removed_lines"))


def shortened(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with its own columns only, texts as in ``deduplicate``. A
    document whose lines all went, or have only white space left, goes with
    them; one that lost no line stays as it is. A column ``length_col``, where
    there is one, follows a changed text. What stays of a copy of another
    document are the lines that differ from it."""
    changed = F.size("gone") > 0
    left = _applied(docs, id_col, text_col).filter(~changed | (F.rtrim(F.col("text"), F.lit(WHITE)) != ""))
    cols = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        k = docs.columns.index(length_col)
        cols[k] = F.when(changed, F.length("text").cast(kind)).otherwise(cols[k]).alias(length_col)
    return left.select(*cols)
