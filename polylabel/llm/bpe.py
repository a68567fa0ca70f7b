"""Byte-level BPE encoding and decoding with a public rank file.

Pre-tokenisation follows the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

without a regex engine. Every code point becomes a symbol: its class (letter,
number, other, white space) together with what the next code points show
(white space at the end of its run or not; an apostrophe that could open a
contraction). A symbol is a function on the eight states of the open token,
and such functions compose associatively: the text is cut into equal blocks,
every block's function is found by stepping all blocks and all start states at
once, the blocks' functions are composed to give each block's true start
state, and a second vectorised pass reads off where tokens begin. Text starts
are symbols that ignore the state, so many texts go through one scan.

The slices between boundaries are looked up in a bounded per-worker cache of
merged pieces; a miss runs the pair merges (heap and linked list, so a very
long slice costs n log n). Work is one pass over the rows without a shuffle.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polylabel.llm import common as C

CACHE_PIECES = 300_000
CACHE_BYTES = 32 << 20

# Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, OTHER, SPACE = range(4)
# Symbols: the classes with their surroundings. FIRST is added at a text's start.
L_, N_, O_, WS_MORE, SP_LAST, WS_LAST, APOS1, APOS2 = range(8)
FIRST = 8
# States: what the token open after a code point is.
IN_L, IN_N, IN_O, IN_WS, JOIN, CLOSED, TAKE1, TAKE2 = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a token) by symbol * 8 + state."""
    nxt, start = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for sym, run in ((L_, IN_L), (N_, IN_N), (O_, IN_O), (APOS1, TAKE1), (APOS2, TAKE2),
                     (WS_MORE, IN_WS), (SP_LAST, JOIN), (WS_LAST, CLOSED)):
        nxt[sym], nxt[sym + FIRST] = run, run
    for sym, run in ((L_, IN_L), (N_, IN_N), (O_, IN_O)):
        start[sym, [run, JOIN]] = False
    for sym in (APOS1, APOS2):  # inside a run of other signs, or after a space, it is a plain sign
        nxt[sym, [IN_O, JOIN]] = IN_O
        start[sym, [IN_O, JOIN]] = False
    start[WS_MORE, IN_WS] = False
    start[L_, [TAKE1, TAKE2]] = False
    nxt[L_, TAKE2], nxt[L_, TAKE1] = TAKE1, CLOSED
    return nxt.reshape(-1), start.reshape(-1)


NEXT, STARTS = _automaton()
_classes: list[np.ndarray] = []


def code_point_classes() -> np.ndarray:
    if not _classes:
        t = np.full(sys.maxunicode + 2, OTHER, np.uint8)
        for i in range(sys.maxunicode + 1):
            c = unicodedata.category(chr(i))[0]
            if c == "L" or c == "N":
                t[i] = LETTER if c == "L" else NUMBER
        t[WHITE_SPACE] = SPACE
        _classes.append(t)
    return _classes[0]


def symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``first`` marks each text's first one."""
    cls = code_point_classes()[cp]
    end = np.append(first[1:], True)  # the text ends after this code point
    nxt_space = np.append(cls[1:], SPACE) == SPACE
    sym = cls.copy()
    space = cls == SPACE
    more = space & (nxt_space | end)
    sym[more] = WS_MORE
    last = space & ~more
    sym[last] = np.where(cp[last] == 0x20, SP_LAST, WS_LAST)
    a = np.flatnonzero((cp == 0x27) & ~end)
    if len(a):
        one = np.isin(cp[a + 1], [ord(c) for c in "stmd"])
        b = np.minimum(a + 2, len(cp) - 1)
        two = (a + 2 < len(cp)) & ~end[a + 1]
        pair = np.zeros(len(a), bool)
        for x, y in ("re", "ve", "ll"):
            pair |= (cp[a + 1] == ord(x)) & (cp[b] == ord(y))
        sym[a[one]] = APOS1
        sym[a[~one & two & pair]] = APOS2
    return sym + first.astype(np.uint8) * FIRST


def boundaries(sym: np.ndarray) -> np.ndarray:
    """Indexes at which tokens start, by a blocked scan of transition functions."""
    n = len(sym)
    if not n:
        return np.zeros(0, np.int64)
    length = max(16, int(np.sqrt(n / 8)))
    blocks = -(-n // length)
    s = np.full(blocks * length, L_, np.uint8)
    s[:n] = sym
    steps = np.ascontiguousarray(s.reshape(blocks, length).T).astype(np.uint16) * 8
    f = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, 1)
    for row in steps:
        f = NEXT[row + f]
    begin, state = np.empty(blocks, np.uint8), CLOSED
    for b, col in enumerate(f.T.tolist()):
        begin[b] = state
        state = col[state]
    out, state = np.empty((length, blocks), bool), begin
    for k, row in enumerate(steps):
        at = row + state
        out[k] = STARTS[at]
        state = NEXT[at]
    return np.flatnonzero(out.T.reshape(-1)[:n])


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Repeatedly join the adjacent pair of lowest rank, leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, prev, alive = [i + 1 for i in range(n)], [i - 1 for i in range(n)], [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = False, end[j]
        if end[i] < n:
            prev[end[i]] = i
            if (r := ranks.get(piece[i:end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:end[i]])) is not None:
            heapq.heappush(heap, (r, p, end[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one rank file, with its cache of pieces."""

    def __init__(self, raw: bytes):
        self.ranks = parse_ranks(raw)
        vocabulary = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for t, r in self.ranks.items():
            vocabulary[r] = t
        self.size = np.array([len(t) for t in vocabulary], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(vocabulary), np.uint8)
        self._reset()

    def _reset(self):
        codec = self
        self.flat, self.heads, self.held = [], [0], 0

        class Pieces(dict):
            def __missing__(self, piece):
                ids = merge(piece, codec.ranks)
                codec.flat.extend(ids)
                codec.heads.append(len(codec.flat))
                codec.held += len(piece)
                self[piece] = k = len(codec.heads) - 2
                return k

        self.pieces = Pieces()

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens per text) of the UTF-8 texts in ``buf``."""
        data = buf.tobytes()
        cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        head = np.flatnonzero((buf & 0xC0) != 0x80)
        first = np.zeros(len(cp), bool)
        first[np.searchsorted(head, offs[:-1][offs[:-1] < offs[1:]])] = True
        starts = head[boundaries(symbols(cp, first))]
        at = starts.tolist()
        if len(self.pieces) > CACHE_PIECES or self.held > CACHE_BYTES:
            self._reset()
        k = np.fromiter(map(self.pieces.__getitem__, [data[a:b] for a, b in zip(at, at[1:] + [len(data)])]), np.int64, len(at))
        heads = np.array(self.heads, np.int64)
        n = heads[k + 1] - heads[k]
        ids = np.array(self.flat, np.int32)[C.ranges(heads[k], n)]
        upto = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(upto[np.searchsorted(starts, offs)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bytes per text)."""
        n = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.bytes[C.ranges(self.start[ids], n)], np.diff(upto[ends])

    def offsets(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each token's byte offset in its text."""
        n = self.size[ids]
        upto = np.cumsum(n) - n
        ends = np.cumsum(counts)
        base = np.concatenate([upto, [0]])[ends - counts]
        return upto - np.repeat(base, counts)


_codecs: dict[bytes, Codec] = {}


def codec(raw: bytes) -> Codec:
    if raw not in _codecs:
        _codecs.clear()
        _codecs[raw] = Codec(raw)
    return _codecs[raw]


def _binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])


def _run(shared, id_name: str, decode: bool):
    def run(batches):
        own = codec(shared.value)
        for batch in C.chunks(batches):
            ids, counts = own.encode(*C.utf8(batch.column(1)))
            cols = [batch.column(0), C.lists(ids, counts, pa.int32())]
            if decode:
                cols.append(_binary(*own.decode(ids, counts)))
            else:
                cols.append(C.lists(own.offsets(ids, counts).astype(np.int32), counts, pa.int32()))
            yield pa.RecordBatch.from_arrays(cols, [id_name, "ids", "decoded" if decode else "offsets"])
    return run


def _encoded(docs: DataFrame, ranks_path: str, id_col: str, text_col: str, decode: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # a vocabulary file: under 1 MB
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    tail = "decoded binary" if decode else "offsets array<int>"
    return src.mapInArrow(_run(shared, "_id", decode), f"_id {kind}, ids array<int>, {tail}").withColumnRenamed("_id", id_col)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``ids`` (array<int>) and ``offsets``
    (each token's byte offset in the text's UTF-8). Null and empty texts give
    empty arrays; repeated rows each give a row; other columns are ignored."""
    return _encoded(docs, ranks_path, id_col, text_col, False)


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass: the id, ``ids`` and
    ``decoded`` (binary). Edge cases as in ``encode``."""
    return _encoded(docs, ranks_path, id_col, text_col, True)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids",
           offsets_col: str | None = None, from_byte: int = 0, to_byte: int | None = None) -> DataFrame:
    """(id, decoded binary) of rows of ids; null ids give empty bytes. With
    ``offsets_col`` only the tokens that start in bytes ``from_byte`` to
    ``to_byte`` (exclusive) of the text are decoded."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    ids = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    if offsets_col is not None:
        inside = lambda x: (x >= from_byte) & (F.lit(True) if to_byte is None else x < to_byte)
        both = F.filter(F.arrays_zip(ids.alias("i"), F.col(offsets_col).alias("o")), lambda p: inside(p["o"]))
        ids = F.transform(both, lambda p: p["i"])
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        own = codec(shared.value)
        for batch in batches:
            col = batch.column(1)
            counts = np.diff(col.offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(*own.decode(col.flatten().to_numpy(), counts))], ["_id", "decoded"])

    src = encoded.select(F.col(id_col).alias("_id"), ids.alias("ids"))
    return src.mapInArrow(run, f"_id {kind}, decoded binary").withColumnRenamed("_id", id_col)
