"""Token counts under a unigram model, by dynamic programming over a trie.

A text's pre-tokens are its runs between ASCII white space, each led by the
word mark. The best segmentation of a pre-token maximises the sum of its
pieces' scores; a character outside the vocabulary costs one token per UTF-8
byte. The forward scores of a prefix do not depend on what follows, so the
distinct pre-tokens of a chunk of rows are walked as a trie (in sorted order,
keeping the forward scores along the current path): a prefix that many
pre-tokens share is scored once, and counts are stored at the terminals.

Scores are integers (micro-nats), so sums do not depend on their order. Of
segmentations with equal scores the one with fewer tokens counts. One pass
over the rows, no shuffle; terminal counts are cached per worker up to
``CACHE_PIECES`` pre-tokens.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polylabel.llm import common as C

CACHE_PIECES = 400_000
LONG_PIECE = 256  # bytes; longer pre-tokens are not cached
MARK = "▁"   # fixed value: the vocabulary's sign for a word's start


def zipf_pieces(path: str) -> dict[str, int]:
    """Pieces of a public sentencepiece vocabulary file and their scores. The
    file ranks its pieces but holds no probabilities, so a piece of rank r gets
    the Zipf log-probability ``-log((r + 1) * H)``, in micro-nats."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    ids.sort(key=lambda i: (-sp.get_score(i), i))
    total = sum(1 / (r + 1) for r in range(len(ids)))
    return {sp.id_to_piece(i): round(-1e6 * math.log((r + 1) * total)) for r, i in enumerate(ids)}


class Trie:
    """Forward scores along one path of the trie of pre-tokens."""

    def __init__(self, pieces: dict[str, int]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=0)
        self.byte = min(pieces.values(), default=0) - 10_000_000
        self.path, self.best, self.count = "", [0], [0]
        self.nodes = 0  # trie nodes scored

    def count_of(self, token: str) -> tuple[int, int]:
        """(tokens, score) of one pre-token; shares what the previous one has
        in common with it, so call in sorted order."""
        path, best, count, pieces = self.path, self.best, self.count, self.pieces
        n = len(token)
        keep, most = 0, min(n, len(path))
        while keep < most and token[keep] == path[keep]:
            keep += 1
        del best[keep + 1:], count[keep + 1:]
        for i in range(keep + 1, n + 1):
            size = len(token[i - 1].encode())
            top, least = best[i - 1] + self.byte * size, count[i - 1] + size
            for j in range(max(0, i - self.longest), i):
                s = pieces.get(token[j:i])
                if s is not None:
                    s += best[j]
                    if s > top or s == top and count[j] + 1 < least:
                        top, least = s, count[j] + 1
            best.append(top)
            count.append(least)
        self.nodes += n - keep
        self.path = token
        return count[n], best[n]


class Counter:
    def __init__(self, pieces: dict[str, int]):
        self.trie = Trie(pieces)
        self._reset()

    def _reset(self):
        self.at, self.counts, self.scores = {}, [], []

    def count(self, buf: np.ndarray, offs: np.ndarray):
        """(pre-tokens, tokens, score) of each text."""
        starts, ends, ptr = C.words(buf, offs, C.NON_SPACE)
        data = buf.tobytes()
        slices = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        if len(self.at) > CACHE_PIECES:
            self._reset()
        new = sorted((MARK + s.decode("utf-8", "replace"), s) for s in set(slices) if s not in self.at)
        for token, s in new:
            n, score = self.trie.count_of(token)
            self.at[s] = len(self.counts)
            self.counts.append(n)
            self.scores.append(score)
        k = np.fromiter(map(self.at.__getitem__, slices), np.int64, len(slices))
        out = [np.diff(ptr)]
        for values in (self.counts, self.scores):
            upto = np.concatenate([[0], np.cumsum(np.array(values, np.int64)[k])])
            out.append(np.diff(upto[ptr]))
        for token, s in new:
            if len(s) > LONG_PIECE:
                self.at.pop(s)
        return out


_counters: dict[int, Counter] = {}


def _counter(pieces: dict[str, int]) -> Counter:
    """The worker's counter of this vocabulary object (a broadcast value keeps
    its identity within a worker)."""
    own = _counters.get(id(pieces))
    if own is None or own.trie.pieces is not pieces:
        _counters.clear()
        own = _counters[id(pieces)] = Counter(pieces)
    return own


def token_counts(docs: DataFrame, pieces: dict[str, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_pretokens``, ``n_tokens`` and
    ``score`` (the best segmentations' summed micro-nats). Null, empty and
    white-space texts have no pre-tokens; repeated rows each give a row; other
    columns are ignored. ``pieces`` is a vocabulary (piece to score in
    micro-nats, at most 0), sent to the tasks whole: it is a model's fixed
    vocabulary, not data."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = _counter(shared.value)
        for batch in C.chunks(batches):
            cols = own.count(*C.utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)], ["_id", "n_pretokens", "n_tokens", "score"])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"_id {kind}, n_pretokens bigint, n_tokens bigint, score bigint").withColumnRenamed("_id", id_col)
