"""Secret scans by assignment-aware lexing.

Two layers. The base layer finds three kinds of match whatever stands around
them: ``assign`` (a sensitive word, a sign, a value), ``access`` (access key
ids) and ``hex`` (long hexadecimal runs). The lexing layer reads source and
configuration syntax: it finds ``name = literal`` pairs (quoted or bare
literals, concatenated strings, quoted keys as in JSON), keeps the constants a
text has defined so that ``password = KEY`` leads to the literal behind
``KEY``, and scores each literal by how sensitive its target's name is and how
much the literal looks like a secret. Literals above the threshold are spans
of kind ``literal``.

Vectorised byte scans find the places where anything can start (hexadecimal
runs, the sensitive words, assignment signs); only texts with such places are
read further, whole, text by text. One pass over the rows, no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polylabel.llm import common as C

KINDS = ("assign", "access", "hex", "literal")
# The base patterns and the least length of what they must hold.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_HEX = C.byte_table(b"0123456789abcdef")
KEPT = 4096  # bytes of a literal up to which its text is kept for its score

# Sensitivity of the words in a target's name.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "key": 0.5, "api": 0.3, "access": 0.3, "private": 0.4, "credential": 0.9, "credentials": 0.9, "auth": 0.6,
    "authorization": 0.8, "bearer": 0.8, "signature": 0.4, "signing": 0.4, "encryption": 0.4, "salt": 0.5, "session": 0.3,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|%\(.*\)s|\{\{.*\}\}|(?:your|my|the|some)[-_ ].*|example|changeme|none|null|true|false|todo|test)$")

_STRING = rb'''"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`'''
PAIR = re.compile(
    rb'''(?<![A-Za-z0-9_.$-])(?P<q>["'`]?)(?P<name>[A-Za-z_$][A-Za-z0-9_.$-]*+)(?P=q)[ \t]*+'''
    rb'''(?::=|=>|=(?![=~])|:(?![:/=]))[ \t]*+(?P<value>(?:''' + _STRING + rb''')(?:[ \t]*+\+?[ \t]*+(?:''' + _STRING
    + rb''')|[ \t]*+\+[ \t]*+[A-Za-z_$][A-Za-z0-9_.$]*+)*+|[A-Za-z0-9+/_.=@%~$!#&*^-]++(?:[ \t]*+\+[ \t]*+(?:''' + _STRING
    + rb'''|[A-Za-z_$][A-Za-z0-9_.$]*+))*+)''')
PART = re.compile(rb"(?P<string>" + _STRING + rb")|(?P<plus>\+(?=[ \t\"'`A-Za-z_$]))|(?P<bare>[A-Za-z0-9/_.=@%~$!#&*^-][A-Za-z0-9+/_.=@%~$!#&*^-]*+)|[ \t]++")
NAME = re.compile(rb"[A-Za-z_$][A-Za-z0-9_.$]*")


def name_score(name: str) -> float:
    """Sensitivity of a target's name: the weights of its words (cut at signs
    and at a change to upper case), at most 1."""
    parts = [x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
    if "".join(parts) in NAME_WEIGHTS:
        return NAME_WEIGHTS["".join(parts)]
    joined = {"".join(p) for p in zip(parts, parts[1:])}
    return min(1.0, sum(NAME_WEIGHTS.get(p, 0.0) for p in {*parts, *joined}))


def _looks(n: int, counts: Counter) -> float:
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    classes = len({0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in counts})
    return min(1.0, 0.4 * (1 if n >= 16 else n / 16) + 0.4 * min(1, entropy / 3.5) + 0.1 * (classes - 1))


def literal_score(value: str) -> float:
    """How much a literal looks like a secret, from 0 to 1: its length, the
    entropy of its characters and the mix of their classes. Placeholders and
    literals of several words score 0."""
    if len(value) < 6 or PLACEHOLDER.match(value) or re.search(r"\s", value):
        return 0.0
    return _looks(len(value), Counter(value))


class Literal:
    """What a name stands for: a literal, and where its parts are. Of one of
    more than ``KEPT`` bytes its ends and how often each character occurs are
    kept, which is all that its score needs; so constants put together from
    constants stay small, however long what they stand for."""

    __slots__ = ("text", "counts", "ends", "spans", "parts")

    def __init__(self, pieces: list):
        """``pieces`` are (bytes, span) pairs and earlier literals."""
        self.spans = [p[1] for p in pieces if isinstance(p, tuple)]
        self.parts = [p for p in pieces if isinstance(p, Literal)]
        texts = [p.text if isinstance(p, Literal) else p[0] for p in pieces]
        self.text = self.counts = self.ends = None
        if None not in texts and sum(map(len, texts)) <= KEPT:
            self.text = b"".join(texts)
            return
        self.counts, head, tail = Counter(), "", ""
        for p in pieces:
            if isinstance(p, Literal) and p.text is None:
                own, first, last = p.counts, *p.ends
            else:
                own = (p.text if isinstance(p, Literal) else p[0]).decode("utf-8", "replace")
                own, first, last = Counter(own), own[:64], own[-64:]
            for c, k in own.items():
                self.counts[c] += k
            head, tail = (head + first)[:64] if len(head) < 64 else head, (tail + last)[-64:]
        self.ends = (head, tail)

    def score(self) -> float:
        if self.text is not None:
            return literal_score(self.text.decode("utf-8", "replace"))
        ends = "".join(self.ends)
        if any(c.isspace() for c in self.counts) or len({c.lower() for c in self.counts} | {"x"}) == 1 or set(self.counts) in ({"*"}, {"."}):
            return 0.0
        if PLACEHOLDER.match(ends) and not re.fullmatch(r"[xX]+|\*+|\.+", ends):
            return 0.0
        return _looks(sum(self.counts.values()), self.counts)

    def collect(self, found: set, seen: set) -> None:
        """Add the spans of this literal and those behind it to ``found``."""
        todo = [self]
        while todo:
            one = todo.pop()
            if id(one) not in seen:
                seen.add(id(one))
                found.update(one.spans)
                todo += one.parts


def lex(data: bytes, places=None) -> list[tuple[str, Literal]]:
    """(target name, literal) pairs of a text in order of appearance; a
    literal's spans are byte ranges of its parts, through constants if need
    be. A name stands for what it was given last. ``places`` may give the
    positions of ``=`` and ``:`` signs."""
    if places is None:
        places = [m.start() for m in re.finditer(rb"[:=]", data)]
    constants: dict[bytes, Literal] = {}
    out, done = [], 0
    for at in places:
        if at < done:
            continue
        line = data.rfind(b"\n", 0, at) + 1
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        for m in PAIR.finditer(data, max(line, done), stop):
            pieces, named = [], False
            for part in PART.finditer(data, m.start("value"), m.end("value")):
                if part["string"] is not None:
                    pieces.append((part["string"][1:-1], (part.start() + 1, part.end() - 1)))
                elif part["bare"] is not None:
                    known = constants.get(part["bare"])
                    if known is not None:
                        pieces.append(known)
                    elif not named and not pieces:
                        pieces.append((part["bare"], (part.start(), part.end())))
                    named = True
            constants[m["name"]] = found = Literal(pieces)
            out.append((m["name"].decode("utf-8", "replace"), found))
        done = max(done, stop)
    return out


def scan(data: bytes, hex_runs, words, signs, threshold: float) -> list[tuple[int, str, int]]:
    """All spans (start, kind, end) of one text in bytes, sorted."""
    out = [(a, "hex", b) for a, b in hex_runs]
    end = 0
    for at in words:
        if at >= end and (m := ASSIGN.match(data, at)):
            end = m.end()
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                out.append((at, "assign", end))
    if b"AKIA" in data:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= LEAST["access"]]
    if signs:
        found, seen = set(), set()
        for name, literal in lex(data, signs):
            if (w := name_score(name)) and w * literal.score() >= threshold:
                literal.collect(found, seen)
        out += [(a, "literal", b) for a, b in found if b > a]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def _positions(low: bytes) -> list[int]:
    out = []
    for word in ASSIGN_WORDS:
        at = low.find(word)
        while at >= 0:
            out.append(at)
            at = low.find(word, at + 1)
    return sorted(out)


def find_spans(buf: np.ndarray, offs: np.ndarray, threshold: float) -> list[list[tuple[int, str, int]]]:
    """Spans of each text of a chunk, in code points."""
    data = buf.tobytes()
    starts, ends, _ = C.words(buf, offs, _HEX)
    long = ends - starts >= LEAST["hex"]
    places = {"hex": starts[long], "words": np.array(_positions(data.lower()), np.int64),
              "signs": np.flatnonzero((buf == 0x3D) | (buf == 0x3A)), "access": np.array([m.start() for m in re.finditer(b"AKIA", data)], np.int64)}
    hex_end = dict(zip(starts[long].tolist(), ends[long].tolist()))
    cut = {k: np.searchsorted(v, offs) for k, v in places.items()}
    some = np.zeros(len(offs) - 1, bool)
    for v in cut.values():
        some |= np.diff(v) > 0
    out: list[list] = [[] for _ in range(len(offs) - 1)]
    for i in np.flatnonzero(some).tolist():
        base = int(offs[i])
        own = {k: (places[k][cut[k][i]:cut[k][i + 1]] - base).tolist() for k in places}
        found = scan(data[base:offs[i + 1]], [(a, hex_end[a + base] - base) for a in own["hex"]], own["words"], own["signs"], threshold)
        if found:
            heads = np.concatenate([[0], np.cumsum((buf[base:offs[i + 1]] & 0xC0) != 0x80)])
            out[i] = [(int(heads[a]), kind, int(heads[b])) for a, kind, b in found]
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: the id and ``spans``, array<struct(kind, start,
    end)> in code points (end exclusive), ordered by start, then kind as in
    ``KINDS``. Spans of the kinds ``assign``, ``access`` and ``hex`` are whole
    matches, found leftmost and without overlap within a kind; ``literal``
    spans are the literals (or their parts) whose name score times literal
    score is at least ``threshold``. Null and empty texts have no spans;
    repeated rows each give a row; other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in C.chunks(batches):
            found = find_spans(*C.utf8(batch.column(1)), threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in x] for x in found], pa.list_(struct))], ["_id", "spans"])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("_id", id_col)
