"""Repair of conversations by Hirschberg's divide and conquer.

A conversation's rows, in order, are repaired by the cheapest edits that give
it the role pattern ``(system? (user assistant)+)?``: Keep a row (0), Rerole it
(1), Delete it (2), Insert an empty turn (5); a blank or a repeated row must go,
and a truncated row that stays costs 5 more. Of equally cheap repairs the one
whose edit initials are least in ASCII is taken.

What was written so far decides which turn may follow: nothing yet, a system
turn, a user turn, an assistant turn. So a row, with the inserts before it, is
a table of costs from four states to four states. The states between the rows
of a conversation are found in linear space: the four costs from the start run
forward over the first half of the rows, the four costs to the end run backward
over the second half, the cheapest crossing is taken, and both halves are
solved in turn. With every cost runs the rank of its edits among those of the
four states, so equally cheap crossings are told apart without the edits
themselves. (Two states' least edits never start one another, as both end with
an edit that takes the same row, so the ranks decide for whole repairs.) All
conversations of an Arrow slice are worked on together, step by step.

Rows are dealt by ranges of (conversation, turn, ...) and sorted inside them, so
a conversation of very many rows spreads over several tasks. A range solves the
conversations that lie inside it at once. One that runs on into another range,
or over more than ``SEGMENT`` rows, becomes segments; a segment's rows compose
into one table of costs and ranks like a row's, the segments of a range into
one, and the ranges' tables, at most one per range, are solved as if they were
rows. The crossings between ranges, then between segments, then give each
segment its first and last state, and the segments are solved on their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polylabel.llm import common as C

SPACE = " \t\n\x0b\x0c\r"
SEGMENT = 1024  # rows of a conversation worked on at once
SEGMENT_BYTES = 32 << 20  # held rows beyond this are cut sooner
FAR = np.int64(1) << 40  # the cost of what cannot be

# ------------------------------------------------------------- the automaton

START, SYSTEM, USER, ASSISTANT = range(4)
_FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the next inserted or reroled turn
_CLASS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
END = 16  # after the symbols 4 * role class + fault: what closes a conversation
# What an edit writes: an inserted turn, the row itself, the row with a new role.
NOTHING, NEW_USER, NEW_ASSISTANT, KEPT, AS_USER, AS_ASSISTANT = range(6)
_CLASSES = ("s", "u", "a", "")


def _row_edits(state: int, role: str, fault: int):
    """(cost, initials, written, next state) of each way to take a row."""
    inserted, cost, written = "", 0, []
    for _ in range(3):
        yield cost + 2, inserted + "D", [*written, NOTHING], state
        if fault in (SOUND, TRUNCATED):
            stay = cost + (5 if fault == TRUNCATED else 0)
            follow = _FOLLOWS[state]
            if _CLASS.get(role) == follow or (role == "s" and state == START):
                yield stay, inserted + "K", [*written, KEPT], _CLASS[role]
            yield stay + 1, inserted + "R", [*written, AS_USER if follow == USER else AS_ASSISTANT], follow
        state = _FOLLOWS[state]
        inserted, cost, written = inserted + "I", cost + 5, [*written, NEW_USER if state == USER else NEW_ASSISTANT]


def _end_edits(state: int):
    """The one way to close a conversation: none, one or two inserts."""
    inserted, cost, written = "", 0, []
    while state not in (START, ASSISTANT):
        state = _FOLLOWS[state]
        inserted, cost, written = inserted + "I", cost + 5, [*written, NEW_USER if state == USER else NEW_ASSISTANT]
    yield cost, inserted, written, ASSISTANT


def _tables():
    cost = np.full((END + 1, 4, 4), FAR)
    rank = np.tile(np.arange(4), (END + 1, 4, 1))
    initials = np.zeros((END + 1, 4, 4, 3), np.uint8)
    written = np.zeros((END + 1, 4, 4, 3), np.int8)
    for symbol in range(END + 1):
        for p in range(4):
            ways = _end_edits(p) if symbol == END else _row_edits(p, _CLASSES[symbol // 4], symbol % 4)
            best: dict[int, tuple] = {}
            for c, edits, items, q in ways:
                best[q] = min(best.get(q, (FAR, "", [])), (c, edits, items))
            for q, (c, edits, items) in best.items():
                cost[symbol, p, q] = c
                initials[symbol, p, q, :len(edits)] = np.frombuffer(edits.encode(), np.uint8)
                written[symbol, p, q, :len(items)] = items
            order = sorted(range(4), key=lambda q: (q not in best, best[q][1] if q in best else "", q))
            rank[symbol, p, order] = np.arange(4)
    return cost, rank, initials, written


COST, RANK, INITIALS, WRITTEN = _tables()


# ---------------------------------------------------------------- Hirschberg

def _forward(cost, rank, t, r):
    """One step of the vectors (B, 4) over tables (B, 4, 4): cheapest cost to
    each state, and the rank of its least edits among the four."""
    through = (cost[:, :, None] + t) * 4 + rank[:, :, None]
    p = through.argmin(1)
    b = np.arange(len(p))[:, None]
    q = np.arange(4)[None]
    best = np.minimum(cost[b, p] + t[b, p, q], FAR)
    order = (best >= FAR) * 64 + rank[b, p] * 16 + r[b, p, q] * 4 + q
    return best, (order[:, :, None] > order[:, None, :]).sum(2)


def _backward(cost, t):
    return np.minimum((t + cost[:, None, :]).min(2), FAR)


def _one(states):
    out = np.full((len(states), 4), FAR)
    out[np.arange(len(states)), states] = 0
    return out


def _run_forward(e, t, r, lo, hi, cost):
    """Vectors over the elements lo to hi of each problem (longest first)."""
    rank = np.tile(np.arange(4), (len(lo), 1))
    lengths = hi - lo
    for k in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(-lengths, -k, "left"))
        at = e[lo[:live] + k]
        cost[:live], rank[:live] = _forward(cost[:live], rank[:live], t[at], r[at])
    return cost, rank


def _run_backward(e, t, lo, hi, cost):
    lengths = hi - lo
    for k in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(-lengths, -k, "left"))
        cost[:live] = _backward(cost[:live], t[e[hi[:live] - 1 - k]])
    return cost


def crossings(e, t, r, lo, hi, first, last):
    """The state after each element of the problems lo to hi over the element
    table (t, r), given each problem's first and last state."""
    after = np.zeros(len(e), np.int64)
    lo, hi, first, last = (np.asarray(x, np.int64) for x in (lo, hi, first, last))
    while True:
        done = hi - lo == 1
        after[lo[done]] = last[done]
        more = np.flatnonzero(hi - lo > 1)
        if not len(more):
            return after
        more = more[np.argsort(-(hi - lo)[more], kind="stable")]
        lo, hi, first, last = lo[more], hi[more], first[more], last[more]
        mid = (lo + hi) // 2  # the halves' lengths fall as the problems' do
        ahead, rank = _run_forward(e, t, r, lo, mid, _one(first))
        back = _run_backward(e, t, mid, hi, _one(last))
        cross = ((ahead + back) * 4 + rank).argmin(1)
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        first, last = np.concatenate([first, cross]), np.concatenate([cross, last])


def compose(e, t, r, lo, hi):
    """One table (cost, rank) per problem for all of its elements."""
    n = len(lo)
    order = np.argsort(-(hi - lo), kind="stable")
    lo4, hi4 = np.repeat(lo[order], 4), np.repeat(hi[order], 4)
    cost, rank = _run_forward(e, t, r, lo4, hi4, _one(np.tile(np.arange(4), n)))
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return cost.reshape(n, 4, 4)[back], rank.reshape(n, 4, 4)[back]


# ------------------------------------------------------------ faults of rows

def _string(column: str) -> Column:
    """A column as text: nulls are one space, and bytes that are no UTF-8
    become replacement characters."""
    return F.coalesce(F.make_valid_utf8(F.col(column).cast("string")), F.lit(" "))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, alive): the damage of the contract, by
    crc32("conv:turn") % 20. Dropped rows stay, without text, as not alive."""
    s = _string
    draw = F.crc32(F.concat(s(conv_col), F.lit(":"), s(turn_col)).cast("binary")) % 20
    text = (F.when(draw <= 1, F.lit("")).when(draw == 2, F.translate(s(text_col), ".!?", "")).otherwise(s(text_col)))
    out = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                      F.when(draw == 4, F.lit("user")).when(draw == 0, F.lit("")).otherwise(s(role_col)).alias("role"),
                      text.alias("text"), (draw != 0).alias("alive"), F.when(draw == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("times")


def undamaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows as they are, in the form of ``damaged``."""
    s = _string
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), s(role_col).alias("role"),
                       s(text_col).alias("text"), F.lit(True).alias("alive"))


def _last_sign() -> Column:
    return F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))


def _symbols(rows: DataFrame, scratch: C.Scratch) -> DataFrame:
    """``rows`` with each row's symbol. A row whose role and text came in an
    earlier turn is a duplicate; one repeated in the same turn is seen to where
    the rows are sorted."""
    h = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role"),
                          "sign": _last_sign()})
    groups = (h.filter("alive and sign <> ''").groupBy("conv", "h1", "h2")
              .agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.max(F.col("turn").isNull()).alias("none")))
    again = scratch.stage(groups.filter("low < high or (none and low is not null)").drop("high"), "again")
    g = again.select(F.col("conv").alias("g_conv"), F.col("h1").alias("g_h1"), F.col("h2").alias("g_h2"), "low", "none")
    j = h.join(g, F.col("conv").eqNullSafe(F.col("g_conv")) & (F.col("h1") == F.col("g_h1")) & (F.col("h2") == F.col("g_h2")), "left")
    repeat = F.coalesce(F.col("turn").isNotNull() & (F.col("none") | (F.col("turn") > F.col("low"))), F.lit(False))
    fault = (F.when(F.col("sign") == "", BLANK).when(repeat, DUPLICATE).when(F.col("sign").isin(".", "!", "?"), SOUND).otherwise(TRUNCATED))
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return j.select("conv", "turn", "role", "text", "alive", (kind * 4 + fault).cast("int").alias("symbol"))


# ----------------------------------------------------------------- in a task

_STATS = ("rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
# A segment's turns and roles at its ends, to join it to the next one.
_ENDS = ("low", "high", "distinct", "role_first", "role_last")
PIECE = ("conv {kind}, part bigint, seg bigint, whole boolean, " + ", ".join(f"{c} bigint" for c in (*_STATS, *_ENDS))
         + ", audit string, repaired_sha256 string, roles array<string>, texts array<string>, symbols binary, costs binary, ranks binary")


def _legal() -> np.ndarray:
    ok = np.zeros((4, 4), bool)
    ok[0, 1] = ok[1, 2] = ok[2, 1] = True
    return ok


LEGAL = _legal()


def _null_safe_same(col: pa.Array) -> np.ndarray:
    """Whether each entry equals the one before (the first does not)."""
    out = np.zeros(len(col), bool)
    if len(col) > 1:
        a, b = col.slice(1), col.slice(0, len(col) - 1)
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] = same | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
    return out


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])[ptr])


def _list_of(flat: pa.Array, ptr: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), flat)


def _build(symbol, ptr, roles, texts, before, after):
    """(initials, roles, texts) of each piece from the states around its
    elements: the repaired turns and the edits."""
    n = len(symbol)
    items = WRITTEN[symbol, before, after].reshape(-1)
    at = np.flatnonzero(items)
    item, row = items[at], at // 3
    counts = np.bincount(row, minlength=n)
    pool_roles = pa.concat_arrays([roles.cast(pa.string()), pa.array(["user", "assistant"])])
    pool_texts = pa.concat_arrays([texts.cast(pa.string()), pa.array([""])])
    m = len(roles)
    who = np.where(item == KEPT, row, np.where((item == NEW_USER) | (item == AS_USER), m, m + 1))
    what = np.where(item >= KEPT, row, m)
    turn_ptr = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])[ptr]
    edits = INITIALS[symbol, before, after]
    lengths = (edits > 0).sum(1)
    edit_ptr = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])[ptr]
    letters = edits[edits > 0].tobytes()
    audit = [letters[a:b].decode() for a, b in zip(edit_ptr, edit_ptr[1:])]
    out_roles, out_texts = pool_roles.take(pa.array(who)), pool_texts.take(pa.array(what))
    return audit, _list_of(out_roles, turn_ptr), _list_of(out_texts, turn_ptr)


def _lines(roles: pa.Array, texts: pa.Array) -> pa.Array:
    flat = pc.binary_join_element_wise(roles.flatten(), texts.flatten(), ":")
    return pc.binary_join(pa.ListArray.from_arrays(roles.offsets, flat), "\n")


def _ends(ptr, turns, known, symbol):
    """Per piece: lowest, highest and number of known turns, and the role
    classes at its ends (-1 where there is none)."""
    n = len(ptr) - 1
    low, high, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    fresh = known.copy()  # turns come sorted
    fresh[1:] &= ~(known[:-1] & (turns[1:] == turns[:-1]))
    starts = ptr[:-1][ptr[:-1] < ptr[1:]]
    fresh[starts] = known[starts]
    distinct = _sums(fresh.astype(np.int64), ptr)
    some = np.flatnonzero(distinct)
    if len(some):
        at = np.flatnonzero(known)
        low[some] = turns[at[np.searchsorted(at, ptr[some])]]
        high[some] = turns[at[np.searchsorted(at, ptr[some + 1]) - 1]]
    full = ptr[:-1] < ptr[1:]
    first, last = np.full(n, -1), np.full(n, -1)
    first[full], last[full] = symbol[ptr[:-1][full]] // 4, symbol[ptr[1:][full] - 1] // 4
    return low, high, distinct, first, last


def _pieces(rows: pa.Table, cuts: np.ndarray, open_: np.ndarray, part: int, seg: int) -> pa.RecordBatch:
    """Pieces of the sorted rows between ``cuts``: conversations, solved, and
    where ``open_`` segments, with their tables."""
    table = rows.combine_chunks()
    conv = table.column("conv").chunk(0).take(pa.array(cuts[:-1]))
    same = table.column("same_row").chunk(0).to_numpy(zero_copy_only=False)
    alive = table.column("alive").chunk(0).to_numpy(zero_copy_only=False)
    symbol = table.column("symbol").chunk(0).to_numpy(zero_copy_only=False).astype(np.int64)
    symbol = np.where(same & (symbol % 4 != BLANK), symbol // 4 * 4 + DUPLICATE, symbol)
    ptr = np.concatenate([np.zeros(1, np.int64), np.cumsum(alive)])[cuts]
    keep = pa.array(alive)
    symbol = symbol[alive]
    turn, roles, texts = (table.column(c).chunk(0).filter(keep) for c in ("turn", "role", "text"))
    known = turn.is_valid().to_numpy(zero_copy_only=False)
    turns = pc.fill_null(turn, 0).to_numpy(zero_copy_only=False)
    n = len(cuts) - 1
    stats = {"rows": np.diff(ptr), **{name: _sums((symbol % 4 == f).astype(np.int64), ptr)
                                      for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}}
    wrong = np.zeros(len(symbol), np.int64)
    if len(symbol) > 1:
        wrong[1:] = ~LEGAL[symbol[:-1] // 4, symbol[1:] // 4]
        wrong[ptr[:-1][ptr[:-1] < len(symbol)]] = 0
    stats["illegal"] = _sums(wrong, ptr)
    low, high, distinct, first, last = _ends(ptr, turns, known, symbol)
    stats["gaps"] = np.where(distinct > 0, high - low + 1 - distinct, 0)

    # conversations end with the closing element; segments are solved later
    shut = ~open_
    counts = np.diff(ptr) + shut
    e_ptr = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    e = np.full(e_ptr[-1], END)
    row_at = C.ranges(e_ptr[:-1], np.diff(ptr))
    e[row_at] = symbol
    whole = np.flatnonzero(shut)
    lo, hi = e_ptr[:-1][whole], e_ptr[1:][whole]
    after = crossings(e, COST, RANK, lo, hi, np.zeros(len(whole)), np.full(len(whole), ASSISTANT))
    before = np.concatenate([np.zeros(1, np.int64), after[:-1]])[:len(e)]
    before[lo] = START
    per = COST[e, before, after]
    if open_.any():
        per[np.repeat(open_, counts)] = 0
    stats["cost"] = _sums(per, e_ptr)

    # elements take their row's text; the closing element has none
    owner = np.full(len(e), len(symbol))
    owner[row_at] = np.arange(len(symbol))
    e_roles = pa.concat_arrays([roles.cast(pa.string()), pa.array([""])]).take(pa.array(owner))
    e_texts = pa.concat_arrays([texts.cast(pa.string()), pa.array([""])]).take(pa.array(owner))
    audit, out_roles, out_texts = _build(e, e_ptr, e_roles, e_texts, before, after)
    lines = _lines(out_roles, out_texts)
    sha = [None if o else hashlib.sha256(v.as_py().encode()).hexdigest() for v, o in zip(lines, open_)]
    symbols, costs, ranks = [None] * n, [None] * n, [None] * n
    if open_.any():
        at = np.flatnonzero(open_)
        c, r = compose(e, COST, RANK, e_ptr[at], e_ptr[at + 1])
        raw = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), roles.cast(pa.string())), pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), texts.cast(pa.string()))
        pick = pa.array(np.where(open_, np.arange(n) + n, np.arange(n)))
        out_roles, out_texts = (pa.concat_arrays([x, y]).take(pick) for x, y in zip((out_roles, out_texts), raw))
        for k, i in enumerate(at):
            symbols[i], costs[i], ranks[i] = symbol[ptr[i]:ptr[i + 1]].astype(np.uint8).tobytes(), c[k].tobytes(), r[k].astype(np.int64).tobytes()
            audit[i] = None
    fields = {**stats, "low": low, "high": high, "distinct": distinct, "role_first": first, "role_last": last}
    return pa.RecordBatch.from_arrays(
        [conv, pa.array(np.full(n, part)), pa.array(np.arange(n) + seg), pa.array(shut),
         *(pa.array(np.asarray(fields[c], np.int64)) for c in (*_STATS, *_ENDS)),
         pa.array(audit, pa.string()), pa.array(sha, pa.string()), out_roles, out_texts,
         *(pa.array(x, pa.binary()) for x in (symbols, costs, ranks))],
        ["conv", "part", "seg", "whole", *_STATS, *_ENDS, "audit", "repaired_sha256", "roles", "texts", "symbols", "costs", "ranks"])


def _with_last(batches):
    """The batches as tables that know of each row whether it is of the same
    conversation as the row before it, and whether it equals that row."""
    last = None
    for batch in C.chunks(batches):
        table = pa.Table.from_batches([batch])
        seen = (table if last is None else pa.concat_tables([last, table])).combine_chunks()
        same = {c: _null_safe_same(seen.column(c).chunk(0)) for c in ("conv", "turn", "role", "text")}
        skip = 0 if last is None else 1
        equal = np.logical_and.reduce(list(same.values()))
        yield table.append_column("same_conv", pa.array(same["conv"][skip:])).append_column("same_row", pa.array(equal[skip:]))
        last = table.slice(len(table) - 1)


def _solve_range(batches):
    """Pieces of one sorted range. The first and the last conversation may go
    on in the neighbouring ranges, so they become segments, like those of more
    than ``SEGMENT`` rows."""
    part, seg, held = TaskContext.get().partitionId(), 0, None
    running = True  # the held rows begin inside a conversation, or may do so
    for table in _with_last(batches):
        held = table if held is None else pa.concat_tables([held, table])
        new = ~held.column("same_conv").to_numpy()
        starts = np.union1d([0], np.flatnonzero(new))
        cuts, open_ = [], []
        for k, (at, end) in enumerate(zip(starts, starts[1:])):
            inside = k == 0 and running
            if inside or end - at > SEGMENT:
                segments = range(at, end, SEGMENT)
                cuts += segments
                open_ += [True] * len(segments)
            else:
                cuts.append(at)
                open_.append(False)
        rest = int(starts[-1])
        if len(starts) > 1:
            running = False
        while len(held) - rest > SEGMENT or (len(held) - rest > 1 and held.nbytes > SEGMENT_BYTES and rest < len(held) - 1):
            cuts.append(rest)
            open_.append(True)
            rest += min(SEGMENT, len(held) - rest - 1)
            running = True
        if cuts:
            yield _pieces(held.slice(0, rest), np.array([*cuts, rest]), np.array(open_), part, seg)
            seg += len(cuts)
            held = held.slice(rest)
    if held is not None:
        cuts = [*range(0, len(held), SEGMENT), len(held)]
        yield _pieces(held, np.array(cuts), np.ones(len(cuts) - 1, bool), part, seg)


# ------------------------------------------------------- between the segments

_NARROW = ["conv", "part", "seg", *_STATS, *_ENDS, "costs", "ranks"]
_STAT_SCHEMA = ", ".join(f"{c} bigint" for c in _STATS)


def _stack(table: pa.Table, column: str) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_py(), np.int64).reshape(4, 4) for v in table.column(column)])


def _added(table: pa.Table) -> dict:
    """Counts and ends of consecutive stretches of one conversation as one."""
    c = {k: table.column(k).to_numpy().astype(np.int64) for k in (*_STATS, *_ENDS)}
    out = {k: int(c[k].sum()) for k in _STATS}
    known = np.flatnonzero(c["distinct"])
    shared = int((c["high"][known][:-1] == c["low"][known][1:]).sum())
    out["distinct"] = int(c["distinct"].sum()) - shared
    out["low"] = int(c["low"][known[0]]) if len(known) else 0
    out["high"] = int(c["high"][known[-1]]) if len(known) else 0
    out["gaps"] = out["high"] - out["low"] + 1 - out["distinct"] if len(known) else 0
    full = np.flatnonzero(c["rows"])
    out["role_first"] = int(c["role_first"][full[0]]) if len(full) else -1
    out["role_last"] = int(c["role_last"][full[-1]]) if len(full) else -1
    out["illegal"] += int((~LEGAL[c["role_last"][full][:-1], c["role_first"][full][1:]]).sum())
    return out


def _join_segments(table: pa.Table) -> pa.Table:
    """The segments of one conversation in one range as one table."""
    table = table.sort_by("seg")
    t, r = _stack(table, "costs"), _stack(table, "ranks")
    cost, rank = compose(np.arange(len(t)), t, r, np.array([0]), np.array([len(t)]))
    one = _added(table)
    return pa.table({"conv": table.column("conv")[:1], "part": table.column("part")[:1], "seg": pa.array([0], pa.int64()),
                     **{c: pa.array([one[c]], pa.int64()) for c in (*_STATS, *_ENDS)},
                     "costs": [cost[0].tobytes()], "ranks": [rank[0].astype(np.int64).tobytes()]})


def _states(table: pa.Table, after, first, closes, stats) -> pa.Table:
    n = len(table)
    return pa.table({"conv": table.column("conv"), "part": table.column("part"), "seg": table.column("seg"),
                     "first": pa.array(np.concatenate([[first], after[:n - 1]]).astype(np.int64)), "last": pa.array(after[:n].astype(np.int64)),
                     "closes": pa.array(np.arange(n) == n - 1) if closes else pa.array(np.zeros(n, bool)),
                     **{c: pa.array([None] * (n - 1) + [stats[c]], pa.int64()) for c in _STATS}})


def _solve_ranges(table: pa.Table) -> pa.Table:
    """First and last state of each range's stretch of one conversation; the
    last one carries the conversation's counts and cost."""
    table = table.sort_by("part")
    t, r = _stack(table, "costs"), _stack(table, "ranks")
    n = len(t)
    t, r = np.concatenate([t, COST[END:]]), np.concatenate([r, RANK[END:]])
    after = crossings(np.arange(n + 1), t, r, [0], [n + 1], [START], [ASSISTANT])
    before = np.concatenate([[START], after[:-1]])
    stats = _added(table)
    stats["cost"] = int(t[np.arange(n + 1), before, after].sum())
    return _states(table, after, START, True, stats)


def _solve_inside(table: pa.Table, parts: pa.Table) -> pa.Table:
    """First and last state of each segment, from those of its range."""
    table = table.sort_by("seg")
    t, r = _stack(table, "costs"), _stack(table, "ranks")
    p = {c: parts.column(c)[0].as_py() for c in ("first", "last", "closes", *_STATS)}
    after = crossings(np.arange(len(t)), t, r, [0], [len(t)], [p["first"]], [p["last"]])
    return _states(table, after, p["first"], p["closes"], {c: p[c] for c in _STATS})


def _solve_segments(batches):
    """Edits and repaired turns of segments whose first and last state is known."""
    for batch in batches:
        for i in range(len(batch)):
            row = pa.Table.from_batches([batch.slice(i, 1)]).combine_chunks()
            get = lambda c: row.column(c)[0].as_py()  # noqa: E731, B023
            symbol = np.frombuffer(get("symbols"), np.uint8).astype(np.int64)
            n, first, last, closes = len(symbol), get("first"), get("last"), get("closes")
            after = crossings(symbol, COST, RANK, [0], [n], [first], [last]) if n else np.zeros(0, np.int64)
            before = np.concatenate([[first], after[:-1]])[:n].astype(np.int64)
            roles, texts = (row.column(c).chunk(0).flatten().cast(pa.string()) for c in ("roles", "texts"))
            if closes:
                symbol, before, after = np.append(symbol, END), np.append(before, after[-1] if n else first), np.append(after, ASSISTANT)
                roles, texts = (pa.concat_arrays([x, pa.array([""])]) for x in (roles, texts))
            audit, roles, texts = _build(symbol, np.array([0, len(symbol)]), roles, texts, before, after)
            yield pa.RecordBatch.from_arrays(
                [*(batch.slice(i, 1).column(batch.schema.get_field_index(c)) for c in ("conv", "part", "seg", "closes", *_STATS)),
                 pa.array(audit), roles, texts], ["conv", "part", "seg", "closes", *_STATS, "audit", "roles", "texts"])


def _digests(batches):
    """One row per conversation from its segments in order: the texts run
    through the digest and are not kept."""
    names = ["conv", *_STATS, "audit", "repaired_sha256"]
    audit, digest, some = [], hashlib.sha256(), False
    for batch in batches:
        lines = _lines(batch.column(batch.schema.get_field_index("roles")), batch.column(batch.schema.get_field_index("texts")))
        size = batch.column(batch.schema.get_field_index("roles")).value_lengths()
        for i in range(len(batch)):
            get = lambda c: batch.column(batch.schema.get_field_index(c))[i]  # noqa: E731, B023
            audit.append(get("audit").as_py())
            if size[i].as_py():
                digest.update(("\n" if some else "").encode() + lines[i].as_py().encode())
                some = True
            if get("closes").as_py():
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*(one.column(one.schema.get_field_index(c)) for c in ("conv", *_STATS)), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names)
                audit, digest, some = [], hashlib.sha256(), False


# ---------------------------------------------------------------- operator

def repair(rows: DataFrame, scratch: C.Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Repair the conversations of ``damaged`` or ``undamaged`` rows. Returns

    * the report, one row per conversation: conv, rows (after damage), gaps,
      blank, duplicate, truncated, illegal, cost, audit, repaired_sha256;
    * the repaired turns: conv, part, seg, at, role, text, a conversation's
      turns being in the order of (part, seg, at).

    Rows of a conversation are in the order of turn (nulls first), role and
    text; rows equal in all of these follow one another. A null conversation
    is one more conversation. A role's class is its first letter; an empty or
    other role cannot be kept, only reroled or deleted. A conversation
    without rows left has zeros, an empty audit and the digest of nothing;
    an empty table gives no rows. The digest of a conversation of any length
    is taken from its texts in a stream, since SHA-256 has to see them in
    order; all else of a long conversation is spread over its ranges."""
    spark = rows.sparkSession
    scratch = scratch or C.Scratch(spark, "conversations")
    kind = rows.schema["conv"].dataType.simpleString()
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("role")]
    ranged = _symbols(rows, scratch).repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    pieces = scratch.stage(ranged.mapInArrow(_solve_range, PIECE.format(kind=kind)), "pieces")
    narrow = f"conv {kind}, part bigint, seg bigint, " + ", ".join(f"{c} bigint" for c in (*_STATS, *_ENDS)) + ", costs binary, ranks binary"
    state = f"conv {kind}, part bigint, seg bigint, first bigint, last bigint, closes boolean, {_STAT_SCHEMA}"
    segments = pieces.filter("not whole").select(*_NARROW)
    joined = segments.groupBy("conv", "part").applyInArrow(_join_segments, narrow)
    ranges = joined.groupBy("conv").applyInArrow(_solve_ranges, state)
    inside = segments.groupBy("conv", "part").cogroup(ranges.groupBy("conv", "part")).applyInArrow(_solve_inside, state)
    states = scratch.stage(inside, "states")
    s = states.select(F.col("conv").alias("s_conv"), F.col("part").alias("s_part"), F.col("seg").alias("s_seg"), "first", "last", "closes", *_STATS)
    meet = F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("part") == F.col("s_part")) & (F.col("seg") == F.col("s_seg"))
    solved = (pieces.filter("not whole").select("conv", "part", "seg", "symbols", "roles", "texts").join(s, meet)
              .select("conv", "part", "seg", "first", "last", "closes", *_STATS, "symbols", "roles", "texts")
              .mapInArrow(_solve_segments, f"conv {kind}, part bigint, seg bigint, closes boolean, {_STAT_SCHEMA}, audit string, roles array<string>, texts array<string>"))
    long_ = scratch.stage(solved, "long")
    digests = (long_.repartition("conv").sortWithinPartitions("conv", "part", "seg")
               .mapInArrow(_digests, f"conv {kind}, {_STAT_SCHEMA}, audit string, repaired_sha256 string"))
    report = pieces.filter("whole").select("conv", *_STATS, "audit", "repaired_sha256").unionByName(digests)
    turns = (pieces.filter("whole").select("conv", "part", "seg", "roles", "texts").unionByName(long_.select("conv", "part", "seg", "roles", "texts"))
             .select("conv", "part", "seg", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "turn"))
             .select("conv", "part", "seg", "at", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text")))
    return report, turns
