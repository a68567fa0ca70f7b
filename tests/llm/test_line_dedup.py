import random

import pytest

from polylabel.llm import line_dedup, queries

SPACE = " \t\n\x0b\x0c\r"


def shingles(line):
    return {line[i:i + 8] for i in range(max(1, len(line) - 7))}


def brute(rows):
    """Kept texts by (id, text), comparing all pairs of distinct lines."""
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    where, sets = {}, {}
    for i, t in docs:
        for p, line in enumerate(t.split("\n")):
            if line := line.strip(SPACE):
                where.setdefault(line, []).append((i is not None, i or 0, t, p))
                sets[line] = shingles(line)
    names = list(sets)
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, x in enumerate(names):
        for y in names[k + 1:]:
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                parent[find(y)] = find(x)
    groups = {}
    for x in names:
        groups.setdefault(find(x), []).extend(where[x])
    gone = {o for v in groups.values() for o in v} - {min(v, key=lambda o: (o[0], o[1], o[3])) for v in groups.values()}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        lines = t.split("\n")
        drop = [p for p in range(len(lines)) if (i is not None, i or 0, t, p) in gone]
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in drop), len(drop)))
    return sorted(out, key=str)


def run(df):
    return sorted(((r[0], r.text, len(r.removed_lines)) for r in df.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    syllables = ["tha", "re", "ing", "ou", "né", "中", "st", "wo", "la", "mi", "ku"]
    line = lambda: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 40)))
    base = [line() for _ in range(40)]
    rows = []
    for i in range(60):
        own = [line() for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 3)):
            x = rng.choice(base)
            if len(x) > 60 and rng.random() < 0.5:
                # one letter changed: similarity well above 0.8, so banding finds it
                at = rng.randrange(len(x))
                x = x[:at] + "Z" + x[at + 1:]
            own.append(rng.choice(["", "  ", "\t"]) + x + rng.choice(["", " ", "\r"]))
        rng.shuffle(own)
        rows.append((i, "\n".join(own)))
    return rows


EDGE = [(100, None), (101, ""), (102, "\n\n \n"), (103, "same short"), (103, "same short"), (104, "same short\nsame short"), (None, "same short\nnull first"),
        (105, "x" * 50_000), (106, "x" * 50_001 + "\nnull first"), (107, "a"), (108, "b\na"), (109, "\na\n")]


def test_against_brute_force(spark, documents):
    rows = corpus(5) + EDGE
    out = line_dedup.deduplicate(documents(rows))
    assert out.columns[:-2] == documents([]).columns
    assert run(out) == brute(rows)


def test_empty_table(spark, documents):
    assert line_dedup.deduplicate(documents([])).collect() == []


def test_banding_recall(spark):
    """Pairs at a similarity just above the bound meet in a bucket."""
    rng = random.Random(9)
    texts = []
    for i in range(400):
        x = "".join(rng.choices("abcdefghij klmno", k=200))
        y = list(x)
        for at in (30, 160):  # 2 * 8 shingles of 193 differ: similarity 0.846
            y[at] = "Z"
        texts += [(2 * i, x), (2 * i + 1, "".join(y))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(8, "doc_id")
    kept = sum(r.text != "" for r in line_dedup.deduplicate(df).collect())
    assert kept <= 402


def test_query_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op9_line_dedup(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert len(got) == len(rows)
    lines = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            lines.setdefault(x.strip(SPACE), set()).add(i)
    for i, t in rows:
        exact = sum(bool(x.strip(SPACE)) and min(lines[x.strip(SPACE)]) < i for x in (t or "").split("\n"))
        assert got[i].n_removed >= exact


def test_columns_of_any_name(spark):
    """Every internal name, and the operator's own, as input columns."""
    names = ["_id", "_key", "_removed", "_n", "_new", "_gone", "_text_key", "id", "row", "gone", "removed", "text_key", "gone_id", "gone_key",
             "n", "lines", "n_lines", "removed_lines", "node", "a.b"]
    line = "a line that is long enough to be compared with others"
    rows = [(i, t, *(100 * i + k for k in range(len(names)))) for i, t in ((1, f"{line}\nsome other text that only the first one has"), (2, f"x\n{line}"), (3, line))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` int" for c in names))
    want = {1: rows[0][1], 2: "x", 3: ""}
    got = line_dedup.deduplicate(df)
    assert got.columns == [c for c in df.columns if c not in ("n_lines", "removed_lines")] + ["n_lines", "removed_lines"]
    for r in got.collect():
        assert r["text"] == want[r["doc_id"]] and all(r[c] == 100 * r["doc_id"] + k for k, c in enumerate(names) if c in got.columns[:-2])
    short = line_dedup.shortened(df)
    assert short.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["removed_lines"]) for r in short.collect()) == [(1, want[1], 116, 117), (2, "x", 216, 217)]


def test_length_follows(spark):
    line = "a line that is long enough to be compared with others"
    df = spark.createDataFrame([(1, line, 999), (2, f"x\n{line}", 999), (3, None, 5), (4, " \n", 7)], "doc_id bigint, text string, n_chars int")
    assert sorted(tuple(r) for r in line_dedup.shortened(df).collect()) == [(1, line, 999), (2, "x", 1), (3, None, 5), (4, " \n", 7)]


def test_null_text_and_missing_length(spark):
    df = spark.createDataFrame([(1, "some line of text here"), (2, None)], "doc_id bigint, text string")
    assert sorted((tuple(r) for r in line_dedup.shortened(df).collect()), key=str) == [(1, "some line of text here"), (2, None)]


def test_sets_and_bitmaps_of_many_lines():
    """Sets and bitmaps made for many lines at once against one line at a time."""
    import numpy as np
    import pyarrow as pa

    from polylabel.llm import pairs

    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(list("ab é字"), n)) for n in [0, 1, 7, 8, 9, 130, 300, 900, 5000] * 40] + ["x" * (line_dedup.SLICE + 9), ""]
    tokens, sizes = line_dedup.line_sets(pa.array(lines, pa.string()))
    at = np.concatenate([[0], np.cumsum(sizes)])
    n_bytes = [len({s[k:k + line_dedup.CHARS] for k in range(max(1, len(s) - line_dedup.CHARS + 1))}) if s else 0 for s in lines]
    assert sizes.tolist() == n_bytes
    own = [tokens[a:b] for a, b in zip(at[:-1], at[1:])]
    assert all((x[1:] > x[:-1]).all() for x in own)
    for s, x in zip(lines, own):  # a line's set does not depend on its neighbours
        assert (line_dedup.line_sets(pa.array([s]))[0] == x).all()
    flat, longs = pairs._bitmaps(tokens, sizes)
    to = np.concatenate([[0], np.cumsum(longs)])
    for k, x in enumerate(own):
        odd = np.zeros(64 * longs[k], np.uint8)
        for t in x.tolist():
            odd[t % len(odd)] ^= 1
        assert (np.packbits(odd).view(np.int64) == flat[to[k]:to[k + 1]]).all()


def test_lines_seen_lately_are_left_out():
    import numpy as np

    recent = line_dedup._Recent(4)
    h = np.arange(16, dtype=np.uint64)
    assert recent.new(h).all() and not recent.new(h).any()
    assert recent.new(h + np.uint64(16)).all() and recent.new(h).all()  # a place holds its last hash


def test_signatures_of_many_lines():
    """Bins' minima and band keys against one bin and one band at a time."""
    import numpy as np

    from polylabel.llm import common as C

    rng = np.random.default_rng(4)
    bins = line_dedup.BANDS * line_dedup.ROWS
    own = [np.unique(rng.integers(0, 1 << 40, n, dtype=np.uint64)) for n in (1, 2, 5, 60, 400, 1)]
    line = np.repeat(np.arange(len(own)), [len(x) for x in own])
    got = line_dedup._bin_minima(line, np.concatenate(own), len(own))
    for x, row in zip(own, got):
        first = {}
        for s in x.tolist():
            first.setdefault(((s >> 8) * bins) >> 32, s)
        for b in range(bins):
            far = next(d for d in range(bins) if (b + d) % bins in first)
            assert row[b] == C.mix(np.array([first[(b + far) % bins] + far * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
    for kind in (0, 1):
        keys = line_dedup._band_keys(got, kind)
        for k in range(line_dedup.BANDS):
            key = np.full(len(got), k + kind * line_dedup.BANDS, np.uint64)
            for r in range(k * line_dedup.ROWS, (k + 1) * line_dedup.ROWS):
                key = C.mix(key * np.uint64(0x9E3779B97F4A7C15) + got[:, r])
            assert (key == keys[:, k]).all()


def test_bands_have_a_row_per_line_and_kind():
    import pyarrow as pa

    lines = ["short line", "m" * 40 + "".join(map(chr, range(200, 250))), "".join(map(chr, range(1000, 1300)))]
    lines += ["".join(chr(0x4E00 + 7 * i % 5000) for i in range(line_dedup.LONG))]  # a little shorter than LONG: both kinds
    batch = pa.RecordBatch.from_arrays([pa.array(["\n".join(lines), lines[0]])], ["text"])
    rows = [r for b in line_dedup._bands([batch]) for r in b.to_pylist()]
    assert list(rows[0]) == line_dedup.BAND_COLUMNS
    assert len({(r["node"], r["kind"]) for r in rows}) == len(rows)
    kinds = {}
    for r in rows:
        kinds.setdefault(r["n"], set()).add(r["kind"])
    assert kinds == {len(shingles(x)): {0} if len(shingles(x)) * 100 < line_dedup.LONG * 80 else {1} if len(shingles(x)) >= line_dedup.LONG else {0, 1} for x in lines}
    assert any(len(k) == 2 for k in kinds.values())


def test_components_grow(spark):
    """Components with further links are those of all links; without any they stay."""
    from polylabel.llm import common as C
    from polylabel.llm import pairs

    rng = random.Random(6)
    links = [tuple(sorted(rng.sample(range(300), 2))) for _ in range(220)]
    old, new = (spark.createDataFrame(x, "a bigint, b bigint") for x in (links[:150], links[150:]))
    scratch = C.Scratch(spark, "grown")
    comps = C.components(old, scratch)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(pairs._grown(comps, new, scratch)) == rows(C.components(old.unionByName(new), scratch))
    assert rows(pairs._grown(comps, new.limit(0), scratch)) == rows(comps)


def test_only_texts_that_are_asked_for_leave_a_task():
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from polylabel.llm import common
    lines = [f"line number {i} of the text \u00e9" for i in range(2000)]
    text = "\n".join([*lines, "", lines[7], " " + lines[3]])
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6]), pa.array([text, lines[7]]), pa.array([50, 60])], ["id", "text", "text_key"])
    h = line_dedup._hashed(batch, 1)[-1]
    held = common.Sieve(np.zeros(1 << 14, np.uint64), 20)
    for x in h[[7, 1500]]:
        cell = int(x) >> 44
        held.words[cell >> 6] |= np.uint64(1 << (cell & 63))
    got = [r for out in line_dedup._occurrences(SimpleNamespace(value=held))([batch]) for r in out.to_pylist()]
    place = [(5, 50, i) for i in range(2000)] + [(5, 50, 2001), (5, 50, 2002), (6, 60, 0)]
    assert [(r["id"], r["text_key"], r["pos"]) for r in got] == place
    texts = {r["line"]: r["node"] for r in got if r["line"] is not None}
    assert {lines[7], lines[1500]} <= set(texts) and len(texts) < 20
    assert sum(r["line"] == lines[7] for r in got) == 1  # a line's text leaves a task once
    assert all(node == int(h[lines.index(line)].astype(np.int64)) for line, node in texts.items())
