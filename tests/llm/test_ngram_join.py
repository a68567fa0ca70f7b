import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from polylabel.llm import common, ngram_join, pairs, queries


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    near = {(a, b) for v in by.values() for a in v for b in v if a < b} if len(sets) < 400 else {
        (v[0], b) for v in by.values() for b in v[1:]} | {(a, b) for v in by.values() if len(v) < 60 for a in v for b in v if a < b}
    for a, b in near:
        (i, x), (j, y) = sets[a], sets[b]
        if i is not None and j is not None and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((find(i), find(j)))
            parent[q] = p
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def run(df):
    return sorted(((r[0], r.n_shingles, r.component_id) for r in df.collect()), key=str)


def corpus(seed, groups=25, size=6, vocabulary=400):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % vocabulary}"
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 6, 8, 9, 12, 20, 40, 90, 200]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(w))
                w[at:at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
                w = w or ["z"]
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


EDGE = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "ONE"), (905, "one two three four"), (905, "one two three four"),
        (None, "one two three four"), (906, "One  two\nthree FOUR"), (907, "straße straße STRASSE x y z"), (908, "x " * 40_000),
        (909, "y x " + "x " * 40_000), (910, " "), (911, "a b c d e f g"), (912, "a b c d e f g h"), (913, "a b c d e f g h i")]


@pytest.mark.parametrize("frequent, most", [(0, 1 << 20), (2, 60)])
def test_against_brute_force(spark, documents, monkeypatch, frequent, most):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "MAX_FREQUENT", most)
    rows = corpus(frequent + most, groups=35) + EDGE
    assert run(ngram_join.near_duplicates(documents(rows))) == brute(rows)


def test_empty_table(spark, documents):
    assert run(ngram_join.near_duplicates(documents([]))) == []


def test_keep_one(spark, documents):
    docs = documents(corpus(1, groups=10))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


def test_isolated_texts_with_a_passage_cut(spark, documents):
    rng, rows = random.Random(11), []
    for g in range(120):
        n = rng.randint(40, 160)
        w = [f"g{g}w{i}" for i in range(n + 4)]
        least = -(-4 * n // 5)
        cut = n - rng.randint(least, max(least, n * 86 // 100))
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w[:len(w) - cut] if g % 2 else w[cut:]))]
    got = run(ngram_join.near_duplicates(documents(rows)))
    assert got == brute(rows)
    assert all(c == i - i % 2 for i, _, c in got)


def test_prefixes_of_linked_sets_always_meet():
    rng = np.random.default_rng(7)
    for _ in range(3000):
        n = int(rng.integers(2, 70))
        universe = rng.integers(1, 2 ** 62, 300).astype(np.uint64)
        count = np.where(rng.random(300) < rng.random(), rng.integers(1, 50, 300), 0)
        x = rng.permutation(300)[:n]
        drop, add = rng.integers(0, n // 5 + 1), rng.integers(0, n // 4 + 1)
        y = np.union1d(x[drop:], rng.permutation(300)[:add])
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both) or set(x) == set(y):
            continue
        keys = []
        for s in (x, y):
            s = s[np.argsort(universe[s])]
            rare, often = s[count[s] == 0], s[count[s] > 0]
            often = often[np.argsort(count[often], kind="stable")]
            keys.append(ngram_join.prefix_keys(universe[rare], universe[often], len(s)))
        assert len(np.intersect1d(*keys))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(150, 149)] + [(200, 200)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in common.components(
        spark.createDataFrame(edges, "a bigint, b bigint"), common.Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 151)}}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(queries.op1_ngram_jaccard(spark, sf)) == brute(rows)


def test_id_with_two_texts(spark):
    """A link of either text counts, whichever is read first."""
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in ("left", "right"))
    near = lambda t: t + " and two"
    for rows in ([(5, a), (5, b), (1, near(a)), (2, near(b))], [(2, near(b)), (1, near(a)), (5, b), (5, a)], [(5, a), (5, b), (7, near(b)), (8, near(near(b)))]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert {r.component_id for r in ngram_join.near_duplicates(df).collect()} == {min(i for i, _ in rows)}


def test_large_group_of_near_copies(spark, monkeypatch):
    """A thousand copies with edits of their own: the pairs compared stay near
    the number of copies, and the components are those of all pairs."""
    import random
    from polylabel.llm import pairs
    r = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1000):
        words = list(base)
        for _ in range(r.choice([1, 2, 6])):
            words[r.randrange(120)] = f"x{r.randrange(60)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[k:k + 5]) for k in range(116)} for w in (t.split() for _, t in rows)]
    parent = list(range(1000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(1000):
        for y in range(x):
            n = len(sets[x] & sets[y])
            if 100 * n >= 80 * (len(sets[x]) + len(sets[y]) - n):
                p, q = sorted((find(x), find(y)))
                parent[q] = p
    compared = []
    plain = pairs.compare

    def counted(p, *args):
        compared.append(p.count())
        return plain(p, *args)

    monkeypatch.setattr(pairs, "compare", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: find(i) for i in range(1000)}
    assert sum(compared) < 5000


def test_sieve_lets_its_hashes_through_and_few_others(spark):
    rng = np.random.default_rng(5)
    inside, outside = (rng.integers(-1 << 63, (1 << 63) - 1, 20_000) for _ in range(2))
    df = spark.createDataFrame([(int(x),) for x in inside] * 2, "h bigint")
    held = common.sieve(df, df["h"], len(inside))
    assert held.lets(inside).all() and held.lets(outside).mean() < 0.2
    nothing = common.sieve(df.limit(0), df["h"], 0)
    assert not nothing.lets(inside).any() and nothing.lets(inside[:0]).shape == (0,)


def test_sieve_stays_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(common, "SIEVE_BITS", 16)
    h = np.random.default_rng(6).integers(-1 << 63, (1 << 63) - 1, 30_000)
    df = spark.createDataFrame([(int(x),) for x in h], "h bigint")
    held = common.sieve(df, df["h"], 10 ** 9)
    assert len(held.words) == 1 << 10 and held.lets(h).all()


@pytest.mark.parametrize("bits", [27, 6])
def test_keys_of_one_node_are_held_back(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "SIEVE_BITS", bits)
    rng = np.random.default_rng(7)
    own = rng.integers(-1 << 63, (1 << 63) - 1, (300, 40))
    shared = {1: -5, 2: -5, 3: (1 << 63) - 1, 4: (1 << 63) - 1, 5: (1 << 63) - 1}
    rows = [(f"n{i}", [int(x) for x in own[i]] + ([shared[i]] if i in shared else [])) for i in range(300)] + [("none", [])]
    prefixes = spark.createDataFrame(rows, "node string, keys array<bigint>")
    got = pairs.meeting_keys(prefixes, common.Scratch(spark, "t")).collect()
    assert sorted(map(tuple, got)) == sorted((k, f"n{i}") for i, k in shared.items())


def test_keys_that_meet_no_other_are_not_exploded():
    held = common.Sieve(np.zeros(1 << 10, np.uint64), 16)
    keys = np.array([[3, 1 << 62, -9], [1 << 62, 5, 6]])
    held.words[(1 << 62) >> 54] |= np.uint64(1)  # the only range that is held
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["node", "keys"])
    out, = pairs._let_keys(SimpleNamespace(value=held))([batch])
    assert out.to_pydict() == {"key": [1 << 62, 1 << 62], "node": ["a", "b"]}


def test_only_texts_of_pairs_are_compared(spark, monkeypatch):
    sent = spark.sparkContext.accumulator(0)
    plain = pairs._asked

    def counted(shared):
        def run(batches):
            for batch in plain(shared)(batches):
                sent.add(len(batch))
                yield batch
        return run

    monkeypatch.setattr(pairs, "_asked", counted)
    texts = spark.createDataFrame([(f"n{i}", f"a b c d e f{i // 2} g") for i in range(2000)], "node string, text string")
    few = spark.createDataFrame([("n0", "n1"), ("n1", "n2")], "a string, b string")
    got = pairs.compare(few, texts, lambda column: ngram_join.shingle_sets(column, 5)).collect()
    assert sorted(map(tuple, got)) == [("n0", "n1", 3, 3), ("n1", "n2", 1, 5)]
    assert 3 <= sent.value < 200
