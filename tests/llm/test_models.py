"""The two fitted models: held-out accuracy, and the language model's terms
against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from polylabel.llm import common, quality, queries, toxicity

LABELS = "doc_id bigint, quality int, toxic int, score double"


def labelled(spark, rows):
    return spark.createDataFrame([(i, q, t, 0.5) for i, q, t in rows], LABELS)


def words(text):
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def stream(text):
    w = words(text)
    return " " + " ".join(w) + " " if w else ""


TEXTS = ["Hello, World!", None, "", "!!", "Éa b\nc", "x" * 70_000, " 中 文 ", "Hello, World!"]


def test_stream():
    chars, cp, ptr = toxicity.stream(pa.array(TEXTS, pa.string()))
    assert [chars[a:b] for a, b in zip(ptr, ptr[1:])] == [stream(t) for t in TEXTS]
    assert cp.tolist() == [ord(c) for c in chars]


def brute_terms(rows):
    """Kept terms by the formulas of the docstring."""
    n, d = toxicity.ORDER, toxicity.D
    level = {n: {}}
    for text, y in set(rows):
        s = stream(text)
        for g in {s[i:i + n] for i in range(len(s) - n + 1)}:
            level[n].setdefault(g, [0, 0])[y] += 1
    for k in range(n - 1, 0, -1):
        level[k] = {}
        for g, (a, b) in level[k + 1].items():
            c = level[k].setdefault(g[1:], [0, 0])
            c[0] += a > 0
            c[1] += b > 0
    out, below = {}, {}
    for k in range(1, n + 1):
        t = [sum(c[y] for c in level[k].values()) for y in (0, 1)]
        hist = {}
        for g, c in level[k].items():
            h = hist.setdefault(g[:-1], [0, 0, 0, 0])
            for y in (0, 1):
                h[y] += c[y]
                h[2 + y] += c[y] > 0
        now = {}
        for g, c in level[k].items():
            if k == 1:
                q = [(sum(c) + 0.5) / (sum(t) + 0.5 * len(level[1]))] * 2
                low = 0.0
            else:
                *q, low = below[g[1:]]
            h = hist[g[:-1]]
            p = [(max(c[y] - d, 0) + d * h[2 + y] * q[y]) / h[y] if h[y] else q[y] for y in (0, 1)]
            share = 1 / (1 + math.exp(-low) * t[0] / t[1])
            stat = 2 * sum(c[y] * math.log(c[y] / (sum(c) * e)) for y, e in ((1, share), (0, 1 - share)) if c[y])
            tell = stat >= toxicity.G_LEAST
            ratio = math.log(p[1] / p[0]) if tell else low
            if tell:
                out[g] = ratio - low
            now[g] = (*p, ratio)
        below = now
    return out


def corpus(seed, n=240):
    rng = random.Random(seed)
    plain = ["".join(rng.choices(["ta", "re", "lo", "mi", "né"], k=rng.randint(1, 3))) for _ in range(60)]
    rows = []
    for i in range(n):
        w = rng.choices(plain, k=rng.randint(5, 60))
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(max(1, len(w) // 10)):
                w.insert(rng.randrange(len(w)), rng.choice(["zug", "zugta", "Zugre!", "kwo"]))
        rows.append((i, " ".join(w), y))
    return rows


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_terms_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK_TERMS", block)
    rows = corpus(1)
    df = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, label int").coalesce(1)
    kept = toxicity.terms(toxicity.count_grams(df), common.Scratch(spark, "t"))
    got = {r.g: r.value for r in kept.collect()}
    want = brute_terms([(t, y) for _, t, y in rows])
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want) and len(want) > 20
    texts = [(i, t) for i, t, _ in rows[:20]] + [(500 + i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    for r in toxicity.log_ratios(docs, kept).collect():
        s = stream(dict(texts)[r.id])
        total = sum(v * sum(s.startswith(g, i) for i in range(len(s))) for g, v in want.items() if g in s)
        assert r.size == len(s) and abs(r.llr - total) < 1e-6


def test_copies_count_alike_in_every_layout(spark):
    df = spark.createDataFrame([("Zug, zug!", 1)] * 6 + [("Zug, zug!", 0)] * 2, "text string, label int")
    for layout in (df.coalesce(1), df.repartition(5)):
        got = {(r.g, r.a0, r.a1) for r in toxicity.count_grams(layout).collect()}
        assert got == {(g, 2, 6) for g in (" zug ", "zug z", "ug zu", "g zug")}


def auc(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    y = np.array(labels)
    n1, n0 = y.sum(), (1 - y).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_toxicity_held_out(spark, documents):
    rows = corpus(2, 900)
    out = {r.doc_id: r.score for r in toxicity.standard(documents([(i, t) for i, t, _ in rows]), labelled(spark, [(i, 1, y) for i, _, y in rows])).collect()}
    from zlib import crc32
    held = [(out[i], y) for i, _, y in rows if crc32(str(i).encode()) % 4 == 2]
    wrong = sum((s >= 0.3) != y for s, y in held)
    assert len(held) > 100 and wrong <= 0.05 * len(held)


ROWS = [(1, "some text"), (2, None), (3, ""), (4, "x" * 100_000), (5, "a a a"), (5, "a a a"), (None, "b")]


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1), (1, 0, 0), (None, 1, 1), (5, None, None), (4, 7, 9)]])
def test_few_labels(spark, documents, labels):
    tox = toxicity.standard(documents(ROWS), labelled(spark, labels)).collect()
    assert len(tox) == len(set(ROWS)) and all(0 <= r.score <= 1 for r in tox)
    good = quality.quality(documents(ROWS), labelled(spark, labels), toxicity.fold("_label_id", 5) >= 0).collect()
    assert len(good) == len(ROWS) and all(0 <= r.score <= 1 for r in good)


def test_no_documents(spark, documents):
    assert toxicity.standard(documents([]), labelled(spark, [(1, 1, 0)])).collect() == []
    assert quality.quality(documents([]), labelled(spark, [(1, 1, 0)]), toxicity.fold("_label_id", 5) != 0).collect() == []


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_quality_pu(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert auc([r.score for r in got], [r.quality for r in got]) > 0.95
    assert sum(r.predicted != r.quality for r in got) <= 0.1 * len(got)


def test_quality_features_are_per_text():
    texts = ["One two. Two!", "", "A|B|c\nA|B|c\n", "é é é", "x" * 1000]
    both = quality.features(pa.array(texts))
    alone = np.concatenate([quality.features(pa.array([t])) for t in texts])
    assert both.shape == (5, len(quality.NAMES)) and np.allclose(both, alone) and not both[1].any()


def test_toxicity_query(spark):
    got = queries.op7_toxicity_kneser_ney(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def risk(x, trusted, w, prior):
    """The non-negative risk by its definition, row by row."""
    f = [float(np.tanh(r @ w[0] + w[1]) @ w[2] + w[3]) for r in x]
    minus = [np.log1p(np.exp(v)) for v in f]
    plus = [np.log1p(np.exp(-v)) for v in f]
    p = [i for i in range(len(x)) if trusted[i]]
    mean = lambda a, at: sum(a[i] for i in at) / len(at)
    negative = mean(minus, range(len(x))) - prior * mean(minus, p)
    return prior * mean(plus, p) + negative if negative >= 0 else -negative


@pytest.mark.parametrize("prior", [0.2, 0.99])
def test_risk_gradient_by_differences(prior):
    rng = np.random.default_rng(3)
    x, trusted = rng.normal(size=(60, 7)), rng.random(60) < 0.3
    w = [rng.normal(size=(7, 5)), rng.normal(size=5), rng.normal(size=5), np.array(0.3)]
    if prior > 0.9:  # trusted rows score high, the others low: the second part is negative
        w[3] = np.array(-3.0)
        x[trusted] = np.sign(w[2]) @ np.sign(w[0]).T / 3
    parts = [quality.risk_sums(x[a:b], trusted[a:b], w) for a, b in ((0, 1), (1, 40), (40, 60))]
    got = quality.risk_gradient(sum(parts), prior, w)
    negative = sum(parts)[2] / 60 - prior * sum(parts)[3] / trusted.sum()
    assert (negative < 0) == (prior > 0.9)
    for k, a in enumerate(w):
        for at in np.ndindex(a.shape):
            up, down = [b.copy() for b in w], [b.copy() for b in w]
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            want = (risk(x, trusted, up, prior) - risk(x, trusted, down, prior)) / 2e-5
            assert got[k][at] == pytest.approx(want, abs=1e-6)


def test_quality_learns_from_rows_beyond_the_sample(spark, documents, monkeypatch):
    """The risk covers every row: the scores follow rows that the starting
    sample leaves out, and do not depend on the layout."""
    monkeypatch.setattr(quality, "FIT_ROWS", 20)
    rows = [(i, f"Good text number {i}. It has several sentences. They end well.") for i in range(60)]
    labels = labelled(spark, [(i, 1, 0) for i in range(30)])
    noise = [(1000 + i, "BUY NOW $$$ !!! " * 5) for i in range(200)]
    other = [(1000 + i, f"Plain words of another kind {i}") for i in range(200)]
    train = toxicity.fold("_label_id", 5) >= 0
    a = {r.doc_id: r.score for r in quality.quality(documents(rows + noise), labels, train).collect()}
    b = {r.doc_id: r.score for r in quality.quality(documents(rows + noise).repartition(11), labels, train).collect()}
    c = {r.doc_id: r.score for r in quality.quality(documents(rows + other), labels, train).collect()}
    assert all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)
    assert np.mean([a[i] for i in range(60)]) > np.mean([a[i] for i in range(1000, 1200)])
    assert max(abs(a[i] - c[i]) for i in range(60)) > 1e-4
