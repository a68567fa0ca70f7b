import base64
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polylabel.llm import fingerprints as P
from polylabel.llm import queries

TEXT = st.text(alphabet="abé😀 \n", max_size=60)


@settings(max_examples=60, deadline=None)
@given(TEXT, TEXT, st.data())
def test_spans_and_extensions(x, y, data):
    p, q = P.Prefixes(x), P.Prefixes(y)
    i = data.draw(st.integers(0, len(x)))
    j = data.draw(st.integers(0, len(y)))
    length = data.draw(st.integers(0, min(len(x) - i, len(y) - j)))
    assert bool(p.equal(i, q, j, length)) == (x[i:i + length] == y[j:j + length])
    ahead = next((k for k in range(min(len(x) - i, len(y) - j)) if x[i + k] != y[j + k]), min(len(x) - i, len(y) - j))
    back = next((k for k in range(min(i, j)) if x[i - 1 - k] != y[j - 1 - k]), min(i, j))
    assert int(p.extension(i, q, j)) == ahead and int(p.extension(i, q, j, backward=True)) == back


def test_prefix_array_by_definition():
    text = "prefix 😀 hashes " * 9
    for base in P.BASES:
        want, h = [0], 0
        for i, c in enumerate(text):
            h = (h + (ord(c) + 1) * pow(base, i, P.PRIME)) % P.PRIME
            want.append(h)
        assert P.prefix_array(P.code_points(text), base).tolist() == want
    many = P.Prefixes(text).extension([0, 1, 2], P.Prefixes(text), [16, 17, 16])
    assert many.tolist() == [len(text) - 16, len(text) - 17, 0]


def texts(seed, n, size):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij klmnop") for _ in range(r.randint(0, size))) for _ in range(n)]


def test_slices_do_not_matter(monkeypatch):
    for text in [*texts(1, 5, 900), "aaaa" * 200, "x", ""]:
        want = P.fingerprint(text)
        for size in (64, 100, 255, 512):
            monkeypatch.setattr(P, "SLICE", size)
            assert P.fingerprint(text) == want
        monkeypatch.undo()


def test_likeness():
    r = random.Random(4)
    for n in (0, 1, 2, 3, 16, 17, 33, 64, 65, 200, 5000):
        x, y = ("".join(r.choice("abcdefghijklmnop ") for _ in range(n)) for _ in range(2))
        f = P.fingerprint(x)
        assert P.likeness(f, P.fingerprint(str(x))) == 1.0
        edit = P.likeness(f, P.fingerprint(P.spliced(x, y)))
        assert edit == 1.0 or 0.43 <= edit < 0.75
        if n >= 64:
            assert P.likeness(f, P.fingerprint(y)) < 0.1
            moved = x[n // 3:] + x[:n // 3]
            assert P.likeness(f, P.fingerprint(moved)) > 0.3
            inserted = x[:n // 2] + "@@@" + x[n // 2:]
            assert P.likeness(f, P.fingerprint(inserted)) > 0.85
    assert len({P.fingerprint(t) for t in {*texts(5, 400, 30), "", "\0", "\0\0", "a"}}) == len({*texts(5, 400, 30), "", "\0", "\0\0", "a"})


def brute(rows, tie):
    """The contract by plain loops, over (id, text) in their order."""
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]], r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        f, e, g = P.fingerprint(t), P.fingerprint(edited), P.fingerprint(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), base64.b64encode(f).decode(), base64.b64encode(e).decode(),
                    P.likeness(f, e), P.likeness(f, g)))
    return sorted(out, key=str)


def hashes(spark, rows):
    df = spark.createDataFrame([(t or "",) for _, t in rows], "text string")
    return {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()}


@pytest.mark.parametrize("case", ["mixed", "one", "none", "one id"])
def test_brute_force(spark, documents, case):
    rows = {"mixed": [(i * 3, t) for i, t in enumerate(texts(7, 120, 300))]
            + [(3, "again"), (3, "again"), (3, None), (None, "no id"), (None, "nor here"), (900, ""), (901, "é😀" * 50), (902, "x" * 300_000)],
            "one": [(5, "alone here")], "none": [], "one id": [(1, t) for t in texts(8, 300, 80)]}[case]
    got = P.fingerprints(documents(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == (brute(rows, hashes(spark, rows)) if rows else [])


def test_ids_of_another_type(spark):
    rows = [("b", "second text"), ("a", "first text"), (None, "last text")]
    got = {r.key: r for r in P.fingerprints(spark.createDataFrame(rows, "key string, body string"), "key", "body").collect()}
    half = lambda x, y: hashlib.sha256(P.spliced(x, y).encode()).hexdigest()
    assert got["b"].edited_sha256 == half("second text", "first text")
    assert got["a"].edited_sha256 == half("first text", "last text")
    assert got[None].edited_sha256 == half("last text", "second text")


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert P.fingerprints(df).first().n_chars == 3


def test_extensions(spark):
    rows = [(1, "abcdef", "abcxef", 9), (2, None, "a", 8), (3, "same", "same", 7)]
    got = P.extensions(spark.createDataFrame(rows, "i int, x string, y string, common_prefix int"), "x", "y").collect()
    assert [(r.i, r.common_prefix, r.common_suffix) for r in got] == [(1, 3, 2), (2, 0, 0), (3, 4, 4)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op12_document_fingerprints"](spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, hashes(spark, rows))
    assert np.mean([r.near_edited > r.near_next for r in got if r.near_next < 0.9]) > 0.95
