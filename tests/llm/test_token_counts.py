import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from polylabel.llm import queries, token_counts

PIECES = token_counts.zipf_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def brute(word, pieces):
    """Plain dynamic programming over one pre-token, nothing shared."""
    token = "▁" + word
    byte = min(pieces.values(), default=0) - 10_000_000
    best = [(0, 0)]
    for i in range(1, len(token) + 1):
        size = len(token[i - 1].encode())
        options = [(best[i - 1][0] + byte * size, -(-best[i - 1][1] + size))]
        options += [(best[j][0] + pieces[token[j:i]], best[j][1] - 1) for j in range(i) if token[j:i] in pieces]
        best.append(max(options))
    return -best[-1][1], best[-1][0]


def words(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def totals(text, pieces):
    found = [brute(w, pieces) for w in words(text)]
    return len(found), sum(n for n, _ in found), sum(s for _, s in found)


SMALL = {"▁": -5, "a": -3, "b": -4, "ab": -6, "▁a": -8, "abab": -12, "é": -2, "▁ab": -11}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abé中 \n"), max_size=30), min_size=1, max_size=5))
def test_shared_prefixes_change_nothing(texts):
    raw = [t.encode() for t in texts]
    own = token_counts.Counter(SMALL)
    got = own.count(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    assert list(zip(*(x.tolist() for x in got))) == [totals(t, SMALL) for t in texts]


def test_a_shared_prefix_is_scored_once():
    own = token_counts.Counter(SMALL)
    raw = b"abababa abababb abababab abababa"
    own.count(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert own.trie.nodes == len("▁abababa") + len("b") + len("b")


ROWS = [(1, "The cat the cat\tThe  dog"), (2, None), (3, ""), (4, " \n "), (5, "x" * 3000 + " y"), (6, "naïve 中文 😀"), (6, "naïve 中文 😀"), (None, "a")]


@pytest.mark.parametrize("rows", [[], ROWS])
def test_table(spark, documents, rows):
    got = sorted(map(tuple, token_counts.token_counts(documents(rows), PIECES).collect()), key=str)
    assert got == sorted(((i, *totals(t, PIECES)) for i, t in rows), key=str)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    known = {w: brute(w, PIECES) for w in {w for _, t in rows[:60] for w in words(t)}}
    got = {r.doc_id: (r.n_pretokens, r.n_tokens, r.score) for r in queries.op8_token_counts(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t in rows[:60]:
        assert got[i] == (len(words(t)), sum(known[w][0] for w in words(t)), sum(known[w][1] for w in words(t)))
