import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from polylabel.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.parse_ranks(bpe.read_ranks(PATH))
BASE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def pieces(texts):
    """Slices of the scan over all texts at once."""
    data = "".join(texts)
    cp = np.frombuffer(data.encode("utf-32-le"), np.uint32)
    first, at = np.zeros(len(cp), bool), 0
    for t in texts:
        if t:
            first[at] = True
        at += len(t)
    b = bpe.boundaries(bpe.symbols(cp, first)).tolist() + [len(data)]
    return [data[x:y] for x, y in zip(b, b[1:])]


ALPHABET = st.sampled_from(list("'''strevlmd  \t\n aZé9٣!.,<|>中\U0001F600"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), max_size=6))
def test_boundaries_equal_the_pattern(texts):
    assert pieces(texts) == [m for t in texts for m in regex.findall(public_tokenizers.PATTERN, t)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=60), min_size=1, max_size=5))
def test_codec_equals_the_library(texts):
    own = bpe.codec(bpe.read_ranks(PATH))
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.cumsum([0] + [len(r) for r in raw])
    ids, counts = own.encode(buf, offs)
    assert ids.tolist() == [i for t in texts for i in BASE.encode_ordinary(t)]
    back, sizes = own.decode(ids, counts)
    assert back.tobytes() == buf.tobytes() and sizes.tolist() == [len(r) for r in raw]


ROWS = [(1, "It's the cat's   whiskers, they'll\n\n say 12 345!  "), (2, None), (3, ""), (3, ""), (4, "x" * 70_000),
        (5, "naïve café 中文 <|endoftext|> 😀 '' 's 're'd"), (None, "dup"), (6, " " * 5000 + "a b" * 20000)]


def test_encode_decode_and_offsets(spark, documents):
    enc = bpe.encode(documents(ROWS), PATH)
    got = sorted(((r.doc_id, r.ids, r.offsets) for r in enc.collect()), key=str)
    want = []
    for i, t in ROWS:
        ids = BASE.encode_ordinary(t or "")
        n = [len(BASE.decode_single_token_bytes(x)) for x in ids]
        want.append((i, ids, [sum(n[:k]) for k in range(len(n))] if len(n) < 100 else np.cumsum([0] + n)[:-1].tolist()))
    assert got == sorted(want, key=str)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(enc, PATH).collect()}
    assert back == {i: (t or "").encode() for i, t in ROWS}
    part = {r.doc_id: bytes(r.decoded) for r in bpe.decode(enc, PATH, offsets_col="offsets", from_byte=4, to_byte=8).collect()}
    assert part[1] == b" the"


@pytest.mark.parametrize("rows", [[], ROWS])
def test_round_trip(spark, documents, rows):
    got = sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in bpe.round_trip(documents(rows), PATH).collect())
    assert got == sorted((str(i), BASE.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in queries.op2_byte_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = BASE.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == want
