import hashlib
import re

import pytest

from polylabel.llm import decontam, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s:s + 10]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = set()
    for i, t in docs:
        w = WORD.findall(low(t))
        hit, found = set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (x := tuple(w[s:s + k])) in windows:
                    hit.update(range(s, s + k))
                    found |= windows[x]
        out.add((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def digest(df):
    from pyspark.sql import functions as F
    return {tuple(r) for r in df.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids"), F.sha2(F.array_join("item_ids", ","), 256), "contaminated").collect()}


PASSAGE = "One two Three four five six seven EIGHT nine ten eleven twelve"
ITEMS = [(1, PASSAGE), (2, "x1 " + PASSAGE), (3, "short Item"), (4, None), (5, "?!"), (6, "straße"), (10, "a a a a a a a a a a a a")]
DOCS = [
    (1, "zero " + PASSAGE.lower().replace(" ", ", ") + " end"), (2, None), (3, ""), (4, "!!"), (5, "a short item here; SHORT-ITEM"),
    (6, "one two three four five six seven eight nine tem"), (7, "Straße"), (8, "a " * 9), (9, "a " * 25), (9, "a " * 25),
    (11, "ten"), (12, PASSAGE + " " + PASSAGE + " " + "pad " * 30000 + PASSAGE), (None, "short item"), (13, "short\u00a0item"),
]


def test_small_cases(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert digest(decontam.contamination(documents(DOCS), items)) == brute(DOCS, ITEMS)


def test_index_blocks_give_the_same(spark, documents, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 3)
    monkeypatch.setattr(decontam, "BLOCK_KEYS", 40)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert digest(decontam.contamination(documents(DOCS), items)) == brute(DOCS, ITEMS)


@pytest.mark.parametrize("docs, items", [([], ITEMS), (DOCS, []), ([], [])])
def test_empty_tables(spark, documents, docs, items):
    got = digest(decontam.contamination(documents(docs), spark.createDataFrame(items, "item_id bigint, text string")))
    assert got == brute(docs, items)


def test_decontaminate_keeps_columns_and_clean_rows(spark, documents):
    docs = documents(DOCS)
    kept = decontam.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, *_, bad in brute(DOCS, ITEMS) if not bad}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {tuple(r) for r in queries.op10_benchmark_decontamination(spark, sf).collect()}
    assert got == brute(docs, items)
