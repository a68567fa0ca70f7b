import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from polylabel.llm import bpe
from test_decontam import brute as windows
from test_line_dedup import SPACE, shingles as line_shingles
from test_ngram_join import brute as near

SF = "/root/testdata/sf0.001"
BENCH = "Once six seven eight brave owls met under the old stone bridge to plan a feast"


def alike(x, y):
    return 100 * len(x & y) >= 80 * len(x | y)


def test_stages(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"word{i}" for i in range(120))
    extra = [
        (90001, "Clean words here stay as they are, every one of them untouched by any stage"), (90002, None), (90003, ""), (90004, " \n "),
        (90005, "Lead in. " + BENCH + " and out."), (90006, "copy of one line only"), (90007, "copy of one line only"),
        (90008, "\n".join(long[i:i + 90] for i in range(0, 900, 90))), (90009, long + " end"), (90009, long + " end"),
        (None, "a row without an id, kept to the end of it all"), (90010, "first part\nshared passage " + long[:300]),
        (90011, "shared passage " + long[:300] + "\nother part of this one"),
    ]
    rows = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in extra], base.schema)
    base.unionByName(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(
        spark.createDataFrame([(7777, BENCH)], "item_id bigint, text string")).write.parquet(f"{tmp_path}/benchmark.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [[(r.doc_id, r.text) for r in docs.collect()]]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert docs.columns == base.columns, name
            seen.append([(r.doc_id, r.text) for r in docs.collect()])
    start, calm, lined, single, clean = seen
    assert set(calm) <= set(start) and len(calm) > 0.7 * len(start)
    # no two lines alike, and every line was there before
    lines = [x for _, t in lined for x in (t or "").split("\n") if x.strip(SPACE)]
    before = {x for _, t in calm for x in (t or "").split("\n")}
    assert set(lines) <= before
    texts = {x.strip(SPACE) for x in lines}
    sets = sorted(((len(line_shingles(x)), line_shingles(x)) for x in texts), key=lambda p: p[0])
    missed = sum(alike(x, y) for i, (n, x) in enumerate(sets) for m, y in sets[i + 1:] if m * 0.8 <= n)
    assert missed <= 2  # banding at its stated recall
    ids = {i for i, _ in lined}
    assert {90001, 90002, 90003, 90004, 90006, 90010, 90011, None} <= ids and 90007 not in ids
    # one document of each group stays
    assert sorted(single, key=str) == sorted((r for r, (i, _, c) in zip(sorted(lined, key=str), [
        next(x for x in near(lined) if x[0] == r[0]) for r in sorted(lined, key=str)]) if i == c), key=str)
    bad = {i for i, *_, hit in windows(single, bench) if hit}
    assert 90005 in bad and {i for i, _ in clean} == {i for i, _ in single} - bad
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))))
    want = sorted(((i, enc.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in clean), key=str)
    assert sorted(((r.doc_id, r.ids, r.decoded_sha256) for r in docs.collect()), key=str) == want
    text = dict(clean)
    assert text[90001] == extra[0][1] and re.match("a row without", text[None])


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
