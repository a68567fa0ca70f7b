"""Corpus pipeline: documents to token ids, in five stages.

1. toxicity: documents that the toxicity model rejects go;
2. line dedup: of similar lines one stays, and documents whose every line went
   go with them (a text without any line to compare stays as it is);
3. n-gram Jaccard join: of each group of near duplicates the document with the
   smallest id stays;
4. benchmark decontamination: documents that hold a benchmark window go;
5. byte-level BPE: the kept texts become token ids, decoded again as a check.

Each stage works on all that the one before kept, and the first four return
the columns of ``documents``. Nulls, empty and long texts, repeated rows, empty
tables and extra columns are treated as the operators' docstrings say: a
document with a null id, or a null or empty text, passes the first four stages
and has no tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from polylabel.llm import bpe, common, decontam, line_dedup, ngram_join, toxicity

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark, docs, sf_dir):
    """Documents that score below the threshold."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark, docs, sf_dir):
    """Documents without the lines that stay elsewhere; ``n_chars`` follows
    the text. A document that had lines and has none left goes."""
    return line_dedup.shortened(docs)


def dedup_documents(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents without a benchmark window."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark, docs, sf_dir):
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each document."""
    out = bpe.round_trip(docs, public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

# MinHash banding, model scores and BPE are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``, each stage's rows written as Parquet
    and read again. Returns the last stage's rows."""
    scratch = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.stage(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
