"""Registered queries of the llm operators, one ``opN_<name>`` each, over the
whole table, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from polylabel.llm import bpe, common, conversations, decontam, fingerprints, line_dedup, maxscore, ngram_join, quality, secrets, token_counts, toxicity, warc, whitening

QUERIES = {}
ORACLE = {}


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_benchmark_decontamination(spark, sf_dir):
    out = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@query
def op2_byte_bpe(spark, sf_dir):
    out = bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_warc(spark, sf_dir):
    archives = warc.write(_table(spark, sf_dir, "pages"), common.Scratch(spark, "op6").root)
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query
def op5_maxscore(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return maxscore.top_k(vectors.filter("vec_id % 50 = 0"), vectors, 5)


ORACLE["op5_maxscore"] = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query
def op8_token_counts(spark, sf_dir):
    pieces = token_counts.zipf_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), pieces)


def secret_digest(spans, id_col="doc_id"):
    """Counts and digests of ``secrets.secret_spans``."""
    join = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(id_col, *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
                        F.sha2(join(base), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"), count("literal").alias("n_literal"))


@query
def op4_secret_scan(spark, sf_dir):
    return secret_digest(secrets.secret_spans(_table(spark, sf_dir, "documents")))


@query
def op1_ngram_jaccard(spark, sf_dir):
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark, sf_dir):
    out = line_dedup.deduplicate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"),
                      F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"),
                      F.sha2("text", 256).alias("text_sha256"))


@query
def op7_toxicity_kneser_ney(spark, sf_dir):
    out = toxicity.standard(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", (toxicity.fold("doc_id", 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"), "size", "llr_per_char")


@query
def op3_quality_pu(spark, sf_dir):
    out = quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), toxicity.fold("_label_id", 5) != 0)
    return out.select("doc_id", (toxicity.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op13_embedding_whitening(spark, sf_dir):
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    out = out.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "explained", "identity_error",
                     F.posexplode("whitened").alias("at", "value"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"),
                      F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")


@query
def op11_conversation_repair(spark, sf_dir):
    report, _ = conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")))
    return report.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "rows")


@query
def op12_document_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))
