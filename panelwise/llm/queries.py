"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from panelwise.llm import bpe, embeddings, exact_dedup, minhash, mixing, packing, pii, quality, search, suffix, toxicity, variants, warc
from panelwise.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.with_scores(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(pii.of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return spans.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe.encoded(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"], also=["raw", "back"])
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_raw", 256).alias("ids_sha256"), F.sha2("ids_back", 256).alias("decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, grammar).select(
        "doc_id", quality.held_out(F.col("doc_id"), toxicity.FOLDS, toxicity.HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_classes(table(spark, sf_dir, "documents"))


def op6_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    _, shards = warc.archive(pages)
    return warc.read_back(pages, shards).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_trie_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_blocked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS ts FROM documents
), d AS (
  SELECT k, doc_id, len(ts) AS n FROM t WHERE len(ts) > 0
), g AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d
), q AS (
  SELECT DISTINCT item_no, item_id, unnest(ts) AS term
  FROM (SELECT row_number() OVER () AS item_no, item_id, {_TERMS} AS ts FROM benchmark)
), f AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ts) AS term FROM t)
  WHERE term IN (SELECT term FROM q) GROUP BY k, term
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term
), s AS (
  SELECT item_no, any_value(item_id) AS item_id, k, any_value(doc_id) AS doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN d USING (k), g
  GROUP BY item_no, k
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM s WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_weak_supervision_pii": op2_weak_supervision_pii,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_toxicity": op4_toxicity,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_prefix_doubling": op6_prefix_doubling,
        "op7_cross_polytope": op7_cross_polytope,
        "op8_source_mix": op8_source_mix,
        "op9_minhash": op9_minhash,
        "op10_warc_index": op10_warc_index,
        "op11_vector_best_fit": op11_vector_best_fit,
        "op12_trie_frontier": op12_trie_frontier,
        "op13_blocked_search": op13_blocked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op10_warc_index": OP10_SQL, "op13_blocked_search": OP13_SQL}
