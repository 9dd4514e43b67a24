"""The corpus pipeline: quality filter, exact and near deduplication, mixing, tokenising.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and returns a
DataFrame; all but the last return the columns of documents. Nulls, empty texts and empty tables
are handled as the operators say; extra columns are carried along up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm import bpe, exact_dedup, minhash, mixing, quality
from panelwise.llm.common import table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier gives THRESHOLD or more; a score at the threshold stays.

    Null and empty texts are scored like any other and repeated rows one by one. Without labels of both
    classes every text has the same score, so all stay or all go. Empty tables stay empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = "_score"
    while score.lower() in {c.lower() for c in docs.columns}:
        score += "_"
    return quality.with_scores(docs, model, score).where(F.col(score) >= quality.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id; null text is the empty
    text, and of rows that repeat an id and a text one stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest doc_id. Empty texts link
    with nothing and stay, as do rows with a null doc_id; rows that repeat a doc_id stay or go together."""
    return minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times. Null is a source of its
    own; empty texts have no words and are not taken more than any other of their source. Reruns agree."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids, decodes``: the token ids of each document of the mix, and
    whether they decode to its text."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    encoded = bpe.encoded(docs.select("doc_id", "source", "text", digest.alias("digest")), ranks, public_tokenizers.PATTERN, keep=["doc_id", "source", "digest"], also=["back"])
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          (F.sha2("ids_back", 256) == F.col("digest")).alias("decodes"))


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix", mix),
    ("tokens", tokens),
]

#: Trained models, MinHash and random rounding are not for SQL; the tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
