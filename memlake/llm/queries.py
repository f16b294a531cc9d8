"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import (
    bpe,
    chunks,
    decontaminate,
    html,
    jaccard,
    merkle,
    negatives,
    pii,
    quality,
    secret_scan,
    token_counts,
    toxicity,
    urls,
)
from memlake.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(
        _read(spark, sf_dir, "documents"),
        public_tokenizers.path(RANKS),
        public_tokenizers.PATTERN,
        keep=["doc_id"],
        decoded=True,
    )
    return bpe.digests(encoded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def _written(spans: str):
    """kind:start:end of an array of spans, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *(f"n_{kind}" for kind in pii.KINDS),
        F.sha2(_written("base_spans"), 256).alias("base_sha256"),
        _written("spans").alias("spans"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.passages(_read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), keep=["doc_id"])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.judge(docs, model, keep=["doc_id"])


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select("doc_id", F.inline("leaks"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), urls.train(urls.labelled_urls(spark)), keep=["page_id"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *(f"n_{kind}" for kind in secret_scan.BASE_KINDS),
        F.sha2(_written("base_spans"), 256).alias("base_sha256"),
        _written("spans").alias("spans"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.audit(_read(spark, sf_dir, "documents"), seventh)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=moved)


QUERIES = {
    query.__name__: query
    for query in (
        op1_byte_bpe,
        op2_pii,
        op3_substring_dedup,
        op4_token_counts,
        op5_quality_rules,
        op6_html_extraction,
        op7_jaccard_join,
        op8_decontamination,
        op9_url_filters,
        op10_toxicity,
        op11_secret_scan,
        op12_merkle_manifest,
        op13_hard_negatives,
    )
}
