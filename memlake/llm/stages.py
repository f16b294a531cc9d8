"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import bpe, decontaminate, jaccard, pii, quality
from memlake.llm.batches import stored
from memlake.llm.queries import RANKS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; labels are matched with the documents at hand."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.judge(docs, quality.train(docs, labels))
    return judged.where("kept").select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones, one with the smallest id; documents without id stay.

    Rows go by id and text, so rows with the same id and other texts are judged each by its own links; of rows with the
    same id and text one stays.
    """
    row = ["doc_id", "text_key"]
    joined = jaccard.join(docs, keys=True).select(*row, "component", "component_id")
    joined = stored(joined, "components").where("doc_id is not null")
    keyed = docs.withColumn("text_key", jaccard.text_key("text"))
    kept = keyed.join(jaccard.bounded(joined.where("component_id < doc_id").select(row).distinct()), row, "left_anti")
    again = joined.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.take(1):
        return kept.select(docs.columns)
    again = jaccard.bounded(again)
    # Of different texts with one id that are linked, the one with the smallest key.
    smallest = joined.where("component_id = doc_id and component is not null").join(again, "doc_id", "left_semi")
    first = smallest.groupBy("doc_id", "component").agg(F.min("text_key").alias("first"))
    others = smallest.join(first, ["doc_id", "component"]).where("text_key <> first").select(row).distinct()
    kept = kept.join(jaccard.bounded(others), row, "left_anti")
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark passage."""
    marked = decontaminate.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(F.size("leaks") == 0).select(docs.columns)


def pii_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows."""
    found = pii.find(docs)
    text = F.col("masked")
    return found.select(
        *(
            text.alias("text") if name == "text" else F.length(text).cast("long").alias("n_chars") if name == "n_chars" else name
            for name in docs.columns
        )
    )


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids, their number, and the digests of ids and decoded bytes."""
    encoded = bpe.encode(
        docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id"], decoded=True
    )
    return bpe.digests(encoded).drop("decoded")
