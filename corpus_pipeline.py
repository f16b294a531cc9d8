"""From raw documents to token ids: quality rules, near duplicates, benchmark passages, personal data, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlake.llm import stages
from memlake.llm.batches import stored

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("jaccard_join", stages.jaccard_join),
    ("decontamination", stages.decontamination),
    ("pii", stages.pii_masked),
    ("byte_bpe", stages.byte_bpe),
]

#: No SQL: quality rules are a trained model and BPE has no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
