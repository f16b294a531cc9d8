"""Registered queries that run the write path as a stream over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import fallback_query_text
from memlake.operators.encode import hashed_encoder
from memlake.schema import SPARSE
from memlake.sources.jobs import job_stream
from memlake.sources.store import MemoryStore
from memlake.sources.workdir import work_dir
from memlake.streaming.ingest import RulePlanner, delete_from_store, ingest_stream
from memlake.workload import Workload


def _line(jobs: DataFrame) -> DataFrame:
    wire = F.to_json(
        F.struct(
            F.col("req_id").alias("ReqId"),
            F.col("user_id").alias("UserId"),
            F.col("messages").alias("Messages"),
            F.col("threshold").alias("Threshold"),
        )
    )
    return jobs.select(wire.alias("value"), "seq")


def expand(messages: Column) -> Column:
    """Stands in for a model: nothing but greetings and repair requests is not worth a search."""
    noise = F.forall(
        messages, lambda m: m["content"].startswith("Hello") | m["content"].startswith("Fix")
    )
    return F.when(noise, "SKIP").otherwise(fallback_query_text(messages))


def run_log(spark: SparkSession, sf_dir: str, deliveries: list[str] | None = None) -> MemoryStore:
    """Write all statement jobs to a log, stream the log into a new store.

    Each delivery is one micro-batch; the one named ``"again"`` repeats the first.
    """
    root = work_dir(spark, "ingest")
    log = f"{root}/log"
    schema = "value string, seq bigint"
    # Put together once, whatever is delivered how often.
    _line(Workload(spark, sf_dir).statement_jobs()).write.parquet(f"{root}/jobs")
    jobs = spark.read.schema(schema).parquet(f"{root}/jobs")
    spark.createDataFrame([], schema).write.parquet(log)
    half = F.floor(jobs.agg(F.max("seq")).scalar() / 2)
    parts = {
        "early": jobs.where(F.col("seq") < half),
        "late": jobs.where(F.col("seq") >= half),
        "again": jobs.where(F.col("seq") < half),
    }
    store = MemoryStore.create(spark, f"{root}/store")
    for name in deliveries or ["early", "late"]:
        parts[name].write.mode("append").parquet(log)
        lines = job_stream(spark, log, "parquet", schema)
        ingest_stream(
            lines, store, RulePlanner(), hashed_encoder(), f"{root}/checkpoint", expand=expand
        ).awaitTermination()
    return store


def stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General memories after the whole log has been streamed in."""
    general = run_log(spark, sf_dir).general()
    return general.select(
        "user_id", "memory_id", "memory_text",
        F.size("dense").alias("dim"), F.size("sparse.indices").alias("n_terms"),
    )


def stream_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core profiles after the whole log has been streamed in."""
    return run_log(spark, sf_dir).core()


def dedup_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fate of every job when half of the log is delivered twice."""
    store = run_log(spark, sf_dir, ["early", "late", "again"])
    return store.log("jobs").groupBy("req_id").agg(
        F.count(F.when(F.col("status") == "accepted", 1)).alias("applied"),
        F.count(F.when(F.col("status") == "replayed", 1)).alias("replayed"),
    )


def ingest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per micro-batch, the first delivery coming twice."""
    return run_log(spark, sf_dir, ["early", "late", "again"]).log("audit")


def _store_of_facts(spark: SparkSession, w: Workload) -> MemoryStore:
    missing = {"dense": F.lit(None).cast("array<float>"), "sparse": F.lit(None).cast(SPARSE)}
    facts = w.base_facts().withColumns(missing)
    return MemoryStore.create(spark, f"{work_dir(spark, 'facts')}/store", general=facts)


def delete_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store of facts holds after all delete requests have been applied to it."""
    w = Workload(spark, sf_dir)
    store = _store_of_facts(spark, w)
    delete_from_store(w.delete_requests(), store)
    return store.general().select("user_id", "memory_id", "memory_text")


def delete_stored_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all delete requests applied to a store of facts."""
    w = Workload(spark, sf_dir)
    audit = delete_from_store(w.delete_requests(), _store_of_facts(spark, w))
    return audit.withColumn("request_id", F.col("request_id").cast("bigint"))


STREAM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_apply": stream_apply,
    "stream_core": stream_core,
    "dedup_replay": dedup_replay,
    "ingest_audit": ingest_audit,
    "delete_stored": delete_stored,
    "delete_stored_audit": delete_stored_audit,
}
