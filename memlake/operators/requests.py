"""Request handling and context building.  All of it is row-local: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import (
    context_query_text,
    fallback_query_text,
    last_user_content,
    transcript_text,
    trim_user_key,
)
from memlake.schema import CONTEXT_BYTES, FALLBACK_BYTES, READ_THRESHOLD


def stamp_requests(requests: DataFrame, default: float = READ_THRESHOLD) -> DataFrame:
    """Give retrieval requests without a threshold (0 or null) the default one."""
    given = F.nullif(F.col("threshold").cast("double"), F.lit(0.0))
    return requests.withColumn("threshold", F.coalesce(given, F.lit(default)))


def clean_user_keys(requests: DataFrame, key: str = "user_id") -> DataFrame:
    """Trim user keys; ``reason`` is set where nothing is left of one."""
    clean = trim_user_key(key)
    return requests.withColumn(key, clean).withColumn(
        "reason",
        F.when(F.coalesce(F.col(key), F.lit("")) == "", F.lit("empty user key")),
    )


def resolve_query_text(requests: DataFrame, limit: int = CONTEXT_BYTES) -> DataFrame:
    """Choose the text to search for; adds ``query_text`` and ``status``.

    Messages win over a query.  A message list that is there but empty is an
    error; a request with neither list nor query has no result.
    """
    has_list = F.col("messages").isNotNull()
    filled = has_list & (F.size("messages") > 0)
    has_query = F.coalesce(F.col("query"), F.lit("")) != ""
    return requests.withColumn(
        "status",
        F.when(filled, "messages")
        .when(has_list, "error")
        .when(has_query, "query")
        .otherwise("none"),
    ).withColumn(
        "query_text",
        F.when(filled, context_query_text("messages", limit)).when(
            ~has_list & has_query, F.col("query")
        ),
    )


def explode_turns(jobs: DataFrame) -> DataFrame:
    """One row per message, numbered in order; a job without messages keeps one row."""
    return jobs.select(
        "req_id", "user_id", F.posexplode_outer("messages").alias("turn", "m")
    ).select("req_id", "user_id", "turn", "m.role", "m.content")


def add_transcript(jobs: DataFrame, role_aliases: dict[str, str] | None = None) -> DataFrame:
    """Adds ``transcript``: the conversation as prefixed lines."""
    return jobs.withColumn("transcript", transcript_text("messages", role_aliases))


def add_context_query(jobs: DataFrame, limit: int = CONTEXT_BYTES) -> DataFrame:
    """Adds ``context_query``: the newest sentences up to a byte budget."""
    return jobs.withColumn("context_query", context_query_text("messages", limit))


def add_fallback_query(jobs: DataFrame, limit: int = FALLBACK_BYTES) -> DataFrame:
    """Adds ``fallback_query``: used where no expanded query could be had."""
    return jobs.withColumn("fallback_query", fallback_query_text("messages", limit))


def add_last_user_turn(jobs: DataFrame) -> DataFrame:
    """Adds ``last_user_turn`` (empty if none) and ``found``."""
    said = last_user_content("messages")
    return jobs.withColumn("last_user_turn", F.coalesce(said, F.lit(""))).withColumn(
        "found", said.isNotNull()
    )


def skip_gate(jobs: DataFrame, query: str = "expanded_query") -> DataFrame:
    """Adds ``required``: false where the expanded query is exactly "skip" in any case."""
    return jobs.withColumn("required", F.coalesce(F.lower(F.col(query)), F.lit("")) != "skip")
