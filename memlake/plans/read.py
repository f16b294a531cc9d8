"""The read path: requests in, memories out.  It never writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.encode import Encoder, encode, mark_query
from memlake.operators.requests import clean_user_keys, resolve_query_text, stamp_requests
from memlake.operators.retrieve import get_all_memories, get_core, hybrid_hits, retrieve_with_core, with_texts


def search_texts(requests: DataFrame) -> DataFrame:
    """Requests (query_id, user_id, messages, query, threshold) to texts to search with.

    Requests that ask for nothing or carry an empty message list have no result.
    """
    stamped = stamp_requests(resolve_query_text(requests))
    return stamped.where(F.col("query_text").isNotNull()).select(
        "query_id", "user_id", "threshold", mark_query(F.col("query_text")).alias("text")
    )


def search_queries(requests: DataFrame, encoder: Encoder) -> DataFrame:
    """Requests to encoded searches."""
    return encode(search_texts(requests), "text", encoder).drop("text")


def search_hits(asked: DataFrame, general: DataFrame, encoder: Encoder, **search) -> DataFrame:
    """Ranked hits of texts to search with (query_id, user_id, threshold, text).

    Queries are counted before they are encoded, so each text is encoded once.
    """
    sizes = {
        "query_sizes": asked.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_queries")),
        "memory_sizes": general.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_memories")),
        "sizes_complete": True,
    }
    queries = encode(asked, "text", encoder).drop("text")
    return with_texts(hybrid_hits(queries, general, **(sizes | search)), general)


def get_memories(
    requests: DataFrame,
    general: DataFrame,
    core: DataFrame,
    encoder: Encoder,
    **search,
) -> DataFrame:
    """The core profile and the best general memories for every request, in one plan."""
    asked = search_texts(requests)
    return retrieve_with_core(asked, search_hits(asked, general, encoder, **search), core)


def _accepted(keys: DataFrame) -> DataFrame:
    """Users of raw keys (column ``user_id``), quotes and blanks removed; empty keys are rejected."""
    return clean_user_keys(keys).where(F.col("reason").isNull()).select("user_id").distinct()


def all_of(keys: DataFrame, general: DataFrame, core: DataFrame) -> DataFrame:
    """Every memory of the users that raw keys name, core ones in stored order first."""
    return get_all_memories(general, core, _accepted(keys))


def core_of(keys: DataFrame, core: DataFrame) -> DataFrame:
    """The core profiles of the users that raw keys name; order by (ord, ord_pos)."""
    return get_core(core, _accepted(keys))
