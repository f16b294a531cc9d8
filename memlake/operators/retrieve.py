"""Hybrid retrieval: two ranked lists per query, fused, cut, and headed by the core profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.score import score_cells
from memlake.schema import BRANCH_LIMIT, RANK_BASE, RESULT_LIMIT, RRF_K

# Scores are compared to nine digits, so that sums taken in another order tie.
_DIGITS = 9

KEY = ("user_id", "memory_id")


def rank_lists(candidates: DataFrame, k: int) -> DataFrame:
    """Best ``k`` candidates per query and branch, ranked from 1.

    The rows are hashed by query alone; every later step of the fusion groups
    or ranks by a key that starts with it and needs no further shuffle.
    """
    order = Window.partitionBy("query_id", "branch").orderBy(
        F.round("score", _DIGITS).desc(), "memory_id"
    )
    return (
        candidates.repartition("query_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def branch_topk(
    queries: DataFrame, memories: DataFrame, k: int = BRANCH_LIMIT, **cells
) -> DataFrame:
    """Ranked lists of both branches, each the exact top ``k`` among the user's memories."""
    return rank_lists(score_cells(queries, memories, k, **cells), k)


def dense_topk(
    queries: DataFrame, memories: DataFrame, k: int = BRANCH_LIMIT, **cells
) -> DataFrame:
    """Top ``k`` by cosine similarity (a zero vector has similarity 0 to all)."""
    return branch_topk(queries, memories, k, branches=("dense",), **cells)


def sparse_topk(
    queries: DataFrame, memories: DataFrame, k: int = BRANCH_LIMIT, **cells
) -> DataFrame:
    """Top ``k`` by dot product; a memory sharing no index is no candidate."""
    return branch_topk(queries, memories, k, branches=("sparse",), **cells)


def rrf_fuse(
    lists: DataFrame,
    rrf_k: float = RRF_K,
    rank_base: int = RANK_BASE,
    limit: int = RESULT_LIMIT,
) -> DataFrame:
    """Reciprocal-rank fusion: ``sum over lists of 1 / (rrf_k + rank)``, best ``limit``.

    Constant, rank base and limit belong together with the threshold: with
    ``rrf_k=2`` and ranks from 0 a memory first in both lists scores 1, with
    ``rrf_k=60`` nothing exceeds 2/60 and no usual threshold is reached.
    """
    fused = lists.groupBy("query_id", "user_id", "threshold", "memory_id").agg(
        F.sum(1.0 / (F.col("rank") - 1 + rank_base + rrf_k)).alias("score")
    )
    order = Window.partitionBy("query_id").orderBy(
        F.round("score", _DIGITS).desc(), "memory_id"
    )
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def score_cut(fused: DataFrame) -> DataFrame:
    """Keep what reaches its query's threshold.  Ranks stay dense, as the list is sorted."""
    return fused.where(F.col("score") >= F.col("threshold"))


def hybrid_hits(
    queries: DataFrame,
    memories: DataFrame,
    branch_limit: int = BRANCH_LIMIT,
    limit: int = RESULT_LIMIT,
    rrf_k: float = RRF_K,
    rank_base: int = RANK_BASE,
    **cells,
) -> DataFrame:
    """(query_id, user_id, threshold, memory_id, score, rank) of the surviving memories."""
    lists = branch_topk(queries, memories, branch_limit, **cells)
    return score_cut(rrf_fuse(lists, rrf_k, rank_base, limit))


def with_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits to memories: adds the text, drops rows that lack one, adds the type."""
    return (
        hits.join(texts.select("user_id", "memory_id", "memory_text"), ["user_id", "memory_id"])
        .where(F.col("memory_text").isNotNull())
        .withColumn("type", F.lit("general"))
    )


def retrieve_with_core(queries: DataFrame, general: DataFrame, core: DataFrame) -> DataFrame:
    """Every query's core profile in stored order, then its general hits in rank order.

    ``tier_ord`` is 0 for core and 1 for general; within a tier rows are
    ordered by (ord, ord_pos).  Core has neither score nor cut, and the tiers
    are not de-duplicated.  A query without any memory has no rows.
    """
    out = ["query_id", "user_id", "tier_ord", "ord", "ord_pos", "memory_id", "memory_text", "type"]
    profile = (
        queries.select("query_id", "user_id")
        .join(core, "user_id")
        .withColumn("tier_ord", F.lit(0))
        .withColumn("type", F.lit("core"))
    )
    found = (
        general.withColumn("tier_ord", F.lit(1))
        .withColumn("ord", F.col("rank").cast("bigint"))
        .withColumn("ord_pos", F.lit(0).cast("bigint"))
    )
    return profile.select(out).unionByName(found.select(out))


def of_users(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of users that occur in ``asked``."""
    return rows.join(asked.select("user_id").distinct(), "user_id", "left_semi")


def get_all_general(memories: DataFrame, users: DataFrame, limit: int | None = None) -> DataFrame:
    """All general memories of the asked users, without vectors.

    No limit by default; with one, the first ``limit`` per user by id.
    """
    texts = memories.where(F.col("memory_text").isNotNull()).select(
        "user_id", "memory_id", "memory_text"
    )
    rows = of_users(texts, users).withColumn("type", F.lit("general"))
    if limit is None:
        return rows
    order = Window.partitionBy("user_id").orderBy("memory_id")
    return (
        rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")
    )


def get_core(core: DataFrame, users: DataFrame) -> DataFrame:
    """Core memories of the asked users; order by (ord, ord_pos).  A miss is no row."""
    return of_users(core, users).withColumn("type", F.lit("core"))


def get_all_memories(general: DataFrame, core: DataFrame, users: DataFrame) -> DataFrame:
    """Core memories in stored order (ord, ord_pos), then general ones, not de-duplicated.

    General memories have no order of their own; theirs is null.
    """
    out = ["user_id", "tier_ord", "ord", "ord_pos", "memory_id", "memory_text", "type"]
    head = get_core(core, users).withColumn("tier_ord", F.lit(0))
    tail = get_all_general(general, users).withColumn("tier_ord", F.lit(1))
    tail = tail.withColumns({c: F.lit(None).cast("bigint") for c in ("ord", "ord_pos")})
    return head.select(out).unionByName(tail.select(out))


def get_core_status(core: DataFrame, users: DataFrame) -> DataFrame:
    """Number of core memories per asked user, and whether there are any."""
    asked = users.select("user_id").distinct()
    counts = of_users(core, users).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_core"))
    return (
        asked.join(counts, "user_id", "left")
        .select(
            "user_id",
            F.coalesce("n_core", F.lit(0)).alias("n_core"),
            F.when(F.col("n_core") > 0, "ok")
            .otherwise("User has no core memories!")
            .alias("status"),
        )
    )


def ids_exist(memories: DataFrame, ids: DataFrame, on: tuple[str, ...] = KEY) -> DataFrame:
    """Asked ids with a ``found`` flag; reads keys only.

    The table streams past the asked ids, so few ids mean no shuffle of it.
    """
    key = list(on)
    hits = memories.select(key).join(ids.select(key).distinct(), key, "left_semi").distinct()
    return (
        ids.join(hits.withColumn("hit", F.lit(True)), key, "left")
        .withColumn("found", F.coalesce("hit", F.lit(False)))
        .drop("hit")
    )
