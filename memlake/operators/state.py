"""State changes: folding INSERT/DELETE actions into the two memory tables.

The order of actions is (seq, kind, pos): jobs by ``seq``, and within one job
every DELETE before every INSERT.  All folds reduce the *actions* per key
first and let the stored table pass an anti join once, so a table of any size
is neither sorted nor regrouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.ids import content_id, memory_id
from memlake.operators.retrieve import ids_exist


def general_ops(actions: DataFrame) -> DataFrame:
    """Valid general actions as operations on memory ids.

    An INSERT's id comes from its text and user, a DELETE's is its target.
    """
    insert = F.col("action_type") == "INSERT"
    return actions.where((F.col("tier") == "general") & (F.col("verdict") == "ok")).select(
        "user_id",
        F.when(insert, memory_id("payload", "user_id"))
        .otherwise(F.col("target_memory_id"))
        .alias("memory_id"),
        F.when(insert, F.col("payload")).alias("memory_text"),
        insert.alias("is_insert"),
        "seq",
        "pos",
    )


def _key(scope_to_user: bool) -> list[str]:
    # Two users share an id only by a coincidence of their texts; unscoped,
    # the id alone is the key, whoever it belongs to.
    return ["user_id", "memory_id"] if scope_to_user else ["memory_id"]


def newest_rows(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``; copies go before they are shuffled."""
    first = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def last_ops(ops: DataFrame, scope_to_user: bool = True) -> DataFrame:
    """The operation that decides each memory's fate.

    A key that is both deleted and inserted in one job survives.
    """
    order = F.desc("seq"), F.desc("is_insert"), F.desc("pos")
    return newest_rows(ops, _key(scope_to_user), *order)


def apply_general(
    base: DataFrame, ops: DataFrame, scope_to_user: bool = True
) -> DataFrame:
    """The general table (user_id, memory_id, memory_text, ...) after ``ops``.

    A stored row that an INSERT names again is replaced.
    """
    key = _key(scope_to_user)
    decided = last_ops(ops, scope_to_user)
    kept = base.join(decided.select(key), key, "left_anti").select(base.columns)
    return kept.unionByName(decided.where("is_insert").select(base.columns))


def upsert_memories(
    memories: DataFrame, incoming: DataFrame, order_col: str | None = None
) -> DataFrame:
    """Merge a batch into the general table: same (user_id, memory_id) overwrites.

    ``order_col`` says which of several rows of one key in the batch came
    last; without it any of them is taken, as equal keys hold equal texts.
    """
    key = ["user_id", "memory_id"]
    if order_col is None:
        batch = incoming.dropDuplicates(key)
    else:
        batch = newest_rows(incoming, key, F.desc(order_col))
    kept = memories.join(batch.select(key), key, "left_anti")
    return kept.unionByName(batch.select(memories.columns))


def core_ops(actions: DataFrame) -> DataFrame:
    """Valid core actions as operations.  An inserted entry's id is made of its user, job and place."""
    insert = F.col("action_type") == "INSERT"
    return actions.where((F.col("tier") == "core") & (F.col("verdict") == "ok")).select(
        "user_id",
        F.when(insert, content_id(F.concat_ws(":", "user_id", "req_id", F.col("pos").cast("string"))))
        .otherwise(F.col("target_memory_id"))
        .alias("memory_id"),
        F.when(insert, F.col("payload")).alias("memory_text"),
        insert.alias("is_insert"),
        "seq",
        "pos",
    )


def apply_core(base: DataFrame, ops: DataFrame) -> DataFrame:
    """The core table (user_id, memory_id, memory_text, ord, ord_pos) after ``ops``.

    Kept entries keep their place, new ones follow in (job, action) order:
    the list order *is* the pair (ord, ord_pos), so nothing is renumbered and
    a long profile needs no sort; ``seq`` must go on where the stored ``ord``
    ends.  A DELETE strikes only entries that were there before its job.
    """
    added = ops.where("is_insert").select(
        "user_id",
        "memory_id",
        "memory_text",
        F.col("seq").alias("ord"),
        F.col("pos").cast("bigint").alias("ord_pos"),
    )
    strikes = (
        ops.where(~F.col("is_insert"))
        .groupBy("user_id", "memory_id")
        .agg(F.max("seq").alias("struck"))
    )
    stored = base.select(added.columns).join(strikes, ["user_id", "memory_id"], "left_anti")
    outlived = (
        added.join(strikes, ["user_id", "memory_id"], "left")
        .where(F.col("struck").isNull() | (F.col("struck") <= F.col("ord")))
        .drop("struck")
    )
    return stored.unionByName(outlived)


def _asked_ids(requests: DataFrame) -> DataFrame:
    return requests.select(
        "request_id", "user_id", F.explode_outer("memory_ids").alias("memory_id")
    )


def delete_memories(
    memories: DataFrame, requests: DataFrame, scope_to_user: bool = True
) -> DataFrame:
    """The general table without the ids named by requests (request_id, user_id, memory_ids).

    Ids that do not exist are passed over.  Unscoped, an id is deleted
    whoever asks.
    """
    key = _key(scope_to_user)
    return memories.join(_asked_ids(requests).select(key).distinct(), key, "left_anti").select(
        memories.columns
    )


def delete_audit(
    memories: DataFrame, requests: DataFrame, scope_to_user: bool = True
) -> DataFrame:
    """Per request: ids asked for, found and missing, and whether it did anything."""
    key = _key(scope_to_user)
    asked = _asked_ids(requests).groupBy("request_id", "user_id", "memory_id").agg(
        F.count("memory_id").alias("times")
    )
    return (
        ids_exist(memories, asked, tuple(key))
        .groupBy("request_id")
        .agg(F.sum("times").alias("requested"), F.count_if("found").alias("deleted"))
        .select(
            "request_id",
            "requested",
            "deleted",
            (F.col("requested") - F.col("deleted")).alias("missing"),
            F.when(F.col("deleted") > 0, "ok").otherwise("not found").alias("status"),
        )
    )
