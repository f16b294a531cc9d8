"""Curation plans: what a planner sees, and how its answer becomes actions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import transcript_text, whole
from memlake.functions.wire import plan_of
from memlake.operators.retrieve import of_users
from memlake.schema import ACTION

_STRIDE = 1 << 16


def core_positions(core: DataFrame, stride: int = _STRIDE) -> DataFrame:
    """Core entries with their place in the user's list, from 0: adds ``place``.

    Places are counted in two steps, within stretches of ``stride`` orders and
    then over the stretches, so one long list is ranked by many tasks.
    """
    keyed = core.withColumn("stretch", whole("ord", stride))
    within = Window.partitionBy("user_id", "stretch").orderBy("ord", "ord_pos", "memory_id")
    before = (
        Window.partitionBy("user_id")
        .orderBy("stretch")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        keyed.groupBy("user_id", "stretch")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    return (
        keyed.withColumn("rn", F.row_number().over(within))
        .join(starts, ["user_id", "stretch"])
        .withColumn("place", F.col("start") + F.col("rn") - 1)
        .drop("stretch", "rn", "start")
    )


def _core_counts(core: DataFrame) -> DataFrame:
    return core.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_core"))


def _general_ordinals(jobs: DataFrame, core: DataFrame, hits: DataFrame) -> DataFrame:
    """A job's hits numbered on from the end of its user's core list."""
    shown = hits.join(jobs.select("req_id", "user_id"), ["req_id", "user_id"])
    return shown.join(_core_counts(core), "user_id", "left").withColumn(
        "ordinal", F.coalesce("n_core", F.lit(0)) + F.col("rank") - 1
    ).drop("n_core")


def ordinal_map(jobs: DataFrame, core: DataFrame, hits: DataFrame) -> DataFrame:
    """Small numbers standing for memory ids, per job: core first, then general hits.

    ``hits`` has (req_id, user_id, memory_id, rank) with ranks from 1.
    """
    core = of_users(core, jobs)
    head = (
        jobs.select("req_id", "user_id")
        .join(core_positions(core), "user_id")
        .select("req_id", "user_id", F.col("place").alias("ordinal"), "memory_id")
        .withColumn("tier", F.lit("core"))
    )
    tail = (
        _general_ordinals(jobs, core, hits)
        .select("req_id", "user_id", "ordinal", "memory_id")
        .withColumn("tier", F.lit("general"))
    )
    return head.unionByName(tail).withColumn("ordinal", F.col("ordinal").cast("string"))


def _item(kind: str):
    return F.to_json(
        F.struct(
            F.col("memory_text").alias("text"),
            F.lit(kind).alias("type"),
            F.col("ordinal").cast("string").alias("id"),
        )
    )


def _list_parts(items: DataFrame, key: str, per_part: int) -> DataFrame:
    """JSON items of a list, joined in parts of ``per_part``; parts put together are the list."""
    part = whole("n", per_part).cast("int")
    joined = items.groupBy(key, part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("n", "item"))).alias("i")
    )
    return joined.select(
        key,
        "part",
        F.concat(
            F.when(F.col("part") == 0, "[").otherwise(","),
            F.array_join(F.transform("i", lambda x: x["item"]), ","),
        ).alias("text"),
    )


def build_prompts(
    jobs: DataFrame, core: DataFrame, hits: DataFrame, items_per_part: int = 1000
) -> DataFrame:
    """What a planning model reads, as rows (req_id, section, part, text).

    Concatenated by (section, part) the texts of a job are its prompt: core
    list, general list, transcript.  Lists are compact JSON, an empty one is
    ``null``.  Long lists stay in several parts and the core parts are made
    once per user, so no list is ever gathered whole.  ``hits`` carries
    ``memory_text``.
    """
    core = of_users(core, jobs)
    # Fixed frame of the prompt: what stands before, between and after the lists.
    opening = "<EXISTING_CORE_MEMORIES> \n"
    middle = "\n </EXISTING_CORE_MEMORIES> \n<EXISTING_OLD_MEMORIES> \n"
    closing = "\n </EXISTING_OLD_MEMORIES> \n<USER_INPUT> \n"
    ending = "\n </USER_INPUT>"

    core_items = core_positions(core).select(
        "user_id", F.col("place").alias("n"), F.col("place").alias("ordinal"), "memory_text"
    ).withColumn("item", _item("core"))
    gen_items = _general_ordinals(jobs, core, hits).withColumn("item", _item("general")).select(
        "req_id", (F.col("rank") - 1).alias("n"), "item"
    )
    # Each list is joined to the jobs once; the row of its first part, or the
    # row without one, also brings the fixed pieces around the list.
    first = F.coalesce(F.col("part"), F.lit(0)) == 0
    end = F.when(F.col("part").isNull(), "null").otherwise("]")

    def piece(section: int, text, part=None):
        part = F.lit(0) if part is None else part
        return F.struct(F.lit(section).alias("section"), part.alias("part"), text.alias("text"))

    core_pieces = (
        jobs.select("req_id", "user_id")
        .join(_list_parts(core_items, "user_id", items_per_part), "user_id", "left")
        .select(
            "req_id",
            F.when(first, piece(0, F.lit(opening))).alias("a"),
            F.when(F.col("part").isNotNull(), piece(1, F.col("text"), F.col("part"))).alias("b"),
            F.when(first, piece(2, F.concat(end, F.lit(middle)))).alias("c"),
        )
    )
    tail = F.concat(end, F.lit(closing), transcript_text("messages"), F.lit(ending))
    general_pieces = (
        jobs.select("req_id", "messages")
        .join(_list_parts(gen_items, "req_id", items_per_part), "req_id", "left")
        .select(
            "req_id",
            F.when(F.col("part").isNotNull(), piece(3, F.col("text"), F.col("part"))).alias("a"),
            F.when(first, piece(4, tail)).alias("b"),
        )
    )

    def rows(pieces: DataFrame) -> DataFrame:
        listed = F.array_compact(F.array(*pieces.columns[1:]))
        return pieces.select("req_id", F.explode(listed).alias("p")).select("req_id", "p.*")

    return rows(core_pieces).unionByName(rows(general_pieces))


def parse_plans(
    plans: DataFrame, accept_underscore_keys: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Plans (req_id, user_id, seq, plan_json) to action rows, and the plans that are no JSON object.

    The keys hold a space; by default the spelling with an underscore, which
    planners are often shown, is read as well.
    """
    parsed = plans.withColumn("p", plan_of("plan_json", accept_underscore_keys))
    bad = F.col("p.reason").isNotNull()

    def tier(name: str):
        return F.transform(
            F.coalesce(F.col("p")[name], F.array().cast(f"array<{ACTION}>")),
            lambda a, i: F.struct(F.lit(name).alias("tier"), i.alias("pos"), a.alias("a")),
        )

    both = F.concat(tier("core"), tier("general"))
    actions = (
        parsed.where(~bad)
        .select("req_id", "user_id", "seq", F.explode(both).alias("x"))
        .select(
            "req_id",
            "user_id",
            "seq",
            "x.tier",
            "x.pos",
            F.coalesce("x.a.action_type", F.lit("")).alias("action_type"),
            "x.a.payload",
            "x.a.target_memory_id",
        )
    )
    dead = parsed.where(bad).select(
        "req_id", F.col("plan_json").alias("raw"), F.lit("malformed plan").alias("reason")
    )
    return actions, dead


def validate_actions(actions: DataFrame) -> DataFrame:
    """Adds ``verdict``: ok, ignored (unknown type) or invalid (its operand is missing).

    The operand an action does not use is cleared.  An invalid action of
    either tier is set aside; it fails neither its job nor its batch.
    """
    kind = F.col("action_type")
    verdict = (
        F.when(~kind.isin("INSERT", "DELETE"), "ignored")
        .when((kind == "INSERT") & F.col("payload").isNull(), "invalid")
        .when((kind == "DELETE") & F.col("target_memory_id").isNull(), "invalid")
        .otherwise("ok")
    )
    return (
        actions.withColumn("verdict", verdict)
        .withColumn("payload", F.when(kind != "DELETE", F.col("payload")))
        .withColumn("target_memory_id", F.when(kind != "INSERT", F.col("target_memory_id")))
    )


def resolve_targets(actions: DataFrame, core: DataFrame, hits: DataFrame) -> DataFrame:
    """Turn the ordinals of DELETEs back into memory ids; unknown ones get verdict not_found.

    Ordinals are looked up by (user, place) in the core list and by (job,
    rank) among the hits, so the product of jobs and core lists is never
    formed; ``core`` need hold no more than the lists of the users concerned.
    Both tiers share the numbers.  An unresolved action is void and
    leaves the rest of its job alone.
    """
    valid_delete = (F.col("action_type") == "DELETE") & (F.col("verdict") == "ok")
    # Numbers are matched as text: "07" or " 7" names nothing.
    number = F.when(
        valid_delete & F.col("target_memory_id").rlike(r"\A(0|[1-9][0-9]{0,17})\z"),
        F.col("target_memory_id").cast("bigint"),
    )
    # Rows that look nothing up get a negative number, which no place has, and
    # so spread over many join keys instead of meeting under one.
    nothing = -1 - F.pmod(F.xxhash64("req_id"), F.lit(1 << 20))
    numbered = actions.withColumn("ordinal", F.coalesce(number, nothing))
    places = core_positions(core).select(
        "user_id", F.col("place").alias("ordinal"), F.col("memory_id").alias("core_id")
    )
    ranks = hits.select(
        "req_id", (F.col("rank") - 1).cast("bigint").alias("place"),
        F.col("memory_id").alias("hit_id"),
    )
    found = (
        numbered.join(places, ["user_id", "ordinal"], "left")
        .join(_core_counts(core), "user_id", "left")
        .withColumn("place", F.col("ordinal") - F.coalesce("n_core", F.lit(0)))
        .join(ranks, ["req_id", "place"], "left")
    )
    target = F.coalesce("core_id", "hit_id")
    resolved = {
        "verdict": F.when(valid_delete & target.isNull(), "not_found").otherwise(
            F.col("verdict")
        ),
        "target_memory_id": F.when(valid_delete, target).otherwise(F.col("target_memory_id")),
    }
    return found.withColumns(resolved).select(actions.columns)


Planner = Callable[[pd.DataFrame], "list[str]"]


def plans_from_table(jobs: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans prepared elsewhere, joined to their jobs by request id."""
    return jobs.select("req_id", "user_id", "seq").join(
        plans.select("req_id", "plan_json"), "req_id"
    )


def plans_from_model(prompts: DataFrame, planner: Planner, batch: int = 64) -> DataFrame:
    """Plans from a batch function: frames of (req_id, user_id, seq, prompt) to JSON texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                rows = frame.iloc[start : start + batch]
                yield rows[["req_id", "user_id", "seq"]].assign(plan_json=planner(rows))

    return prompts.select("req_id", "user_id", "seq", "prompt").mapInPandas(
        run, "req_id string, user_id string, seq bigint, plan_json string"
    )
