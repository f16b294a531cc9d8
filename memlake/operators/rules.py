"""Rule planner: gatekeeping, slots, conflicts and duplicates without a model.

Rules are tried in order and the first that matches decides, as one CASE
expression: a map-side step inside code generation, no join with the rules.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import normalise_fact, sentences
from memlake.operators.retrieve import dense_topk, of_users
from memlake.operators.state import newest_rows


class Gate(NamedTuple):
    pattern: str
    verdict: str
    reason: str


class Slot(NamedTuple):
    pattern: str
    tier: str
    slot: str


# Default rules, in the order they are tried.  Patterns are
# matched against the lower-cased sentence and valid in both Java and RE2.
GATE_RULES = [
    Gate(r"^(hi|hello|hey|thanks|thank you|good (morning|evening|night)|bye)\b", "drop", "chitchat"),
    Gate(r"^how are you\b", "drop", "chitchat"),
    Gate(r"\b(right now|at the moment)\b", "drop", "temporary state"),
    Gate(r"\bi('m| am) (hungry|tired|sleepy|bored|driving|going to)\b", "drop", "temporary state"),
    Gate(r"^(please )?(write|fix|explain|translate|summari[sz]e|help me)\b", "drop", "task"),
    Gate(r"\bhere is my code\b", "drop", "task"),
    Gate(r"^(that's|that is) (cool|nice|great)\b", "drop", "vague"),
    Gate(r"^i like (that|it|this)[.!?]*$", "drop", "vague"),
    Gate(r"\bmy name is\b", "keep", "biographical"),
    Gate(r"\bi('m| am) [0-9]+( years old)?\b", "keep", "biographical"),
    Gate(r"\bi live in\b", "keep", "biographical"),
    Gate(r"\bi work as\b", "keep", "biographical"),
    Gate(r"\bi('m| am) (a|an) (man|woman|non-binary)\b", "keep", "biographical"),
    Gate(r"\bi have a (dog|cat|bird|pet)\b", "keep", "biographical"),
    Gate(r"\b(always|never) (answer|reply|use|call)\b", "keep", "preference"),
    Gate(r"\bi (prefer|like|love|hate|dislike)\b", "keep", "preference"),
    Gate(r"\bi (code|program) in\b", "keep", "project"),
    Gate(r"\bi('m| am) (building|writing|working on)\b", "keep", "project"),
]

# Where a kept fact belongs.  The first group is the value.
SLOT_RULES = [
    Slot(r"\bmy name is ([\p{L}\p{N}][\p{L}\p{N} '-]*)", "core", "name"),
    Slot(r"\bi(?:'m| am) ([0-9]+)(?: years old)?\b", "core", "age"),
    Slot(r"\bi(?:'m| am) (?:a|an) (man|woman|non-binary)\b", "core", "gender"),
    Slot(r"\bi live in ([\p{L}\p{N}][\p{L}\p{N} '-]*)", "core", "location"),
    Slot(r"\bi work as (?:a |an )?([\p{L}\p{N}][\p{L}\p{N} '-]*)", "core", "profession"),
    Slot(r"\b((?:always|never) (?:answer|reply|use|call)\b[^.!?]*)", "core", "instruction"),
    Slot(r"\bi(?:'m| am) (?:building|writing|working on) ([^.!?]+)", "general", "project"),
    Slot(r"\bi (?:code|program) in ([^.!?]+)", "general", "skill"),
    Slot(r"\bi have a ((?:dog|cat|bird|pet)\b[^.!?]*)", "general", "pet"),
    Slot(r"\bi ((?:prefer|like|love|hate|dislike) [^.!?]+)", "general", "taste"),
]

#: Slots that hold one value per user; a new value replaces the old one.
SINGLE_SLOTS = ("name", "age", "gender", "location", "profession")


def user_sentences(jobs: DataFrame) -> DataFrame:
    """Sentences of the user's messages: (req_id, user_id, seq, turn, pos, sentence)."""
    return (
        jobs.select("req_id", "user_id", "seq", F.posexplode("messages").alias("turn", "m"))
        .where(F.col("m.role") == "user")
        .select(
            "req_id", "user_id", "seq", "turn",
            F.posexplode(sentences("m.content")).alias("pos", "sentence"),
        )
    )


def _first_match(text: Column, rules: list, value) -> Column:
    chosen = F
    for rule in rules:
        chosen = chosen.when(text.rlike(rule.pattern), value(rule))
    return chosen


def gatekeeper(
    facts: DataFrame, rules: list[Gate] | None = None, text: str = "sentence"
) -> DataFrame:
    """Adds ``keep`` and ``why``; a sentence no rule matches is dropped as noise."""
    rules = GATE_RULES if rules is None else rules
    low = F.lower(text)
    verdict = _first_match(low, rules, lambda r: F.lit(f"{r.verdict}:{r.reason}"))
    decided = F.coalesce(verdict, F.lit("drop:no rule"))
    return facts.withColumn("keep", F.startswith(decided, F.lit("keep:"))).withColumn(
        "why", F.substring_index(decided, ":", -1)
    )


def assign_slots(
    facts: DataFrame, rules: list[Slot] | None = None, text: str = "sentence"
) -> DataFrame:
    """Adds ``tier``, ``slot`` and ``value`` (lower case); null where no rule matches."""
    rules = SLOT_RULES if rules is None else rules
    low = F.lower(text)
    found = _first_match(
        low,
        rules,
        lambda r: F.struct(
            F.lit(r.tier).alias("tier"),
            F.lit(r.slot).alias("slot"),
            F.regexp_extract(low, r.pattern, 1).alias("value"),
        ),
    )
    return facts.withColumn("_s", found).select(
        *facts.columns, "_s.tier", "_s.slot", F.trim("_s.value").alias("value")
    )


def resolve_conflicts(facts: DataFrame, existing: DataFrame) -> DataFrame:
    """Actions that leave each slot with its newest value only.

    ``facts`` has (req_id, user_id, slot, value, memory_text, seq, pos),
    ``existing`` (user_id, slot, value, memory_id).  Every stored entry of
    another value is deleted, the new fact is inserted unless an equal one is
    stored.  Actions belong to the job of the winning fact.
    """
    winners = newest_rows(facts, ["user_id", "slot"], F.desc("seq"), F.desc("pos"))
    head = ["req_id", "user_id", "seq", "pos", "slot"]
    # Stored rows are the large and possibly skewed side: they stream past the
    # one winner of their slot.
    met = existing.select("user_id", "slot", F.col("value").alias("old_value"), "memory_id").join(
        winners.select(*head, "value"), ["user_id", "slot"]
    )
    deletes = met.where(F.col("old_value") != F.col("value")).select(
        *head,
        F.lit("DELETE").alias("action_type"),
        F.lit(None).cast("string").alias("payload"),
        F.col("memory_id").alias("target_memory_id"),
    )
    stored = met.where(F.col("old_value") == F.col("value")).select("user_id", "slot").distinct()
    inserts = winners.join(stored, ["user_id", "slot"], "left_anti").select(
        *head,
        F.lit("INSERT").alias("action_type"),
        F.col("memory_text").alias("payload"),
        F.lit(None).cast("string").alias("target_memory_id"),
    )
    return deletes.unionByName(inserts)


def suppress_duplicates(
    facts: DataFrame, existing: DataFrame, order_col: str, text: str = "memory_text"
) -> DataFrame:
    """New facts whose normalised text the user does not have yet, the first of equals.

    Rows are compared by a 256-bit digest of the normalised text, so whole
    texts never travel; old and new rows meet in one grouping, which collapses
    copies before its shuffle.
    """
    def keyed(rows: DataFrame, order) -> DataFrame:
        return rows.select(
            "user_id", F.sha2(normalise_fact(text), 256).alias("digest"), order.alias(order_col)
        )

    kind = facts.schema[order_col].dataType
    fresh = (
        keyed(facts, F.col(order_col))
        .unionByName(keyed(of_users(existing, facts), F.lit(None).cast(kind)))
        .groupBy("user_id", "digest")
        .agg(F.min(order_col).alias(order_col), F.bool_or(F.col(order_col).isNull()).alias("old"))
        .where(~F.col("old"))
        .select("user_id", order_col)
    )
    return facts.join(fresh, ["user_id", order_col], "left_semi")


def suppress_near_duplicates(
    facts: DataFrame, existing: DataFrame, min_cosine: float, **cells
) -> DataFrame:
    """New facts (fact_id, user_id, dense, ...) that no stored memory comes close to.

    A fact goes if the most similar memory of its user reaches ``min_cosine``.
    That is a top-1 search, exact and without writing out pairs.
    """
    asked = facts.select(
        F.col("fact_id").alias("query_id"),
        "user_id",
        F.lit(min_cosine).alias("threshold"),
        "dense",
    )
    close = dense_topk(asked, existing, 1, **cells).where(F.col("score") >= F.col("threshold"))
    return facts.join(
        close.select(F.col("query_id").alias("fact_id")), "fact_id", "left_anti"
    )


def extract_facts(jobs: DataFrame) -> DataFrame:
    """Facts worth keeping in the user's messages, with tier, slot and value."""
    return (
        assign_slots(gatekeeper(user_sentences(jobs)).where("keep"))
        .where(F.col("slot").isNotNull())
        .withColumn("memory_text", F.concat_ws(": ", "slot", "value"))
        # Place of a fact in its job: by message, then by sentence.
        .withColumn("pos", F.col("turn").cast("bigint") * (1 << 32) + F.col("pos"))
        .select("req_id", "user_id", "seq", "pos", "tier", "slot", "value", "memory_text")
    )


def _claim() -> Column:
    # What a fact competes for: its slot if that holds one value, else itself.
    return F.when(F.col("slot").isin(*SINGLE_SLOTS), F.col("slot")).otherwise(
        F.col("memory_text")
    )


def rule_actions(facts: DataFrame, core: DataFrame) -> DataFrame:
    """Action rows for extracted facts; targets are memory ids already.

    Core facts are resolved against the stored profile and within the batch:
    only the newest value of a slot, of all jobs of the batch, is written.
    General facts are plain inserts, idempotent through their ids.
    """
    stored = core.withColumn("slot", F.substring_index("memory_text", ": ", 1)).select(
        "user_id",
        _claim().alias("slot"),
        F.expr("substring(memory_text, length(slot) + 3)").alias("value"),
        "memory_id",
    )
    in_core = facts.where("tier = 'core'").withColumn("slot", _claim())
    out = ["req_id", "user_id", "seq", "tier", "pos", "action_type", "payload", "target_memory_id"]
    changed = resolve_conflicts(in_core, stored).withColumn("tier", F.lit("core"))
    general = facts.where("tier = 'general'").select(
        "req_id", "user_id", "seq", "tier", "pos",
        F.lit("INSERT").alias("action_type"),
        F.col("memory_text").alias("payload"),
        F.lit(None).cast("string").alias("target_memory_id"),
    )
    return changed.select(out).unionByName(general.select(out))
