"""Ingest: decode, gate, plan, resolve and apply one batch of job lines after another.

A batch is one version of the store.  What it works out on the way (its jobs
and their fate, its facts, its actions) is written as tables of that version
and read back: lost executors cost a re-read, nothing is computed twice, and
the tables are the audit trail.  Jobs whose id an earlier version has seen
are left out, so a replayed log changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memlake.functions import content_id, fallback_query_text
from memlake.operators import curate, rules
from memlake.operators.encode import Encoder, encode_isolated, mark_query
from memlake.operators.requests import skip_gate
from memlake.operators.retrieve import of_users
from memlake.operators.state import core_ops, delete_audit, general_ops, last_ops
from memlake.plans.read import search_hits
from memlake.schema import SPARSE
from memlake.sources.jobs import decode_jobs
from memlake.sources.store import SCHEMAS, MemoryStore

#: Works out the actions of a batch: (jobs, store, version, encoder) to rows of
#: (req_id, user_id, seq, tier, pos, action_type, payload, target_memory_id,
#: verdict), targets being memory ids.
Planner = Callable[[DataFrame, MemoryStore, int, Encoder], DataFrame]


def search_existing(
    jobs: DataFrame, store: MemoryStore, version: int, encoder: Encoder, **search
) -> DataFrame:
    """General memories each job's planner gets to see, as ranked hits with texts."""
    asked = jobs.select(
        F.col("req_id").alias("query_id"),
        "user_id",
        "threshold",
        mark_query(F.col("expanded_query")).alias("text"),
    )
    hits = search_hits(asked, store.general(before=version), encoder, **search)
    return hits.withColumnRenamed("query_id", "req_id")


class RulePlanner:
    """Plans from rules: no model, no ordinals."""

    def __call__(self, jobs, store, version, encoder) -> DataFrame:
        facts = store.stage(rules.extract_facts(jobs), "facts", version)
        core = of_users(store.core(before=version), facts)
        return curate.validate_actions(rules.rule_actions(facts, core))


class PreparedPlans:
    """Plans from a table (req_id, plan_json), whose targets are ordinals."""

    def __init__(self, plans: DataFrame, **search):
        self.plans, self.search = plans, search

    def __call__(self, jobs, store, version, encoder) -> DataFrame:
        hits = search_existing(jobs, store, version, encoder, **self.search)
        plans = store.stage(curate.plans_from_table(jobs, self.plans), "plans", version)
        return _resolve(plans, of_users(store.core(before=version), jobs), hits)


class ModelPlanner:
    """Plans from a batch function over prompts; a prompt is put together per job.

    What the model was shown and what it answered are tables of the version:
    the numbers it names mean what it saw, and it is asked once.
    """

    def __init__(self, planner: curate.Planner, **search):
        self.planner, self.search = planner, search

    def __call__(self, jobs, store, version, encoder) -> DataFrame:
        found = search_existing(jobs, store, version, encoder, **self.search)
        hits = store.stage(found, "hits", version)
        core = of_users(store.core(before=version), jobs)
        pieces = curate.build_prompts(jobs, core, hits)
        prompts = pieces.groupBy("req_id").agg(
            F.array_sort(F.collect_list(F.struct("section", "part", "text"))).alias("p")
        )
        asked = prompts.join(jobs.select("req_id", "user_id", "seq"), "req_id").withColumn(
            "prompt", F.array_join(F.transform("p", lambda x: x["text"]), "")
        )
        answers = curate.plans_from_model(asked, self.planner)
        return _resolve(store.stage(answers, "plans", version), core, hits)


def _resolve(plans: DataFrame, core: DataFrame, hits: DataFrame) -> DataFrame:
    actions, dead = curate.parse_plans(plans)
    valid = curate.validate_actions(actions)
    # A plan that is no JSON fails its job: it shows as one invalid action.
    failed = dead.join(plans.select("req_id", "user_id", "seq"), "req_id").select(
        "req_id", "user_id", "seq",
        F.lit("core").alias("tier"),
        F.lit(0).alias("pos"),
        F.lit("").alias("action_type"),
        F.lit(None).cast("string").alias("payload"),
        F.lit(None).cast("string").alias("target_memory_id"),
        F.lit("invalid").alias("verdict"),
    )
    return curate.resolve_targets(valid, core, hits).unionByName(failed)


#: Lines of a batch, at most; a version's numbers begin where the one before can reach at most.
LINES_PER_BATCH = 1 << 40


def _with_seq(lines: DataFrame, store: MemoryStore, version: int) -> DataFrame:
    """Lines numbered in the log's own order: by ``seq``, else by ``order``, else as they come.

    They are sorted by ranges and written; each range's lines are numbered from where the ranges
    before it end. So no number has gaps to run out of.
    """
    if "seq" in lines.columns:
        return lines
    order = ["order"] if "order" in lines.columns else []
    line = F.monotonically_increasing_id()
    ranged = lines.withColumn("line", line).repartitionByRange(*order, "line").sortWithinPartitions(*order, "line")
    within = line.bitwiseAND(F.lit((1 << 33) - 1))
    written = store.stage(
        ranged.select("value", F.spark_partition_id().alias("part"), within.alias("line")), "lines", version
    )
    # One row for each range.
    counts = written.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.withColumn("end", F.sum("n").over(Window.orderBy("part")))
    if (ends.agg(F.max("end")).first()[0] or 0) > LINES_PER_BATCH:
        raise ValueError(f"a batch has more than {LINES_PER_BATCH} lines")
    first = ends.select("part", (F.col("end") - F.col("n") + F.lit(version * LINES_PER_BATCH)).alias("first"))
    return written.join(first, "part").select("value", (F.col("first") + F.col("line")).alias("seq"))


def open_lines(
    lines: DataFrame, expand: Callable[[Column], Column]
) -> DataFrame:
    """Decoded lines with their search text and a first ``status``: dead, skipped or accepted.

    A job without an id gets one, made of its number and its text.
    """
    decoded = decode_jobs(lines)
    own = F.concat(F.lit("job-"), content_id(F.concat_ws(":", F.col("seq").cast("string"), "raw")))
    nameless = F.col("reason").isNull() & (F.col("req_id") == "")
    decoded = decoded.withColumn("req_id", F.when(nameless, own).otherwise(F.col("req_id")))
    gated = skip_gate(decoded.withColumn("expanded_query", expand(F.col("messages"))))
    return gated.withColumn(
        "status",
        F.when(F.col("reason").isNotNull(), "dead")
        .when(~F.col("required"), "skipped")
        .otherwise("accepted"),
    ).withColumn("raw", F.when(F.col("status") == "dead", F.col("raw")))


def mark_replays(jobs: DataFrame, seen: DataFrame) -> DataFrame:
    """Status becomes ``replayed`` for jobs among ``seen`` (req_id) or earlier in the batch.

    Jobs without an id are never taken for replays.
    """
    named = (F.col("status") != "dead") & (F.col("req_id") != "")
    # Rows without a name to look up get one of their own, not all the same.
    lookup = F.when(named, F.concat(F.lit("r"), F.col("req_id"))).otherwise(
        F.concat(F.lit("-"), F.col("seq").cast("string"))
    )
    keyed = jobs.withColumn("name", lookup)
    firsts = keyed.where(named).groupBy("name").agg(F.min("seq").alias("first_seq"))
    # The log is the long side: it streams past the ids of this batch.
    before = (
        seen.select(F.concat(F.lit("r"), F.col("req_id")).alias("name"))
        .join(firsts.select("name"), "name", "left_semi")
        .distinct()
        .withColumn("old", F.lit(True))
    )
    again = F.col("old").isNotNull() | (F.col("seq") > F.col("first_seq"))
    return (
        keyed.join(firsts, "name", "left")
        .join(before, "name", "left")
        .withColumn(
            "status",
            F.when(named & F.coalesce(again, F.lit(False)), "replayed").otherwise(
                F.col("status")
            ),
        )
        .select(jobs.columns)
    )


def batch_audit(jobs: DataFrame, actions: DataFrame) -> DataFrame:
    """One row of counts: what became of a batch's jobs and of its actions."""

    def n(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    fate, done = F.col("status"), F.col("verdict") == "ok"
    kind = F.col("action_type")
    per_job = jobs.agg(
        F.count(F.lit(1)).alias("jobs"),
        *[n(fate == s).alias(s) for s in ("dead", "replayed", "skipped", "accepted")],
    )
    per_action = actions.agg(
        n(done & (kind == "INSERT")).alias("inserted"),
        n(done & (kind == "DELETE")).alias("deleted"),
        *[n(F.col("verdict") == v).alias(v) for v in ("not_found", "ignored", "invalid")],
    )
    # Two frames of one row each.
    one = F.lit(1).alias("one")
    return per_job.select("*", one).join(per_action.select("*", one), "one").drop("one")


def ingest_batch(
    lines: DataFrame,
    batch_id: int,
    store: MemoryStore,
    planner: Planner,
    encoder: Encoder,
    expand: Callable[[Column], Column] = fallback_query_text,
    source: str = "batch",
    dim: int | None = None,
) -> None:
    """Apply one batch of job lines (column ``value``, optionally ``seq`` or ``order``) as the next version.

    A batch that its source has delivered before, by its number, is left out.

    A job with a text that the encoder fails on, or whose vector has not ``dim`` components, becomes a dead letter
    with the reason, and none of its actions is applied; the others are, as if it had not come.  An encoder that
    is down fails the batch instead, which then changes nothing and can be repeated.

    ``expand`` turns messages into the text to search with; a model's output
    can be joined in before by giving a line source of its own.
    """
    store = store.pinned()
    if store.has_batch(source, batch_id):
        return
    version = store.next_version()
    seen = store.log("jobs", before=version).where("status != 'dead'").select("req_id")
    decoded = store.stage(
        open_lines(_with_seq(lines, store, version), expand), "decoded", version
    )
    jobs = store.stage(mark_replays(decoded, seen), "jobs", version)
    accepted = jobs.where("status = 'accepted'")
    actions = store.stage(planner(accepted, store, version, encoder), "actions", version)
    # Encoding comes before anything is applied, and applying is one commit.
    # Only what outlives its batch is encoded.
    ops = last_ops(general_ops(actions))
    inserts = encode_isolated(ops.where("is_insert"), "memory_text", encoder, dim)
    problems = Observation()
    store.write_general(_with_deletes(ops, inserts.observe(problems, F.count("problem").alias("n"))), version)
    if problems.get.get("n"):
        failed, actions, inserts = _without_failing(accepted, store, version, planner, encoder, dim, actions)
        store.write_general(_with_deletes(last_ops(general_ops(actions)), inserts), version)
        # Made of what `jobs` was made of, and written over it.
        jobs = store.stage(_dead(mark_replays(decoded, seen), failed), "jobs", version)
    store.write_core(core_ops(actions), version)
    store.stage(batch_audit(jobs, actions), "audit", version)
    store.commit(version, "delta", source, batch_id)


def _with_deletes(ops: DataFrame, inserts: DataFrame) -> DataFrame:
    return ops.where("not is_insert").unionByName(inserts.drop("problem"), allowMissingColumns=True)


def _without_failing(
    accepted: DataFrame,
    store: MemoryStore,
    version: int,
    planner: Planner,
    encoder: Encoder,
    dim: int | None,
    actions: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(failed, actions, inserts) once no text that is to be stored fails: jobs that bring one are left out.

    What is left is planned anew, for a job that failed may have replaced what another one says.  That may
    bring up texts not tried before, so it goes on until there is no new failure; each text is encoded once.
    """
    key = ["user_id", "memory_id"]
    encoded = failed = None
    for part in count():
        wanted = last_ops(general_ops(actions)).where("is_insert")
        fresh = wanted if encoded is None else wanted.join(encoded.select(key), key, "left_anti")
        made = store.stage(encode_isolated(fresh, "memory_text", encoder, dim), "encoded", version, part)
        encoded = made if encoded is None else encoded.unionByName(made)
        bad = made.where("problem is not null")
        if bad.isEmpty():
            # Of texts that failed before none is wanted any more: the jobs that bring one are gone.
            return failed, actions, encoded.join(wanted.select(key), key, "left_semi")
        bringing = general_ops(actions).where("is_insert").join(bad.select(*key, "problem"), key)
        newly = bringing.groupBy("seq").agg(F.min("problem").alias("problem"))
        newly = store.stage(newly, "failed", version, part)
        failed = newly if failed is None else failed.unionByName(newly)
        left = accepted.join(failed.select("seq"), "seq", "left_anti").select(accepted.columns)
        actions = store.stage(planner(left, store, version, encoder), "actions", version)


def _dead(jobs: DataFrame, failed: DataFrame) -> DataFrame:
    """Jobs of which those that ``failed`` are dead, with the reason and, as their line, what was decoded."""
    ill = F.col("problem").isNotNull()
    wire = F.to_json(
        F.struct(
            F.col("req_id").alias("ReqId"),
            F.col("user_id").alias("UserId"),
            F.col("messages").alias("Messages"),
            F.col("threshold").alias("Threshold"),
        )
    )
    marked = jobs.join(failed, "seq", "left").withColumns(
        {
            "status": F.when(ill, "dead").otherwise(F.col("status")),
            "reason": F.when(ill, F.col("problem")).otherwise(F.col("reason")),
            "raw": F.when(ill, wire).otherwise(F.col("raw")),
        }
    )
    return marked.select(jobs.columns)


def ingest_stream(
    lines: DataFrame,
    store: MemoryStore,
    planner: Planner,
    encoder: Encoder,
    checkpoint: str,
    compact_every: int = 50,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Run :func:`ingest_batch` on every micro-batch of a stream.

    Until it has no more input, unless ``trigger`` says otherwise, such as ``{"processingTime": "10 seconds"}``
    for a consumer that listens on.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, store, planner, encoder, source=checkpoint, **options)
        if batch_id % compact_every == compact_every - 1:
            store.compact()

    return (
        lines.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def delete_from_store(requests: DataFrame, store: MemoryStore, scope_to_user: bool = True) -> DataFrame:
    """Delete general memories by requests (request_id, user_id, memory_ids) as the next version; returns the audit.

    Ids that do not exist are passed over.  Unscoped, an id is deleted whoever asks.
    """
    store = store.pinned()
    version = store.next_version()
    general = store.general()
    asked = requests.select("user_id", F.explode("memory_ids").alias("memory_id"))
    key = ["user_id", "memory_id"] if scope_to_user else ["memory_id"]
    found = general.select("user_id", "memory_id").join(asked.select(key).distinct(), key, "left_semi")
    # Both before anything is deleted.
    audit = store.stage(
        delete_audit(general, requests, scope_to_user).withColumn("request_id", F.col("request_id").cast("string")),
        "deletes",
        version,
    )
    gone = {name: F.lit(None).cast(kind) for name, kind in (("memory_text", "string"), ("dense", "array<float>"), ("sparse", SPARSE))}
    store.stage(found.withColumns(gone | {"is_insert": F.lit(False)}), "general", version)
    store.stage(store.spark.createDataFrame([], SCHEMAS["core"]), "core", version)
    for name in ("jobs", "audit"):
        store.stage(store.spark.createDataFrame([], SCHEMAS[name]), name, version)
    store.commit(version, "delta", "delete", version)
    return audit
