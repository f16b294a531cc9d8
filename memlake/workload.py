"""The test tables read as conversations, memories, actions and requests.

Every frame is derived from whole tables, so its size follows theirs.  Five
conversations make a user; documents are dealt out to the same users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import content_id, context_query_text, memory_id, whole
from memlake.operators.encode import mark_query, sparse_encode
from memlake.operators.state import newest_rows
from memlake.schema import (
    INSERT_THRESHOLD,
    PLAN_CORE,
    PLAN_GENERAL,
    PLAN_REASONING,
)
from memlake.sources.jobs import assemble_jobs

CONVERSATIONS_PER_USER = 5
ACTIONS_PER_JOB = 10

_KEYS = {
    "conversations": "conv_id",
    "documents": "doc_id",
    "events": "event_id",
}


class Workload:
    """Frames over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def dealt(self, name: str) -> DataFrame:
        """A table in at least as many partitions as there are cores.

        A table of many files is read as it is.  One small file would keep all
        row-local work in one task; its rows are dealt out first.
        """
        rows = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        if rows.rdd.getNumPartitions() < cores:
            return rows.repartition(cores, _KEYS[name])
        return rows

    # -- conversations ------------------------------------------------------

    def _user_of_conversation(self) -> Column:
        group = whole("conv_id", CONVERSATIONS_PER_USER).cast("string")
        return F.concat(F.lit("u"), group).alias("user_id")

    def turns(self) -> DataFrame:
        return self.dealt("conversations").select(
            self._user_of_conversation(),
            "conv_id",
            "turn",
            "role",
            F.col("text").alias("content"),
        )

    def jobs(self) -> DataFrame:
        return assemble_jobs(self.turns())

    def users(self) -> DataFrame:
        return self.table("conversations").select(self._user_of_conversation()).distinct()

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.col("embedding").alias("dense"))

    def queries(self, threshold: float = 0.65) -> DataFrame:
        """One search per job: its context query, and the dense vector of its number."""
        asked = self.jobs().select(
            F.col("req_id").alias("query_id"),
            "user_id",
            F.col("seq").alias("vec_id"),
            F.lit(threshold).alias("threshold"),
            mark_query(context_query_text("messages")).alias("text"),
        )
        return sparse_encode(asked, "text").join(self.vectors(), "vec_id", "left").drop(
            "vec_id", "text"
        )

    def query_sizes(self) -> DataFrame:
        """Jobs per user, counted on turns without reading texts."""
        return (
            self.table("conversations")
            .groupBy(self._user_of_conversation())
            .agg(F.countDistinct("conv_id").alias("n_queries"))
        )

    # -- general memories ---------------------------------------------------

    def _user_of_document(self) -> Column:
        last = self.table("conversations").agg(F.max("conv_id")).scalar()
        n_users = F.floor(last / CONVERSATIONS_PER_USER) + 1
        return F.concat(F.lit("u"), (F.col("doc_id") % n_users).cast("string"))

    def documents(self) -> DataFrame:
        """Documents as (user_id, memory_id, memory_text); equal texts of a user share an id."""
        return (
            self.dealt("documents")
            .withColumn("user_id", self._user_of_document())
            .withColumn("memory_id", memory_id("text", "user_id"))
            .select("doc_id", "user_id", "memory_id", F.col("text").alias("memory_text"), "lang")
        )

    def memory_texts(self) -> DataFrame:
        """The general table without vectors: the last document of each id."""
        return newest_rows(self.documents(), ["user_id", "memory_id"], F.desc("doc_id"))

    def memories(self) -> DataFrame:
        """The general table with both vectors."""
        dense = self.vectors().withColumnRenamed("vec_id", "doc_id")
        texts = sparse_encode(self.memory_texts(), "memory_text")
        return texts.join(dense, "doc_id", "left")

    def memory_sizes(self) -> DataFrame:
        """Documents per user: an upper bound of memories that reads no text."""
        return (
            self.table("documents")
            .select(self._user_of_document().alias("user_id"))
            .groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("n_memories"))
        )

    # -- events as facts, actions and plans ---------------------------------

    def events(self) -> DataFrame:
        return self.dealt("events").select(
            "event_id",
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
            "event_type",
            "value",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )

    def core(self) -> DataFrame:
        """The core table: every signup is an entry of its user's profile."""
        return self.events().where("event_type = 'signup'").select(
            "user_id",
            content_id(F.concat(F.lit("core:"), F.col("event_id").cast("string"))).alias(
                "memory_id"
            ),
            F.concat(F.lit("Signed up for plan "), F.col("k")).alias("memory_text"),
            F.col("event_id").alias("ord"),
            F.lit(0).cast("bigint").alias("ord_pos"),
        )

    def base_facts(self) -> DataFrame:
        """A general table of facts: what users signed up for."""
        text = F.concat(F.lit("fact "), F.col("k"))
        return (
            self.events()
            .where("event_type = 'signup'")
            .select("user_id", memory_id(text, "user_id").alias("memory_id"), text.alias("memory_text"))
            .distinct()
        )

    def _actions(self, tier: str, text: Column, delete: Column) -> DataFrame:
        return self.events().where("event_type != 'signup'").select(
            self._req_id().alias("req_id"),
            "user_id",
            whole("event_id", ACTIONS_PER_JOB).alias("seq"),
            F.lit(tier).alias("tier"),
            (F.col("event_id") % ACTIONS_PER_JOB).alias("pos"),
            F.when(delete, "DELETE").otherwise("INSERT").alias("action_type"),
            F.when(~delete, text).alias("payload"),
            F.when(delete, memory_id(text, "user_id")).alias("target_memory_id"),
            F.lit("ok").alias("verdict"),
        )

    def actions(self) -> DataFrame:
        """Validated general actions: errors delete a fact, other events insert one."""
        text = F.concat(F.lit("fact "), F.col("k"))
        return self._actions("general", text, F.col("event_type") == "error")

    def base_profile(self) -> DataFrame:
        """A core table whose ids name a value, so that actions can point at them."""
        text = F.concat(F.lit("core "), F.col("k"))
        return (
            self.events()
            .where("event_type = 'signup'")
            .groupBy("user_id", "k")
            .agg(F.min("event_id").alias("first"))
            .select(
                "user_id",
                memory_id(text, "user_id").alias("memory_id"),
                text.alias("memory_text"),
                F.lit(-1).cast("bigint").alias("ord"),
                F.col("first").alias("ord_pos"),
            )
        )

    def core_actions(self) -> DataFrame:
        """Validated core actions: like :meth:`actions`, on entries of the profile."""
        text = F.concat(F.lit("core "), F.col("k"))
        delete = F.col("event_type") == "error"
        return self._actions("core", text, delete)

    def _req_id(self) -> Column:
        return self._job_id(whole("event_id", ACTIONS_PER_JOB))

    def _job_id(self, seq: Column) -> Column:
        return F.concat_ws("-", F.concat(F.lit("r"), F.col("user_id")), seq.cast("string"))

    def raw_actions(self) -> DataFrame:
        """Actions as a planner might write them, some of them wrong; targets are ordinals."""
        e = F.col("event_type")
        kind = F.when(e == "error", "DELETE").when(e == "click", "UPDATE").otherwise("INSERT")
        ordinal = F.floor(F.col("value") / 2).cast("string")
        target = F.when((e == "error") & (F.col("value") < 95), ordinal)
        return self.events().select(
            self._req_id().alias("req_id"),
            "user_id",
            whole("event_id", ACTIONS_PER_JOB).alias("seq"),
            F.when(e.isin("signup", "error"), "core").otherwise("general").alias("tier"),
            F.col("event_id"),
            kind.alias("action_type"),
            F.when((e != "error") & ~((e == "view") & (F.col("value") < 10)),
                   F.concat(F.lit("fact "), F.col("k"))).alias("payload"),
            target.alias("target_memory_id"),
        )

    def job_hits(self) -> DataFrame:
        """What each job of events was shown: the facts of its own events, as ranked hits."""
        order = Window.partitionBy("req_id").orderBy("event_id")
        return (
            self.events()
            .withColumn("req_id", self._req_id())
            .withColumn("rank", F.row_number().over(order))
            .select(
                "req_id",
                "user_id",
                memory_id(F.concat(F.lit("fact "), F.col("k")), "user_id").alias("memory_id"),
                "rank",
            )
        )

    def plans(self) -> DataFrame:
        """Plan texts; a job with an event of tiny value spells its keys with underscores."""
        rows = self.raw_actions().join(
            self.events().select("event_id", (F.col("value") < 5).alias("tiny")), "event_id"
        )
        action = F.struct("action_type", "payload", "target_memory_id")
        listed = rows.groupBy("req_id", "user_id", "seq").agg(
            F.max("tiny").alias("under"),
            F.array_sort(F.collect_list(F.struct("event_id", "tier", action.alias("a")))).alias("l"),
        )

        def plan(core_key: str, general_key: str, reasoning: str) -> Column:
            def of(tier: str) -> Column:
                return F.transform(F.filter("l", lambda x: x["tier"] == tier), lambda x: x["a"])

            return F.to_json(
                F.struct(
                    F.lit("from events").alias(reasoning),
                    of("core").alias(core_key),
                    of("general").alias(general_key),
                )
            )

        spaced = (PLAN_CORE, PLAN_GENERAL, PLAN_REASONING)
        under = [x.replace(" ", "_") for x in spaced]
        return listed.select(
            "req_id", "user_id", "seq",
            F.when(F.col("under"), plan(*under)).otherwise(plan(*spaced)).alias("plan_json"),
        )

    def facts(self) -> DataFrame:
        """Each event as a fact: its type is the slot, its number the value."""
        return self.events().select(
            self._req_id().alias("req_id"),
            "user_id",
            F.col("event_type").alias("slot"),
            F.col("k").cast("string").alias("value"),
            F.concat_ws(": ", "event_type", F.col("k").cast("string")).alias("memory_text"),
            whole("event_id", ACTIONS_PER_JOB).alias("seq"),
            (F.col("event_id") % ACTIONS_PER_JOB).alias("pos"),
            "event_id",
        )

    def delete_requests(self) -> DataFrame:
        """Each error event asks for two facts of its user to be forgotten."""
        def fact(n: Column) -> Column:
            return memory_id(F.concat(F.lit("fact "), n), "user_id")

        return self.events().where("event_type = 'error'").select(
            F.col("event_id").alias("request_id"),
            "user_id",
            F.array(fact(F.col("k")), fact(F.col("k") + 1)).alias("memory_ids"),
        )

    def statement(self) -> Column:
        """What the user of an event says."""
        k = F.col("k").cast("string")
        return (
            F.when(F.col("event_type") == "signup", F.concat(F.lit("I live in City "), k, F.lit(".")))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("I am building project "), k, F.lit("!")))
            .when(F.col("event_type") == "click", F.concat(F.lit("I prefer option "), k, F.lit(".")))
            .when(F.col("event_type") == "view", F.lit("Hello there!"))
            .otherwise(F.concat(F.lit("Fix my code "), k, F.lit(".")))
        )

    def statement_jobs(self) -> DataFrame:
        """Ingest jobs of what users say in ten consecutive events."""
        said = F.struct("event_id", self.statement().alias("content"))
        return (
            self.events()
            # A job's id is made of both, so it need not travel.
            .groupBy("user_id", whole("event_id", ACTIONS_PER_JOB).alias("seq"))
            .agg(F.array_sort(F.collect_list(said)).alias("m"))
            .select(
                self._job_id(F.col("seq")).alias("req_id"),
                "user_id",
                "seq",
                F.transform(
                    "m", lambda m: F.struct(F.lit("user").alias("role"), m["content"].alias("content"))
                ).alias("messages"),
                F.lit(INSERT_THRESHOLD).alias("threshold"),
            )
        )

    def known_documents(self) -> DataFrame:
        """Documents that came with a vector, as the older part of the general table."""
        return self.documents().join(
            self.vectors().select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi"
        )

