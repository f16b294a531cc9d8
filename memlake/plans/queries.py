"""The registered queries: each runs one operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import curate, encode, requests, retrieve, rules, state
from memlake.plans import read
from memlake.plans.streams import STREAM_QUERIES
from memlake.sources import jobs as job_log
from memlake.workload import Workload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Workload], DataFrame]) -> Callable[[Workload], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Workload(spark, sf_dir))
    return fn


def _search_sizes(w: Workload) -> dict:
    return {"memory_sizes": w.memory_sizes(), "query_sizes": w.query_sizes(), "sizes_complete": True}


def _hits(w: Workload) -> DataFrame:
    return retrieve.hybrid_hits(w.queries(), w.memories(), **_search_sizes(w))


def _ranked(lists: DataFrame) -> DataFrame:
    return lists.select(
        "query_id", "user_id", "memory_id", F.round("score", 6).alias("score"), "rank"
    )


def _job_hits(w: Workload) -> DataFrame:
    return _hits(w).withColumnRenamed("query_id", "req_id")


# -- sources ------------------------------------------------------------------


def _lines(w: Workload) -> DataFrame:
    """Job lines; two-turn jobs lose their last brace, those opened by the system are boxed."""
    jobs = w.jobs()
    line = F.to_json(
        F.struct(
            F.col("req_id").alias("ReqId"),
            F.col("user_id").alias("UserId"),
            F.col("messages").alias("Messages"),
            F.col("threshold").alias("Threshold"),
            F.lit("ignored").alias("Extra"),
        )
    )
    return jobs.select(
        "req_id",
        F.when(F.size("messages") == 2, F.regexp_replace(line, r"\}\z", ""))
        .when(F.col("messages")[0]["role"] == "system", F.concat(F.lit("["), line, F.lit("]")))
        .otherwise(line)
        .alias("value"),
    ).select("value")


@query
def decode_jobs(w: Workload) -> DataFrame:
    decoded = job_log.decode_jobs(_lines(w))
    return decoded.select(
        F.when(F.col("reason").isNull(), F.col("req_id")).alias("req_id"),
        F.when(F.col("reason").isNull(), F.col("user_id")).alias("user_id"),
        F.when(F.col("reason").isNull(), F.size("messages")).alias("n_messages"),
        F.when(F.col("reason").isNull(), F.col("messages")[0]["content"]).alias("opening"),
        F.when(F.col("reason").isNull(), F.col("threshold")).alias("threshold"),
        "reason",
    )


@query
def emit_jobs(w: Workload) -> DataFrame:
    jobs = w.jobs().select("user_id", "messages", "req_id")
    return job_log.emit_jobs(jobs, replayable=F.col("req_id"))


@query
def attach_dense(w: Workload) -> DataFrame:
    vectors = w.vectors().withColumnRenamed("vec_id", "doc_id")
    return encode.attach_vectors(w.documents(), vectors, "doc_id").select(
        "doc_id",
        "memory_id",
        F.coalesce(F.size("dense"), F.lit(0)).alias("dim"),
        F.round(
            F.sqrt(F.aggregate("dense", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), 6
        ).alias("length"),
    )


# -- requests and context -----------------------------------------------------


def _requests(w: Workload) -> DataFrame:
    """Retrieval requests of all four kinds, by the shape of their conversation."""
    jobs = w.jobs()
    opened = F.col("messages")[0]["role"] == "system"
    n = F.size("messages")
    return jobs.select(
        "req_id",
        "user_id",
        F.when(opened, F.array().cast("array<struct<role:string,content:string>>"))
        .when(n > 3, F.col("messages"))
        .alias("messages"),
        F.when(n == 2, F.col("messages")[0]["content"]).otherwise("").alias("query"),
    )


@query
def stamp_requests(w: Workload) -> DataFrame:
    events = w.events()
    asked = events.select(
        "event_id",
        "user_id",
        F.when(F.col("event_type") == "error", 0.0)
        .when(F.col("event_type") != "view", F.col("value") / 500)
        .alias("threshold"),
    )
    return requests.stamp_requests(asked).withColumn("threshold", F.round("threshold", 6))


@query
def clean_user_keys(w: Workload) -> DataFrame:
    raw = w.events().select(
        "event_id",
        F.when(F.col("event_type") == "error", "\"' ")
        .otherwise(F.concat(F.lit(" '"), F.col("user_id"), F.lit("\" ")))
        .alias("user_id"),
    )
    return requests.clean_user_keys(raw)


@query
def resolve_query_text(w: Workload) -> DataFrame:
    return requests.resolve_query_text(_requests(w)).select(
        "req_id", "user_id", "status", "query_text"
    )


@query
def explode_turns(w: Workload) -> DataFrame:
    return requests.explode_turns(w.jobs())


@query
def transcript(w: Workload) -> DataFrame:
    return requests.add_transcript(w.jobs()).select("req_id", "transcript")


@query
def context_query(w: Workload) -> DataFrame:
    return requests.add_context_query(w.jobs()).select("req_id", "context_query")


@query
def fallback_query(w: Workload) -> DataFrame:
    return requests.add_fallback_query(w.jobs()).select("req_id", "fallback_query")


@query
def last_user_turn(w: Workload) -> DataFrame:
    return requests.add_last_user_turn(w.jobs()).select("req_id", "last_user_turn", "found")


@query
def skip_gate(w: Workload) -> DataFrame:
    n = F.size("messages")
    expanded = w.jobs().withColumn(
        "expanded_query",
        F.when(n == 2, "Skip").when(n == 3, "skip ").otherwise(F.col("messages")[0]["content"]),
    )
    return requests.skip_gate(expanded).select("req_id", "required")


# -- encoding -----------------------------------------------------------------


@query
def sparse_encode(w: Workload) -> DataFrame:
    return encode.sparse_postings(w.dealt("documents"), "doc_id", "text").select(
        F.col("id").alias("doc_id"), "idx", F.round(F.col("w").cast("double"), 5).alias("w")
    )


@query
def sparse_encode_idf(w: Workload) -> DataFrame:
    vectors = encode.weighted_vectors(w.dealt("documents"), "doc_id", "text", normalise=True)
    return vectors.select(
        F.col("id").alias("doc_id"),
        F.size("sparse.indices").alias("n_terms"),
        F.round(
            F.aggregate("sparse.values", F.lit(0.0), lambda s, x: s + x.cast("double")), 4
        ).alias("total"),
    )


@query
def encode_plugin(w: Workload) -> DataFrame:
    texts = w.dealt("documents").select("doc_id", "text")
    encoded = encode.encode(texts, "text", encode.hashed_encoder(64))

    def total(c: str):
        return F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")), 3)

    return encoded.select(
        "doc_id",
        F.size("dense").alias("dim"),
        total("dense").alias("dense_total"),
        F.size("sparse.indices").alias("n_terms"),
        total("sparse.values").alias("sparse_total"),
    )


@query
def isolated_failure(w: Workload) -> DataFrame:
    """An encoder that refuses texts with an address, over all documents: who fails, and that nobody else does."""
    plain = encode.hashed_encoder(64)

    def refusing(texts):
        if any("@" in text for text in texts):
            raise ValueError("address in text")
        return plain(texts)

    encoded = encode.encode_isolated(w.dealt("documents").select("doc_id", "text"), "text", refusing, dim=64)
    n_terms = F.when(F.col("problem").isNull(), F.size("sparse.indices"))
    return encoded.select("doc_id", "problem", F.size("dense").alias("dim"), n_terms.alias("n_terms"))


@query
def encode_check(w: Workload) -> DataFrame:
    vectors = w.vectors().withColumnRenamed("vec_id", "doc_id")
    return encode.encode_check(w.table("documents"), vectors, "doc_id", dim=64)


# -- retrieval ----------------------------------------------------------------


@query
def dense_topk(w: Workload) -> DataFrame:
    return _ranked(retrieve.dense_topk(w.queries(), w.memories(), **_search_sizes(w)))


@query
def sparse_topk(w: Workload) -> DataFrame:
    return _ranked(retrieve.sparse_topk(w.queries(), w.memories(), **_search_sizes(w)))


@query
def rrf_fuse(w: Workload) -> DataFrame:
    lists = retrieve.branch_topk(w.queries(), w.memories(), **_search_sizes(w))
    return _ranked(retrieve.rrf_fuse(lists))


@query
def score_cut(w: Workload) -> DataFrame:
    return _ranked(_hits(w))


@query
def hybrid_retrieve(w: Workload) -> DataFrame:
    found = retrieve.with_texts(_hits(w), w.memory_texts())
    return found.select(
        "query_id", "user_id", "rank", "memory_id", "memory_text", "type",
        F.round("score", 6).alias("score"),
    )


@query
def retrieve_with_core(w: Workload) -> DataFrame:
    found = retrieve.with_texts(_hits(w), w.memory_texts())
    asked = w.jobs().select(F.col("req_id").alias("query_id"), "user_id")
    return retrieve.retrieve_with_core(asked, found, w.core())


@query
def get_all_general(w: Workload) -> DataFrame:
    return retrieve.get_all_general(w.memory_texts(), w.events().select("user_id"))


@query
def get_core(w: Workload) -> DataFrame:
    return retrieve.get_core(w.core(), w.users())


@query
def get_all_memories(w: Workload) -> DataFrame:
    return retrieve.get_all_memories(w.memory_texts(), w.core(), w.users())


def _raw_keys(w: Workload) -> DataFrame:
    """Keys as clients send them, quoted and padded; every user also sends an empty one."""
    users = w.users()
    quoted = users.select(F.concat(F.lit(" '"), F.col("user_id"), F.lit('" ')).alias("user_id"))
    return quoted.unionByName(users.select(F.lit("\"' ").alias("user_id")))


@query
def get_all_by_key(w: Workload) -> DataFrame:
    return read.all_of(_raw_keys(w), w.memory_texts(), w.core())


@query
def get_core_by_key(w: Workload) -> DataFrame:
    return read.core_of(_raw_keys(w), w.core())


@query
def get_core_status(w: Workload) -> DataFrame:
    return retrieve.get_core_status(w.core(), w.events().select("user_id").union(w.users()))


@query
def ids_exist(w: Workload) -> DataFrame:
    asked = w.delete_requests().select(
        "request_id", "user_id", F.explode("memory_ids").alias("memory_id")
    )
    return retrieve.ids_exist(w.base_facts(), asked).select(
        "request_id", "user_id", "memory_id", "found"
    )


# -- curation -----------------------------------------------------------------


@query
def ordinal_map(w: Workload) -> DataFrame:
    return curate.ordinal_map(w.jobs(), w.core(), _job_hits(w))


@query
def build_prompts(w: Workload) -> DataFrame:
    hits = retrieve.with_texts(_job_hits(w), w.memory_texts())
    return curate.build_prompts(w.jobs(), w.core(), hits)


@query
def parse_plans(w: Workload) -> DataFrame:
    actions, _ = curate.parse_plans(w.plans())
    return actions


@query
def validate_actions(w: Workload) -> DataFrame:
    return curate.validate_actions(w.raw_actions()).drop("user_id")


@query
def resolve_targets(w: Workload) -> DataFrame:
    actions = curate.validate_actions(w.raw_actions())
    seen = w.job_hits()
    return curate.resolve_targets(actions, w.core(), seen).select(
        "req_id", "event_id", "action_type", "verdict", "target_memory_id"
    )


@query
def gatekeeper(w: Workload) -> DataFrame:
    spoken = rules.user_sentences(w.jobs().unionByName(w.statement_jobs()))
    return rules.gatekeeper(spoken).select("req_id", "turn", "pos", "sentence", "keep", "why")


@query
def assign_slots(w: Workload) -> DataFrame:
    spoken = rules.user_sentences(w.jobs().unionByName(w.statement_jobs()))
    return rules.assign_slots(spoken).where("slot is not null").select(
        "req_id", "turn", "pos", "tier", "slot", "value"
    )


@query
def resolve_conflicts(w: Workload) -> DataFrame:
    facts = w.facts()
    half = F.floor(w.table("events").agg(F.count(F.lit(1))).scalar() / 2)
    old = facts.where(F.col("event_id") < half).select(
        "user_id", "slot", "value", F.concat(F.lit("e"), F.col("event_id")).alias("memory_id")
    )
    new = facts.where(F.col("event_id") >= half)
    return rules.resolve_conflicts(new, old).select(
        "req_id", "user_id", "slot", "action_type", "payload", "target_memory_id"
    )


@query
def suppress_duplicates(w: Workload) -> DataFrame:
    fresh = rules.suppress_duplicates(w.documents(), w.known_documents(), "doc_id")
    return fresh.select("doc_id", "user_id", "memory_id")


@query
def suppress_near_duplicates(w: Workload) -> DataFrame:
    facts = w.queries().withColumnRenamed("query_id", "fact_id")
    return rules.suppress_near_duplicates(facts, w.memories(), 0.25, **_search_sizes(w)).select(
        "fact_id", "user_id"
    )


@query
def plan_provider(w: Workload) -> DataFrame:
    facts = rules.extract_facts(w.statement_jobs())
    return rules.rule_actions(facts, w.core()).select(
        "req_id", "user_id", "seq", "tier", "action_type", "payload"
    )


# -- state --------------------------------------------------------------------


@query
def memory_id(w: Workload) -> DataFrame:
    return w.documents().select("doc_id", "user_id", "memory_id")


@query
def upsert_memories(w: Workload) -> DataFrame:
    incoming = w.documents()
    stored = state.newest_rows(
        w.known_documents(), ["user_id", "memory_id"], F.desc("doc_id")
    )
    return state.upsert_memories(stored, incoming, "doc_id").select(
        "user_id", "memory_id", "doc_id", F.octet_length("memory_text").alias("n_bytes")
    )


@query
def apply_general(w: Workload) -> DataFrame:
    return state.apply_general(w.base_facts(), state.general_ops(w.actions()))


@query
def apply_core(w: Workload) -> DataFrame:
    return state.apply_core(w.base_profile(), state.core_ops(w.core_actions()))


@query
def delete_memories(w: Workload) -> DataFrame:
    return state.delete_memories(w.base_facts(), w.delete_requests())


@query
def delete_audit(w: Workload) -> DataFrame:
    return state.delete_audit(w.base_facts(), w.delete_requests())


QUERIES.update(STREAM_QUERIES)
