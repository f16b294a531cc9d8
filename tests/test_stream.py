"""The write path as a stream, its store, replays and failures."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from memlake.plans import streams
from memlake.workload import Workload
from memlake.operators.encode import hashed_encoder
from memlake.plans.read import get_memories
from memlake.sources import MemoryStore, emit_jobs, job_stream, publish_jobs
from memlake.streaming import (
    ModelPlanner,
    PreparedPlans,
    RulePlanner,
    delete_from_store,
    ingest_batch,
    ingest_stream,
)
from tests.test_curate import delete, insert, plan

ENCODER = hashed_encoder(16)
LINES = "value string, seq bigint"


def line(req, user, *texts):
    messages = [{"role": "user", "content": t} for t in texts]
    return json.dumps({"ReqId": req, "UserId": user, "Messages": messages, "Threshold": 0.6})


def write(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(rows) + "\n")


def profile(store, user):
    rows = store.core().where(F.col("user_id") == user).orderBy("ord", "ord_pos").collect()
    return [r.memory_text for r in rows]


def facts(store):
    return sorted((r.user_id, r.memory_text) for r in store.general().collect())


TALKS = [
    [line("r1", "kim", "Hello!", "My name is Kim. I live in Paris."), line("r2", "lee", "I like jazz.")],
    ["{broken", line("r3", "kim", "I live in Rome now. I am building a boat."), line("r2", "lee", "I like rock.")],
    [line("r4", "lee", "I live in Oslo."), line("r1", "kim", "My name is Max.")],
]


def stream(spark, tmp_path, name, files, max_files):
    log = f"{tmp_path}/{name}/log"
    for i, rows in enumerate(files):
        write(log, f"part-{i}.txt", rows)
        os.utime(f"{log}/part-{i}.txt", (1_700_000_000 + i, 1_700_000_000 + i))
    store = MemoryStore.create(spark, f"{tmp_path}/{name}/store")
    ingest_stream(
        job_stream(spark, log, maxFilesPerTrigger=max_files), store, RulePlanner(), ENCODER,
        f"{tmp_path}/{name}/checkpoint", compact_every=2,
    ).awaitTermination()
    return store


def test_stream_equals_one_batch_per_file(spark, tmp_path):
    store = stream(spark, tmp_path, "s", TALKS, 1)
    assert profile(store, "kim") == ["name: kim", "location: rome now"]
    assert profile(store, "lee") == ["location: oslo"]
    want = [("kim", "project: a boat"), ("lee", "taste: like jazz")]
    assert facts(store) == want
    audit = store.log("audit").orderBy("v").collect()
    assert [(a.jobs, a.dead, a.replayed, a.accepted) for a in audit] == [
        (2, 0, 0, 2), (3, 1, 1, 1), (2, 0, 1, 1)
    ]
    assert [(a.inserted, a.deleted) for a in audit] == [(3, 0), (2, 1), (1, 0)]
    assert [tuple(d) for d in store.dead_letters().collect()] == [("{broken", "not JSON", 1)]
    assert [(c.version, c.kind) for c in store.commits() if c.kind == "base"] == [
        (-1, "base"), (1, "base")
    ]
    # Another log with a checkpoint of its own goes on where this one ended.
    write(f"{tmp_path}/more", "part-0.txt", [line("m1", "kim", "I live in Bonn.")])
    ingest_stream(
        job_stream(spark, f"{tmp_path}/more"), store, RulePlanner(), ENCODER, f"{tmp_path}/more-cp"
    ).awaitTermination()
    assert profile(store, "kim") == ["name: kim", "location: bonn"]

    again = MemoryStore.create(spark, f"{tmp_path}/again")
    for i, rows in enumerate(TALKS):
        batch = spark.createDataFrame([(v, 10 * i + n) for n, v in enumerate(rows)], LINES)
        ingest_batch(batch, i, again, RulePlanner(), ENCODER)
    assert facts(again) == want
    assert profile(again, "kim") == ["name: kim", "location: rome now"]
    before = sorted(map(tuple, again.core().collect()))
    assert again.compact() == 2 and again.next_version() == 3
    assert sorted(map(tuple, again.core().collect())) == before and facts(again) == want


def test_failed_batch_changes_nothing_and_can_be_repeated(spark, tmp_path):
    store = MemoryStore.create(spark, f"{tmp_path}/store")
    batch = spark.createDataFrame([(v, i) for i, v in enumerate(TALKS[0])], LINES)

    def broken(texts):
        raise RuntimeError("encoder is down")

    with pytest.raises(Exception, match="encoder is down"):
        ingest_batch(batch, 0, store, RulePlanner(), broken)
    assert facts(store) == [] and profile(store, "kim") == []
    ingest_batch(batch, 0, store, RulePlanner(), ENCODER)
    state = facts(store), sorted(map(tuple, store.core().collect()))
    ingest_batch(batch, 0, store, RulePlanner(), ENCODER)
    ingest_batch(batch, 1, store, RulePlanner(), ENCODER)
    assert (facts(store), sorted(map(tuple, store.core().collect()))) == state


def test_prepared_plans_see_core_and_hits(spark, tmp_path):
    store = MemoryStore.create(spark, f"{tmp_path}/store")
    plans = {
        "a": plan([insert("Lives in Berlin"), insert("Is a student")], [insert("learns python basics")]),
        # Core entries are 0 and 1, so the one general memory found is 2.
        "b": plan([delete("0"), insert("Lives in London")], [delete("2"), insert("codes in go")]),
        "c": "no plan at all",
    }
    table = spark.createDataFrame(list(plans.items()), "req_id string, plan_json string")
    planner = PreparedPlans(table)
    for i, (req, text) in enumerate([("a", "x"), ("b", "python basics"), ("c", "y")]):
        batch = spark.createDataFrame([(line(req, "u", text), i)], LINES)
        ingest_batch(batch, i, store, planner, ENCODER)
    assert profile(store, "u") == ["Is a student", "Lives in London"]
    assert facts(store) == [("u", "codes in go")]
    last = store.log("audit").orderBy(F.desc("v")).first()
    assert (last.accepted, last.invalid, last.inserted) == (1, 1, 0)


def test_skipped_jobs_and_a_model(spark, tmp_path):
    store = MemoryStore.create(spark, f"{tmp_path}/store")
    planner = ModelPlanner(
        lambda rows: [plan([], [insert(p.split("User: ")[1].split("\n")[0])]) for p in rows["prompt"]]
    )
    rows = [(line("a", "u", "remember this"), 0), (line("b", "u", "SKIP"), 1)]
    batch = spark.createDataFrame(rows, LINES)

    def first_text(messages):
        return messages[0]["content"]

    ingest_batch(batch, 0, store, planner, ENCODER, expand=first_text)
    assert facts(store) == [("u", "remember this")]
    assert store.log("audit").first().skipped == 1


def test_read_path(spark, tmp_path):
    store = MemoryStore.create(spark, f"{tmp_path}/store")
    said = [
        ("kim", [("user", "Hello!"), ("user", "My name is Kim. I live in Paris.")]),
        ("lee", [("user", "I like jazz.")]),
    ]
    sent = spark.createDataFrame(
        said, "user_id string, messages array<struct<role:string,content:string>>"
    )
    publish_jobs(emit_jobs(sent), f"{tmp_path}/log")
    ingest_stream(
        job_stream(spark, f"{tmp_path}/log"), store, RulePlanner(), ENCODER, f"{tmp_path}/cp"
    ).awaitTermination()
    schema = (
        "query_id string, user_id string, messages array<struct<role:string,content:string>>, "
        "query string, threshold double"
    )
    requests = spark.createDataFrame(
        [("q1", "lee", None, "jazz", 0.0), ("q2", "kim", [("user", "Where do I live?")], None, None),
         ("q3", "kim", [], "x", 0.0), ("q4", "kim", None, "", 0.0)], schema,
    )
    out = get_memories(requests, store.general(), store.core(), ENCODER)
    rows = out.orderBy("query_id", "tier_ord", "ord", "ord_pos").collect()
    assert [(r.query_id, r.memory_text) for r in rows] == [
        ("q1", "taste: like jazz"), ("q2", "name: kim"), ("q2", "location: paris")
    ]


def test_jobs_go_by_the_order_of_their_files_not_by_size(spark, tmp_path):
    padding = "x " * 3000
    files = [
        [line("a", "kim", "I live in Rome.")],
        [line("b", "kim", f"{padding}. I live in Oslo."), line("b2", "lee", "I like jazz.", padding)],
        [line("c", "kim", "I live in Bonn.")],
    ]
    store = stream(spark, tmp_path, "order", files, 10)
    assert profile(store, "kim") == ["location: bonn"]
    jobs = store.log("jobs").orderBy("seq").collect()
    assert [j.req_id for j in jobs] == ["a", "b", "b2", "c"]
    assert [j.seq - jobs[0].seq for j in jobs] == [0, 1, 2, 3]


def test_jobs_without_id_share_nothing(spark, tmp_path):
    store = MemoryStore.create(spark, f"{tmp_path}/store")
    rows = [line("", "kim", "I live in Rome."), line("", "kim", "My name is Kim."), line("", "lee", "I live in Rome.")]
    ingest_batch(spark.createDataFrame([(v, i) for i, v in enumerate(rows)], LINES), 0, store, RulePlanner(), ENCODER)
    ids = [r.memory_id for r in store.core().collect()]
    assert len(ids) == len(set(ids)) == 3
    later = spark.createDataFrame([(line("", "kim", "I live in Bonn."), 10)], LINES)
    ingest_batch(later, 1, store, RulePlanner(), ENCODER)
    assert profile(store, "kim") == ["name: kim", "location: bonn"] and profile(store, "lee") == ["location: rome"]


def test_deleting_from_the_store(spark, tmp_path):
    store = MemoryStore.create(spark, f"{tmp_path}/store")
    rows = [line("a", "kim", "I like jazz. I like tea."), line("b", "lee", "I like jazz.")]
    ingest_batch(spark.createDataFrame([(v, i) for i, v in enumerate(rows)], LINES), 0, store, RulePlanner(), ENCODER)
    ids = {(r.user_id, r.memory_text): r.memory_id for r in store.general().collect()}
    asked = [("1", "kim", [ids["kim", "taste: like jazz"], "nothing"]), ("2", "kim", [ids["lee", "taste: like jazz"]])]
    requests = spark.createDataFrame(asked, "request_id string, user_id string, memory_ids array<string>")
    audit = {r.request_id: (r.deleted, r.missing, r.status) for r in delete_from_store(requests, store).collect()}
    assert audit == {"1": (1, 1, "ok"), "2": (0, 1, "not found")}
    assert facts(store) == [("kim", "taste: like tea"), ("lee", "taste: like jazz")]
    store.compact()
    assert facts(store) == [("kim", "taste: like tea"), ("lee", "taste: like jazz")]
    ingest_batch(spark.createDataFrame([(line("c", "kim", "I like jazz."), 9)], LINES), 1, store, RulePlanner(), ENCODER)
    assert ("kim", "taste: like jazz") in facts(store)


def test_each_text_is_encoded_once(spark, tmp_path):
    log = tmp_path / "encoded"
    log.mkdir()

    def counting(texts):
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(texts))
        return ENCODER(texts)

    store = MemoryStore.create(spark, f"{tmp_path}/store")
    rows = [line("a", "kim", "I like jazz."), line("b", "kim", "I like jazz."), line("c", "lee", "I like tea.")]
    ingest_batch(spark.createDataFrame([(v, i) for i, v in enumerate(rows)], LINES), 0, store, RulePlanner(), counting)
    schema = "query_id string, user_id string, messages array<struct<role:string,content:string>>, query string, threshold double"
    requests = spark.createDataFrame([("q1", "kim", None, "jazz", 0.0), ("q2", "lee", None, "tea", 0.0)], schema)
    assert get_memories(requests, store.general(), store.core(), counting).count() == 2
    seen = sorted(t for f in log.iterdir() for t in f.read_text().split("\n") if t)
    assert seen == ["_Query_jazz", "_Query_tea", "taste: like jazz", "taste: like tea"]


def test_jobs_of_a_log_are_put_together_once_however_often_they_are_delivered(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(req_id):
        made.add(1)
        return req_id

    class Done:
        def awaitTermination(self):
            pass

    whole = Workload.statement_jobs
    monkeypatch.setattr(Workload, "statement_jobs", lambda self: whole(self).withColumn("req_id", counted("req_id")))
    monkeypatch.setattr(streams, "ingest_stream", lambda *args, **options: Done())
    sf_dir = "/root/testdata/sf0.001"
    streams.run_log(spark, sf_dir, ["early", "late", "again"])
    assert made.value == whole(Workload(spark, sf_dir)).count()
