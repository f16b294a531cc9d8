"""A text or job that fails, fails alone."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators.encode import encode_isolated, hashed_encoder
from memlake.sources import MemoryStore
from memlake.streaming import RulePlanner, ingest_batch
from tests.test_stream import LINES, facts, line, profile

PLAIN = hashed_encoder(8)


def refusing(*words):
    def run(texts):
        if any(word in text for text in texts for word in words):
            raise ValueError("refused")
        return PLAIN(texts)

    return run


def test_only_failing_texts_have_a_problem(spark):
    texts = [f"text {i}" + (" bad" if i in (0, 7, 8, 29) else "") for i in range(30)] + [None, "", "text 1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    rows = encode_isolated(df, "text", refusing("bad"), dim=8, batch=16).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(texts)))
    for row in rows:
        if "bad" in (row.text or ""):
            assert row.problem == "ValueError: refused" and row.dense is None and row.sparse is None
        else:
            dense, pairs = PLAIN([row.text or ""])
            assert row.problem is None and np.allclose(row.dense, dense[0]) and row.sparse.indices == pairs[0][0]
    assert encode_isolated(df.limit(0), "text", refusing("bad")).count() == 0


def test_vectors_that_are_no_good_are_problems(spark):
    df = spark.createDataFrame([("short",), ("nan",), ("fine",)], "text string")

    def odd(texts):
        dense, pairs = PLAIN(texts)
        made = {"short": np.zeros(3), "nan": np.full(8, np.nan)}
        return [made.get(t, v) for t, v in zip(texts, dense)], pairs

    rows = encode_isolated(df, "text", odd, dim=8).collect()
    assert {r.text: r.problem for r in rows} == {"short": "wrong dimension", "nan": "not finite", "fine": None}


def test_an_encoder_that_is_down_is_no_problem_of_a_text(spark):
    df = spark.createDataFrame([("some text",)], "text string")
    with pytest.raises(Exception, match="refused"):
        encode_isolated(df, "text", refusing("")).collect()
    with pytest.raises(Exception, match="another number of vectors"):
        encode_isolated(df, "text", lambda texts: ([], [])).collect()


def test_a_poison_job_is_a_dead_letter_and_the_others_apply(spark, tmp_path):
    store = MemoryStore.create(spark, f"{tmp_path}/store")
    rows = [
        line("r1", "kim", "I live in Paris. I am building a boat."),
        line("r2", "kim", "I live in Rome. I am building a poison rocket."),
        line("r3", "lee", "I like jazz."),
        "{broken",
    ]
    batch = spark.createDataFrame([(v, i) for i, v in enumerate(rows)], LINES)
    ingest_batch(batch, 0, store, RulePlanner(), refusing("poison"), dim=8)
    # Planned without r2: what r1 says of the same slot stands again.
    assert profile(store, "kim") == ["location: paris"]
    assert facts(store) == [("kim", "project: a boat"), ("lee", "taste: like jazz")]
    assert all(len(r.dense) == 8 for r in store.general().collect())
    dead = {r.reason: r.raw for r in store.dead_letters().collect()}
    assert set(dead) == {"not JSON", "ValueError: refused"} and '"ReqId":"r2"' in dead["ValueError: refused"]
    audit = store.log("audit").first()
    assert (audit.jobs, audit.dead, audit.accepted, audit.inserted) == (4, 2, 2, 3)
    # The dead letter can be sent again once the encoder takes it; the stream goes on meanwhile.
    again = spark.createDataFrame([(dead["ValueError: refused"], 10), (line("r4", "lee", "I live in Oslo."), 11)], LINES)
    ingest_batch(again, 1, store, RulePlanner(), PLAIN, dim=8)
    assert profile(store, "lee") == ["location: oslo"] and profile(store, "kim") == ["location: rome"]
    assert store.log("jobs").where(F.col("req_id") == "r2").where("status = 'accepted'").count() == 1


def test_texts_that_surface_later_may_fail_too(spark, tmp_path):
    store = MemoryStore.create(spark, f"{tmp_path}/store")
    rows = [
        line("r1", "kim", "I am building a boat."),
        line("r2", "kim", "I am building a poison kite."),
        line("r3", "kim", "I am building a poison rocket."),
    ]
    batch = spark.createDataFrame([(v, i) for i, v in enumerate(rows)], LINES)
    ingest_batch(batch, 0, store, RulePlanner(), refusing("poison"))
    assert [text for _, text in facts(store)] == ["project: a boat"]
    assert store.dead_letters().count() == 2
