"""Ids, job lines, requests and encoders."""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memlake.functions import context_query_text, fallback_query_text, memory_id
from memlake.functions.wire import read_job, read_plan
from memlake.operators import encode, requests
from memlake.sources import assemble_jobs, decode_jobs, emit_jobs, split_decoded


def test_memory_ids(spark):
    rows = [("abc", "u2"), ("Likes é tea", "u1"), ("ab", "c"), ("a", "bc"), ("", "")]
    rows += [(f"text {i}", f"ü{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "t string, u string").select("t", "u", memory_id("t", "u").alias("i"))
    got = {(r.t, r.u): r.i for r in df.collect()}
    assert got == {(t, u): str(uuid.uuid5(uuid.NAMESPACE_OID, t + u)) for t, u in rows}
    assert got["abc", "u2"] == "8bd6a9b5-f7d5-5362-8c67-15508712f79e"
    assert got["Likes é tea", "u1"] == "98fba3e5-b425-5b53-a49b-ef815d724192"


def test_decode(spark):
    lines = [
        '{"ReqId":"r1","UserId":"u","Messages":[{"role":"user","content":"hi"}],"Threshold":0.6}',
        "{bad json",
        '{"ReqId":"r3","UserId":"u","Messages":null,"Extra":{"a":[1]}}',
        "[]",
        '{"ReqId":5}',
        '{"ReqId":"r6"} trailing',
        '{"Threshold":"x"}',
        "null",
        "",
        '[{"ReqId":"r"}]',
        '{"Messages":7}',
        "{'ReqId':'q'}",
        '"text"',
    ]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    good, dead = split_decoded(decode_jobs(df))
    kept = {(r.req_id, r.user_id, r.messages and len(r.messages), r.threshold) for r in good.collect()}
    assert kept == {("r1", "u", 1, 0.6), ("r3", "u", None, 0.0), ("", "", None, 0.0)}
    assert dead.count() == len(lines) - 3


def test_emit_round_trip(spark):
    rows = [("u1", [("user", 'a "quoted"\n\tline é')]), ("u2", [])]
    req = spark.createDataFrame(rows, "user_id string, messages array<struct<role:string,content:string>>")
    lines = emit_jobs(req)
    back = decode_jobs(lines.select("value")).orderBy("user_id").collect()
    assert [(r.user_id, [tuple(m) for m in r.messages], r.threshold) for r in back] == [
        ("u1", [("user", 'a "quoted"\n\tline é')], 0.6),
        ("u2", [], 0.6),
    ]
    assert len({r.req_id for r in lines.collect()}) == 2
    wire = json.loads(lines.first().value)
    assert list(wire) == ["ReqId", "UserId", "Messages", "Threshold"]


def test_a_long_conversation_is_one_job(spark):
    turns = spark.range(2500).select(
        F.lit("u").alias("user_id"), F.lit(7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"), F.lit("user").alias("role"),
        F.concat(F.lit("S"), F.col("id"), F.lit(".")).alias("content"),
    )
    (job,) = assemble_jobs(turns).select(
        "req_id", "seq", F.size("messages").alias("n"), context_query_text("messages").alias("context"),
        fallback_query_text("messages").alias("fallback"),
    ).collect()
    assert (job.req_id, job.seq, job.n) == ("r7", 7, 2500)
    kept, size = [], 0
    for i in reversed(range(2500)):
        if size >= 500:
            break
        kept.insert(0, f"S{i}.")
        size += len(kept[0])
    assert job.context == "\n".join(kept)
    assert job.fallback.startswith("S2499.\nS2498.\n") and len(job.fallback) > 1900


def test_lines_of_any_length_decode(spark):
    one = json.dumps({"ReqId": "a", "UserId": "u", "Messages": [{"role": "user", "content": "x" * 22_000_000}]})
    many = json.dumps({"ReqId": "b", "Messages": [{"role": "user", "content": "y" * 500_000}] * 60})
    df = spark.createDataFrame([(one,), (many,)], "value string")
    rows = decode_jobs(df).select("req_id", "reason", F.size("messages").alias("n"), F.length(F.col("messages")[0]["content"]).alias("l"))
    assert sorted(map(tuple, rows.collect())) == [("a", None, 1, 22_000_000), ("b", None, 60, 500_000)]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('{"reqId":"r","USERID":"u","messages":[{"Role":"user","CONTENT":"c"}],"threshold":1}', ("r", "u", [("user", "c")], 1.0, None)),
        ('{"ReqId":"a","reqid":"b","ReqId":null}', ("b", "", None, 0.0, None)),
        ('{"Messages":[{"role":"user","content":"1","content":"2"},null]}', ("", "", [("user", "2"), ("", "")], 0.0, None)),
        ('{"Messages":[{"role":"user","content":5}]}', ("", "", None, 0.0, "wrong type")),
        ('{"Messages":["x"]}', ("", "", None, 0.0, "wrong type")),
        ('{"Threshold":"0.5"}', ("", "", None, 0.0, "wrong type")),
        ('{"Threshold":NaN}', ("", "", None, 0.0, "not JSON")),
        ('{"UserId":true}', ("", "", None, 0.0, "wrong type")),
        ('{"ReqId":"r","Other":{"ReqId":5}}', ("r", "", None, 0.0, None)),
        ('{"ReqId":"\\ud800x"}', ("\ufffdx", "", None, 0.0, None)),
        ("7", ("", "", None, 0.0, "not an object")),
    ],
)
def test_wire_form(line, want):
    got = read_job(line)
    messages = got["messages"] and [(m["role"], m["content"]) for m in got["messages"]]
    assert (got["req_id"], got["user_id"], messages, got["threshold"], got["reason"]) == want


def test_plans_have_strict_types():
    action = {"action_type": "DELETE", "target_memory_id": 4}
    assert read_plan(json.dumps({"step_2 core_memory_actions": [action]}))["reason"] == "wrong type"
    plan = read_plan('{"STEP_2 core_memory_actions":[{"Action_Type":"INSERT","payload":"x","payload":"y"}]}')
    assert plan["core"] == [{"action_type": "INSERT", "payload": "y", "target_memory_id": None}] and plan["reason"] is None
    assert read_plan("null")["reason"] == "not an object"


def test_requests(spark):
    schema = "id int, messages array<struct<role:string,content:string>>, query string, threshold double"
    rows = [
        (1, [("user", "One. Two.")], "q", 0.0),
        (2, [], "q", None),
        (3, None, "q", 0.3),
        (4, None, "", 0.65),
        (5, None, None, 1.0),
    ]
    df = requests.stamp_requests(requests.resolve_query_text(spark.createDataFrame(rows, schema)))
    got = {r.id: (r.status, r.query_text, r.threshold) for r in df.collect()}
    assert got == {
        1: ("messages", "One. Two.", 0.65),
        2: ("error", None, 0.65),
        3: ("query", "q", 0.3),
        4: ("none", None, 0.65),
        5: ("none", None, 1.0),
    }
    gate = spark.createDataFrame([("SKIP",), ("skip ",), ("a",), (None,)], "expanded_query string")
    assert [r.required for r in requests.skip_gate(gate).collect()] == [False, True, True, True]


def _counted(text):
    import regex

    return Counter(t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t)


def test_sparse_encoder_and_plugin_agree(spark):
    import hashlib

    texts = ["Tea, tea and TEA!", "", "...", "_Query_Tea for two", "Été à la plage 漢字 42", "x " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    built = {r.id: r.sparse for r in encode.sparse_encode(df, "text").collect()}
    plug = {r.id: r for r in encode.encode(df, "text", encode.hashed_encoder(8)).collect()}
    for i, text in enumerate(texts):
        tf = _counted(text.removeprefix("_Query_"))
        want = {int(hashlib.md5(t.encode()).hexdigest()[:8], 16): 1 + math.log(n) for t, n in tf.items()}
        got = dict(zip(built[i]["indices"], built[i]["values"]))
        assert list(got) == sorted(want) and got == pytest.approx(want)
        assert plug[i].sparse == built[i] and len(plug[i].dense) == 8
    assert 1916398123 in built[0]["indices"]
    assert encode.encode(df.where("false"), "text", encode.hashed_encoder(8)).count() == 0
    only = encode.encode(df, "text", encode.hashed_encoder(8), sparse=False)
    assert only.columns == ["id", "text", "dense"]


def test_short_encoder_output_fails(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)

    def short(texts):
        dense, pairs = encode.hashed_encoder(4)(texts)
        return dense[:1], pairs[:1]

    with pytest.raises(Exception, match="another number of vectors"):
        encode.encode(df, "text", short).collect()


def test_encode_check(spark):
    texts = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0])], "id int, dense array<float>")
    got = {tuple(r) for r in encode.encode_check(texts, vectors, "id", 2).collect()}
    assert got == {(2, "wrong dimension"), (3, "missing")}


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Run from another folder, where Python workers cannot import the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from memlake.operators.encode import encode, hashed_encoder
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.createDataFrame([("a b",)], "text string")
print("vectors:", encode(df, "text", hashed_encoder(4)).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "vectors: 1" in out.stdout, out.stderr[-2000:]
