"""Plans, ordinals, targets, prompts and the rule planner."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from memlake.operators import curate, rules, state

JOBS = (
    "req_id string, user_id string, seq bigint, messages array<struct<role:string,content:string>>"
)
CORE = "user_id string, memory_id string, memory_text string, ord bigint, ord_pos bigint"
HITS = "req_id string, user_id string, memory_id string, memory_text string, rank int"
PLANS = "req_id string, user_id string, seq bigint, plan_json string"


def insert(text):
    return {"action_type": "INSERT", "payload": text, "target_memory_id": None}


def delete(number):
    return {"action_type": "DELETE", "payload": None, "target_memory_id": number}


def plan(core, general, spaced=True):
    keys = ["step_1 critical_reasoning", "step_2 core_memory_actions", "step_3 general_memory_actions"]
    if not spaced:
        keys = [k.replace(" ", "_") for k in keys]
    return json.dumps(dict(zip(keys, ["because", core, general])))


@pytest.fixture(scope="module")
def world(spark):
    core = spark.createDataFrame(
        [("u", f"core_0{i + 1}", f"core text {i + 1}", i, 0) for i in range(3)]
        + [("other", "o1", "else", 0, 0)],
        CORE,
    )
    hits = spark.createDataFrame(
        [("r1", "u", f"gen_10{i + 1}", f"general text {i + 1}", i + 1) for i in range(6)], HITS
    )
    jobs = spark.createDataFrame([("r1", "u", 1, [("user", "hi")]), ("r2", "w", 2, [])], JOBS)
    return jobs, core, hits


def act(spark, world, rows):
    _, core, hits = world
    actions, dead = curate.parse_plans(spark.createDataFrame(rows, PLANS))
    return curate.resolve_targets(curate.validate_actions(actions), core, hits), dead


@pytest.mark.parametrize("spaced", [True, False])
def test_multi_turn_plan(spark, world, spaced):
    text = plan(
        [delete("0"), delete("1"), insert("Lives in Tokyo"), insert("Is single")],
        [delete(str(i)) for i in (3, 4, 5, 6, 8)] + [insert("Runs at 5 AM"), insert("Writes Rust")],
        spaced,
    )
    actions, dead = act(spark, world, [("r1", "u", 10, text)])
    assert dead.count() == 0
    _, core, hits = world
    base = hits.select("user_id", "memory_id", "memory_text")
    after = state.apply_general(base, state.general_ops(actions)).collect()
    assert {r.memory_text for r in after} == {"general text 5", "Runs at 5 AM", "Writes Rust"}
    profile = state.apply_core(core, state.core_ops(actions)).where("user_id = 'u'")
    texts = [r.memory_text for r in profile.orderBy("ord", "ord_pos").collect()]
    assert texts == ["core text 3", "Lives in Tokyo", "Is single"]


def test_strict_keys(spark):
    rows = [("r1", "u", 1, plan([insert("a")], [], False))]
    actions, _ = curate.parse_plans(spark.createDataFrame(rows, PLANS), accept_underscore_keys=False)
    assert actions.count() == 0


def test_bad_plans_and_actions(spark, world):
    weird = [insert(None), delete(None), {"action_type": "UPDATE"}, delete("99"), delete("07"),
             {**insert("x"), "target_memory_id": "1"}, {**delete("2"), "payload": "y"}]
    rows = [("r1", "u", 1, plan(weird, weird)), ("r9", "u", 2, "no json"), ("r8", "u", 3, "[1]")]
    actions, dead = act(spark, world, rows)
    assert sorted(r.req_id for r in dead.collect()) == ["r8", "r9"]
    for tier in ("core", "general"):
        got = actions.where(F.col("tier") == tier).orderBy("pos").collect()
        assert [r.verdict for r in got] == [
            "invalid", "invalid", "ignored", "not_found", "not_found", "ok", "ok"
        ]
        assert [(r.payload, r.target_memory_id) for r in got[5:]] == [("x", None), (None, "core_03")]
        assert got[3].target_memory_id is None


def test_core_action_naming_a_general_id_strikes_nothing(spark, world):
    actions, _ = act(spark, world, [("r1", "u", 1, plan([delete("3")], []))])
    assert actions.first().target_memory_id == "gen_101"
    _, core, _ = world
    assert state.apply_core(core, state.core_ops(actions)).count() == core.count()


def test_ordinals_and_prompt(spark, world):
    jobs, core, hits = world
    numbers = {r.ordinal: r.memory_id for r in curate.ordinal_map(jobs, core, hits).collect()}
    assert [numbers[str(i)] for i in range(9)] == [f"core_0{i}" for i in (1, 2, 3)] + [
        f"gen_10{i}" for i in range(1, 7)
    ]
    for per_part in (1000, 2):
        pieces = curate.build_prompts(jobs, core, hits, per_part).collect()
        text = {}
        for r in sorted(pieces, key=lambda r: (r.req_id, r.section, r.part)):
            text[r.req_id] = text.get(r.req_id, "") + r.text
        body = text["r1"].split("</EXISTING_CORE_MEMORIES>")
        listed = json.loads(body[0].split(">", 1)[1])
        assert [x["id"] for x in listed] == ["0", "1", "2"] and listed[0]["type"] == "core"
        old = json.loads(body[1].split("<EXISTING_OLD_MEMORIES>")[1].split("</EXISTING_OLD")[0])
        assert [x["id"] for x in old] == [str(i) for i in range(3, 9)]
        assert "User: hi\n" in text["r1"]
        assert text["r2"].count("null") == 2


def test_places_are_ranked_in_stretches(spark):
    rows = [("u", f"m{i:03d}", "t", i * 3, 0) for i in range(100)] + [("v", "x", "t", 5, 0)]
    core = spark.createDataFrame(rows, CORE).repartition(5)
    for stride in (1, 7, 1 << 16):
        got = curate.core_positions(core, stride).where("user_id = 'u'").orderBy("place").collect()
        assert [(r.place, r.memory_id) for r in got] == [(i, f"m{i:03d}") for i in range(100)]


@pytest.mark.parametrize(
    "text, keep",
    [
        ("Hello", False), ("How are you?", False), ("Thanks!", False), ("I'm hungry", False),
        ("I'm going to sleep", False), ("I'm driving right now.", False),
        ("Here is my code, fix it", False), ("Write a poem about dogs", False),
        ("That's cool", False), ("I like that", False), ("The sky is blue.", False),
        ("I am 25", True), ("I live in Berlin", True), ("I prefer short answers", True),
        ("I hate Java", True), ("I am building a RAG app", True), ("My name is Kim.", True),
    ],
)
def test_gatekeeper(spark, text, keep):
    df = spark.createDataFrame([(text,)], "sentence string")
    assert rules.gatekeeper(df).first().keep is keep


def test_slots(spark):
    said = {
        "My name is Kim.": ("core", "name", "kim"), "I am 25": ("core", "age", "25"),
        "I live in New York!": ("core", "location", "new york"),
        "I work as a nurse.": ("core", "profession", "nurse"),
        "Always answer in French.": ("core", "instruction", "always answer in french"),
        "I code in Go.": ("general", "skill", "go"),
        "I have a dog called Rex.": ("general", "pet", "dog called rex"),
        "I hate Java.": ("general", "taste", "hate java"), "Nothing here": (None, None, None),
    }
    df = spark.createDataFrame([(t,) for t in said], "sentence string")
    got = {r.sentence: (r.tier, r.slot, r.value) for r in rules.assign_slots(df).collect()}
    assert got == said


FACTS = (
    "req_id string, user_id string, seq bigint, pos bigint, tier string, slot string, "
    "value string, memory_text string"
)


def test_conflicts(spark):
    facts = [("r1", "u", 1, 0, "core", "name", "a", "name: a"), ("r2", "u", 2, 0, "core", "name", "b", "name: b"),
             ("r1", "u", 1, 1, "core", "age", "5", "age: 5"), ("r1", "v", 1, 0, "core", "age", "7", "age: 7")]
    old = [("u", "name", "a", "n1"), ("u", "name", "c", "n2"), ("u", "age", "5", "a1")]
    out = rules.resolve_conflicts(
        spark.createDataFrame(facts, FACTS),
        spark.createDataFrame(old, "user_id string, slot string, value string, memory_id string"),
    )
    got = {(r.user_id, r.slot, r.action_type, r.payload, r.target_memory_id, r.req_id) for r in out.collect()}
    assert got == {
        ("u", "name", "DELETE", None, "n1", "r2"), ("u", "name", "DELETE", None, "n2", "r2"),
        ("u", "name", "INSERT", "name: b", None, "r2"), ("v", "age", "INSERT", "age: 7", None, "r1"),
    }


def test_duplicates(spark):
    facts = [("u", 1, "Likes tea"), ("u", 2, " likes  TEA. "), ("u", 3, "Has a cat"), ("v", 4, "likes tea")]
    old = [("u", "has a cat!"), ("w", "likes tea")]
    out = rules.suppress_duplicates(
        spark.createDataFrame(facts, "user_id string, n int, memory_text string"),
        spark.createDataFrame(old, "user_id string, memory_text string"), "n",
    )
    assert sorted(r.n for r in out.collect()) == [1, 4]


def test_model_plans(spark, world):
    prompts = spark.createDataFrame([(f"r{i}", "u", i, f"p{i}") for i in range(5)],
                                    "req_id string, user_id string, seq bigint, prompt string")
    plans = curate.plans_from_model(prompts, lambda rows: [plan([insert(p)], []) for p in rows["prompt"]], 2)
    actions, _ = curate.parse_plans(plans)
    assert sorted(r.payload for r in actions.collect()) == [f"p{i}" for i in range(5)]
    given = plans.drop("user_id", "seq")
    jobs, _, _ = world
    assert [r.req_id for r in curate.plans_from_table(jobs, given).orderBy("req_id").collect()] == ["r1", "r2"]
