"""Folds against one-job-after-another simulations."""

from __future__ import annotations

import random

import pytest

from memlake.operators import state

OPS = "user_id string, memory_id string, memory_text string, is_insert boolean, seq bigint, pos bigint"
BASE = "user_id string, memory_id string, memory_text string"
CORE = BASE + ", ord bigint, ord_pos bigint"


def history(seed):
    rng = random.Random(seed)
    users, ids = ["hot", "hot", "hot", "b"], [f"m{i}" for i in range(6)]
    ops = []
    for seq in range(rng.randint(1, 25)):
        user = rng.choice(users)
        for pos in range(rng.randint(1, 4)):
            mid, insert = rng.choice(ids), rng.random() < 0.5
            ops.append((user, mid, f"text {mid}" if insert else None, insert, seq, pos))
    base = [(u, m, f"text {m}") for u in ("hot", "b") for m in ids if rng.random() < 0.5]
    return base, ops


def replay(base, ops, scoped):
    def key(u, m):
        return (u, m) if scoped else m

    table = {key(u, m): (u, m, t) for u, m, t in base}
    for seq in sorted({o[4] for o in ops}):
        job = [o for o in ops if o[4] == seq]
        for u, m, *_ in (o for o in job if not o[3]):
            table.pop(key(u, m), None)
        for u, m, t, *_ in (o for o in job if o[3]):
            table[key(u, m)] = (u, m, t)
    return sorted(table.values())


@pytest.mark.parametrize("seed", range(8))
def test_general_fold_is_replay(spark, seed):
    base, ops = history(seed)
    table, log = spark.createDataFrame(base, BASE), spark.createDataFrame(ops, OPS).repartition(4)
    got = sorted(tuple(r) for r in state.apply_general(table, log).collect())
    assert got == replay(base, ops, True)


def test_unscoped_delete_strikes_every_user(spark):
    base = spark.createDataFrame([("a", "m", "t")], BASE)
    ops = spark.createDataFrame([("b", "m", None, False, 1, 0)], OPS)
    assert state.apply_general(base, ops).count() == 1
    assert state.apply_general(base, ops, scope_to_user=False).count() == 0


def test_delete_then_insert_within_and_across_jobs(spark):
    empty = spark.createDataFrame([], BASE)
    one = [("u", "x", "X", True, 1, 0), ("u", "x", None, False, 1, 1)]
    two = [("u", "x", "X", True, 1, 0), ("u", "x", None, False, 2, 0)]
    assert state.apply_general(empty, spark.createDataFrame(one, OPS)).count() == 1
    assert state.apply_general(empty, spark.createDataFrame(two, OPS)).count() == 0


def _core_replay(base, ops):
    profile = [tuple(r[:3]) for r in sorted(base, key=lambda r: r[3:])]
    for seq in sorted({o[4] for o in ops}):
        job = sorted((o for o in ops if o[4] == seq), key=lambda o: o[5])
        struck = {(o[0], o[1]) for o in job if not o[3]}
        profile = [r for r in profile if (r[0], r[1]) not in struck]
        profile += [(o[0], o[1], o[2]) for o in job if o[3]]
    return profile


@pytest.mark.parametrize("seed", range(8))
def test_core_fold_is_replay(spark, seed):
    rng = random.Random(seed)
    base = [("u", f"c{i}", f"c{i}", -1, i) for i in range(4)]
    ops, known = [], [r[1] for r in base]
    for seq in range(15):
        new = []
        for pos in range(rng.randint(1, 3)):
            if rng.random() < 0.5:
                new.append(f"{seq}:{pos}")
                ops.append(("u", new[-1], new[-1], True, seq, pos))
            else:
                ops.append(("u", rng.choice(known + ["unknown"]), None, False, seq, pos))
        known += new
    out = state.apply_core(spark.createDataFrame(base, CORE), spark.createDataFrame(ops, OPS))
    got = [(r.user_id, r.memory_id, r.memory_text) for r in out.orderBy("ord", "ord_pos").collect()]
    assert got == _core_replay(base, ops)


def test_core_order(spark):
    base = spark.createDataFrame([("u", "c1", "1", -1, 0), ("u", "c2", "2", -1, 1)], CORE)
    ops = [("u", "a", "a", True, 5, 0), ("u", "c1", None, False, 5, 1), ("u", "b", "b", True, 5, 2)]
    out = state.apply_core(base, spark.createDataFrame(ops, OPS)).orderBy("ord", "ord_pos")
    assert [r.memory_id for r in out.collect()] == ["c2", "a", "b"]


def test_upsert_overwrites(spark):
    old = spark.createDataFrame([("u", "m1", "old"), ("u", "m2", "keep")], BASE)
    new = spark.createDataFrame(
        [("u", "m1", "first", 1), ("u", "m1", "last", 2), ("v", "m1", "other", 1)], BASE + ", n int"
    )
    got = sorted(tuple(r) for r in state.upsert_memories(old, new, "n").collect())
    assert got == [("u", "m1", "last"), ("u", "m2", "keep"), ("v", "m1", "other")]


def test_deletes_and_audit(spark):
    table = spark.createDataFrame([("u", "a", "a"), ("u", "b", "b"), ("v", "a", "a")], BASE)
    asked = spark.createDataFrame(
        [(1, "u", ["a", "b", "zz"]), (2, "u", ["zz"]), (3, "u", []), (4, "u", ["a", "a"])],
        "request_id int, user_id string, memory_ids array<string>",
    )
    left = [tuple(r) for r in state.delete_memories(table, asked).collect()]
    assert left == [("v", "a", "a")]
    audit = {r.request_id: tuple(r)[1:] for r in state.delete_audit(table, asked).collect()}
    assert audit == {
        1: (3, 2, 1, "ok"), 2: (1, 0, 1, "not found"), 3: (0, 0, 0, "not found"), 4: (2, 1, 1, "ok")
    }
    unscoped = state.delete_memories(table, asked, scope_to_user=False)
    assert unscoped.count() == 0
