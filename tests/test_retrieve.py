"""Retrieval against brute force, with one user holding most of the rows."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import retrieve
from memlake.plans.queries import QUERIES
from memlake.schema import SPARSE

QUERY = f"query_id string, user_id string, threshold double, dense array<float>, sparse {SPARSE}"
MEMORY = f"user_id string, memory_id string, dense array<float>, sparse {SPARSE}"


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)

    def vectors():
        dense = None if rng.random() < 0.1 else [float(x) for x in rng.integers(-2, 3, 4)]
        idx = sorted({int(i) for i in rng.integers(0, 30, rng.integers(0, 6))} | {4_000_000_000})
        if rng.random() < 0.1:
            return dense, None
        return dense, {"indices": idx, "values": [float(v) for v in rng.integers(1, 4, len(idx))]}

    users = ["hot"] * 8 + ["a", "b", "c"]
    memories = [(users[rng.integers(len(users))], f"m{i:04d}", *vectors()) for i in range(600)]
    queries = [(f"q{i:03d}", users[rng.integers(len(users))], 0.6, *vectors()) for i in range(60)]
    queries.append(("q-none", "nobody", 0.6, *vectors()))
    return queries, memories


def brute(queries, memories, k, branch):
    out = {}
    for qid, user, _, dense, sparse in queries:
        scored = []
        for owner, mid, m_dense, m_sparse in memories:
            if owner != user:
                continue
            if branch == "dense" and dense and m_dense:
                a, b = np.array(dense), np.array(m_dense)
                n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
                scored.append((-round(float(a @ b / n) if n else 0.0, 9), mid))
            if branch == "sparse" and sparse and m_sparse:
                w = dict(zip(m_sparse["indices"], m_sparse["values"]))
                hits = [v * w[i] for i, v in zip(sparse["indices"], sparse["values"]) if i in w]
                if hits:
                    scored.append((-round(sum(hits), 9), mid))
        for rank, (score, mid) in enumerate(sorted(scored)[:k], 1):
            out[qid, mid] = (rank, round(-score, 6))
    return out


def frames(spark, corpus, partitions=3):
    queries, memories = corpus
    return (
        spark.createDataFrame(queries, QUERY).repartition(partitions),
        spark.createDataFrame(memories, MEMORY).repartition(partitions),
    )


@pytest.mark.parametrize("blocks", [{}, {"memory_block": 40, "query_block": 7}])
@pytest.mark.parametrize("branch", ["dense", "sparse"])
def test_topk_is_exact(spark, corpus, branch, blocks):
    lists = retrieve.branch_topk(*frames(spark, corpus), 10, branches=(branch,), **blocks)
    got = {(r.query_id, r.memory_id): (r["rank"], round(r.score, 6)) for r in lists.collect()}
    assert got == brute(*corpus, 10, branch)


def test_cells_stay_small(spark, corpus):
    from memlake.operators.score import _rows_by_cell, _sizes, cell_plan

    queries, memories = frames(spark, corpus)
    plan = cell_plan(_sizes(memories, "n_memories"), _sizes(queries, "n_queries"), 40, 7)
    rows = _rows_by_cell(queries, memories, plan, ("dense",))
    largest = rows.groupBy("cell", "side").count().groupBy("side").agg(F.max("count")).collect()
    # Hashing spreads a user's rows unevenly, but no cell comes near the whole user.
    assert all(n < (100 if side == 0 else 25) for side, n in largest)


def test_result_does_not_depend_on_partitions(spark, corpus):
    def hits(n, **kw):
        found = retrieve.hybrid_hits(*frames(spark, corpus, n), **kw)
        return sorted(tuple(r) for r in found.collect())

    assert hits(1) == hits(7) == hits(5, memory_block=16, query_block=4)
    assert hits(2)


def test_fusion_and_cut(spark):
    ranks = [(0, 0), (0, 1), (0, 4), (0, 5), (1, 2), (0, None)]
    rows = [
        (b, f"q{i}", "u", 0.65, "m", 1.0, r[j] + 1)
        for i, r in enumerate(ranks)
        for j, b in enumerate(("dense", "sparse"))
        if r[j] is not None
    ]
    lists = spark.createDataFrame(
        rows,
        "branch string, query_id string, user_id string, threshold double, memory_id string, "
        "score double, rank int",
    )
    fused = retrieve.rrf_fuse(lists)
    got = {r.query_id: round(r.score, 4) for r in fused.collect()}
    assert got == {"q0": 1.0, "q1": 0.8333, "q2": 0.6667, "q3": 0.6429, "q4": 0.5833, "q5": 0.5}
    assert {r.query_id for r in retrieve.score_cut(fused).collect()} == {"q0", "q1", "q2"}
    classic = retrieve.rrf_fuse(lists, rrf_k=60, rank_base=1)
    assert max(r.score for r in classic.collect()) == pytest.approx(2 / 61)


@pytest.fixture(scope="module")
def tables(spark):
    core = spark.createDataFrame(
        [("u1", "c1", "Lives in Paris", 0, 0), ("u1", "c2", "Name is Kim", 0, 1), ("u2", "c3", "x", 0, 0)],
        "user_id string, memory_id string, memory_text string, ord bigint, ord_pos bigint",
    )
    general = spark.createDataFrame(
        [("u1", "g1", "tea"), ("u3", "g2", "cats"), ("u1", "g3", None)],
        "user_id string, memory_id string, memory_text string",
    )
    return core, general


def test_core_comes_first(spark, tables):
    core, general = tables
    hits = spark.createDataFrame(
        [("q1", "u1", 0.6, "g1", 1.0, 1), ("q3", "u3", 0.6, "g2", 0.9, 1), ("q1", "u1", 0.6, "g3", 0.8, 2)],
        "query_id string, user_id string, threshold double, memory_id string, score double, rank int",
    )
    queries = spark.createDataFrame(
        [("q1", "u1"), ("q2", "u2"), ("q3", "u3"), ("q4", "u4")], "query_id string, user_id string"
    )
    out = retrieve.retrieve_with_core(queries, retrieve.with_texts(hits, general), core)
    rows = out.orderBy("query_id", "tier_ord", "ord", "ord_pos").collect()
    assert [(r.query_id, r.memory_id, r.type) for r in rows] == [
        ("q1", "c1", "core"), ("q1", "c2", "core"), ("q1", "g1", "general"),
        ("q2", "c3", "core"), ("q3", "g2", "general"),
    ]


def test_reads(spark, tables):
    core, general = tables
    asked = spark.createDataFrame([("u1",), ("u1",), ("u9",)], "user_id string")
    head = retrieve.get_core(core, asked).orderBy("ord", "ord_pos").collect()
    assert [r.memory_text for r in head] == ["Lives in Paris", "Name is Kim"]
    both = retrieve.get_all_memories(general, core, asked).collect()
    assert sorted(r.memory_id for r in both) == ["c1", "c2", "g1"]
    status = {r.user_id: (r.n_core, r.status) for r in retrieve.get_core_status(core, asked).collect()}
    assert status == {"u1": (2, "ok"), "u9": (0, "User has no core memories!")}
    many = spark.range(50).select(F.lit("u1").alias("user_id"),
                                  F.format_string("m%02d", "id").alias("memory_id"),
                                  F.lit("t").alias("memory_text"))
    first = retrieve.get_all_general(many, asked, limit=3).collect()
    assert sorted(r.memory_id for r in first) == ["m00", "m01", "m02"]
    ids = spark.createDataFrame([("u1", "g1"), ("u1", "zz")], "user_id string, memory_id string")
    found = {r.memory_id: r.found for r in retrieve.ids_exist(general, ids).collect()}
    assert found == {"g1": True, "zz": False}


def test_sizes_that_lack_a_user_lose_nothing(spark, corpus):
    queries, memories = (spark.createDataFrame(rows, schema) for rows, schema in zip(corpus, (QUERY, MEMORY)))
    want = sorted(map(tuple, retrieve.dense_topk(queries, memories, 3).collect()))
    some = queries.where("user_id <> 'a'").groupBy("user_id").agg(F.count("*").alias("n_queries"))
    got = retrieve.dense_topk(queries, memories, 3, query_sizes=some)
    assert sorted(map(tuple, got.collect())) == want
    few = memories.where("user_id <> 'b'").groupBy("user_id").agg(F.count("*").alias("n_memories"))
    got = retrieve.dense_topk(queries, memories, 3, memory_sizes=few)
    assert sorted(map(tuple, got.collect())) == want


def test_texts_are_shuffled_once_for_search_and_results(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows what it shares before it runs
    try:
        found = QUERIES["retrieve_with_core"](spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(re.findall(r"FileScan parquet \[doc_id#\d+L,text#\d+\]", plan)) == 1
