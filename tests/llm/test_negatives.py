"""Hard negatives: trees and searches against all scores, and whole tables against plain loops."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm import negatives
from memlake.llm.negatives import Anchors, grow, search


def points(seed, n, dims, kind):
    draw = np.random.default_rng(seed)
    if kind == "clusters":
        centres = draw.integers(-250, 250, (max(1, n // 40), dims))
        return (centres[draw.integers(0, len(centres), n)] + draw.integers(-6, 7, (n, dims))).astype(float)
    if kind == "equal":
        return np.full((n, dims), 3.0)
    return draw.integers(-3, 4, (n, dims)).astype(float)


def tree_of(seed, n, dims, kind):
    draw = np.random.default_rng(seed + 1)
    data = points(seed, n, dims, kind)
    most = float((data**2).sum(axis=1).max())
    ids = draw.integers(0, max(2, n // 2), n)
    return data, ids, draw.integers(0, 3, n), most, grow(data, np.arange(n), ids, draw.integers(0, 3, n) * 0, most)


@pytest.mark.parametrize("kind", ["clusters", "equal", "ties"])
@pytest.mark.parametrize("n", [1, 64, 65, 900])
def test_radii_cover_their_points(kind, n):
    data, _, _, most, tree = tree_of(n, n, 5, kind)
    assert sorted(tree.rows.tolist()) == list(range(n)) and np.array_equal(tree.points, data[tree.rows])
    lifted = np.column_stack([tree.points, np.sqrt(np.maximum(most - (tree.points**2).sum(axis=1), 0))])
    for centre, start, end, child, last, radius in tree.nodes:
        inside = lifted[int(start) : int(end)]
        assert start <= centre < end
        assert np.linalg.norm(inside - lifted[int(centre)], axis=1).max() <= radius + 1e-6
        if last > child:
            below = tree.nodes[int(child) : int(last)]
            assert below[0, 1] == start and below[-1, 2] == end and (below[1:, 1] == below[:-1, 2]).all()
            assert (below[:, 5] <= radius * 2 + 1e-6).all()
        else:
            assert end - start <= negatives.LEAF or radius == 0


@pytest.mark.parametrize("kind", ["clusters", "equal", "ties"])
@pytest.mark.parametrize("same", [True, False])
def test_search_equals_all_scores(kind, same):
    n, k = 700, 3
    data, ids, labels, most, _ = tree_of(11, n, 6, kind)
    tree = grow(data, np.arange(n), ids, labels, most)
    which = np.arange(0, n, 9)
    scores = data[which] @ data.T
    draw = np.random.default_rng(4)
    low = draw.choice(scores.ravel(), (len(which), 2))
    high = low + draw.integers(0, int(most) + 1, low.shape)
    low[::5, 1], high[::5, 1] = np.inf, -np.inf
    low[::3, 0], high[::3, 0] = -np.inf, np.inf
    best = search(tree, Anchors(data[which], which, labels[which], low, high), k, same, most)
    for i, own in enumerate(which):
        for slot in range(2):
            fits = [
                (-scores[i, j], ids[j], j)
                for j in range(n)
                if j != own and (labels[j] == labels[own]) == same and low[i, slot] <= scores[i, j] <= high[i, slot]
            ]
            got = [
                (-s, d, r)
                for s, d, r in zip(best.score[i, slot], best.id[i, slot], best.row[i, slot], strict=True)
                if r >= 0
            ]
            assert got == sorted(fits)[:k]


def test_far_nodes_are_skipped(monkeypatch):
    n = 2000
    data, ids, labels, most, _ = tree_of(3, n, 6, "clusters")
    tree = grow(data, np.arange(n), ids, labels, most)
    seen = []
    offer = negatives.Best.offer
    monkeypatch.setattr(negatives.Best, "offer", lambda self, a, s, i, r: (seen.append(len(a)), offer(self, a, s, i, r)))
    window = np.array([[most * 0.9]]), np.array([[most]])
    search(tree, Anchors(data[:1], np.arange(1), labels[:1], *window), 3, False, most)
    assert sum(seen) < n // 4


SCHEMA = "vec_id long, embedding array<double>, label int, row string, SCORE int, rank string"


def plain(rows):
    used = []
    for place, (vec_id, vector, label) in enumerate(rows):
        if vec_id is None or vector is None or label is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        used.append((place, vec_id, [math.floor(256 * x) for x in vector], label))

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = []
    for place, vec_id, vector, label in used:
        if vec_id % 5:
            continue
        others = [(-dot(vector, v), i, p, lab == label) for p, i, v, lab in used if p != place]
        for score, positive, _, _ in sorted(o for o in others if o[3])[:5]:
            score = -score
            fits = sorted(o for o in others if not o[3] and 50 * score <= -100 * o[0] <= 95 * score)[:3]
            out += [(vec_id, positive, r, o[1], score, -o[0]) for r, o in enumerate(fits, 1)]
    return sorted(out)


def mined(df):
    got = negatives.mine(df, F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(row) for row in got.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", 1, "y") for row in rows], SCHEMA)


def test_mine_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TREE_ROWS", 70)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 7)
    draw = random.Random(2)
    rows = []
    for i in range(300):
        vector = [draw.choice([-1.0, 0.0, 0.5, 0.25, 1.003, -0.001]) for _ in range(draw.choice([4, 4, 4, 3]))]
        rows.append((i, vector, draw.choice([0, 0, 0, 1, 2])))
    rows += [rows[10]] * 20 + [rows[11]] * 20  # repeated rows, anchors among them
    rows += [(None, [1.0] * 4, 1), (1000, None, 1), (1005, [1.0] * 4, None), (1010, [], 0), (1015, [1.0, None], 0)]
    rows += [(1020, [math.nan, 1.0], 0), (1025, [math.inf], 1), (-5, [0.3] * 4, 1)]
    want = plain(rows)
    assert len(want) > 200
    assert mined(frame(spark, rows)) == want


def test_blocks_and_trees_do_not_pass_the_driver(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TREE_ROWS", 64)
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = negatives.mine(df, F.col("vec_id") % 5 == 0)
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()  # as it ran
    joins = [line for line in plan.splitlines() if re.search(r"Join \[shard", line)]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_too_large_vectors_take_no_part(spark):
    rows = [(5, [1.0], 0), (6, [1.0], 0), (7, [0.7], 1), (8, [1e300], 1), (9, [-6e5], 1)]
    assert mined(frame(spark, rows)) == [(5, 6, 1, 7, 65536, 179 * 256)]


def test_tables_without_rows_anchors_or_labels(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(1, [1.0], 0), (2, [1.0], 1)])) == []
    assert mined(frame(spark, [(5, [1.0], 0), (10, [1.0], None)])) == []
