"""Hard negatives by inner product: cover trees over norm-augmented vectors, searched best first.

A vector x becomes (x, sqrt(M^2 - |x|^2)), M the greatest norm, and an anchor a becomes (a, 0): then the squared distance is
|a|^2 + M^2 - 2 a.x, so a node's covering radius bounds all inner products below it from both sides.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.batches import map_batches, stored

#: Components are counted in steps of 1 / STEP.
STEP = 256
#: Bytes and rows of the vectors under one tree, vectors in one block of anchors. They change the work, never the result.
TREE_BYTES, TREE_ROWS, BLOCK_ROWS = 2 << 20, 4096, 512
#: Points in a leaf, and centres below a node.
LEAF, FAN = 64, 16
#: Squared norms stay below this, so sums of products are exact as doubles.
EXACT = 1 << 53


# --- the tree --------------------------------------------------------------


class Tree(NamedTuple):
    """`points` by node, so that a node is a stretch; `nodes`: centre, start, end, first child, end of children, radius."""

    points: np.ndarray
    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    nodes: np.ndarray


def _distances(points: np.ndarray, lift: np.ndarray, centre: int) -> np.ndarray:
    gap = points - points[centre]
    return np.sqrt(np.einsum("ij,ij->i", gap, gap) + (lift - lift[centre]) ** 2)


def grow(points: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, most: float) -> Tree:
    """The cover tree over `points`, whose squared norms are at most `most`.

    A node's children are a greedy net of at most FAN of its points, the node's own centre first, each next one the farthest
    from those before; so each level's centres lie at least its covering radius apart. Points go to the nearest centre, and a
    radius is the farthest distance of a node's points from its centre. Nodes of up to LEAF points, or of equal ones, are leaves.
    """
    lift = np.sqrt(np.maximum(most - np.einsum("ij,ij->i", points, points), 0.0))
    order = np.arange(len(points))
    nodes = [[0, 0, len(points), 0, 0, float(_distances(points, lift, 0).max())]]
    at = 0
    while at < len(nodes):
        centre, start, end, _, _, radius = nodes[at]
        if end - start > LEAF and radius > 0:
            held = order[start:end].copy()
            own, raised = points[held], lift[held]
            centres = [int(np.flatnonzero(held == centre)[0])]
            nearest = _distances(own, raised, centres[0])
            owner = np.zeros(len(held), int)
            while len(centres) < FAN and nearest.max() > 0:
                centres.append(int(nearest.argmax()))
                away = _distances(own, raised, centres[-1])
                closer = away < nearest
                nearest[closer], owner[closer] = away[closer], len(centres) - 1
            by = np.argsort(owner, kind="stable")
            order[start:end] = held[by]
            bounds = np.searchsorted(owner[by], np.arange(len(centres) + 1)) + start
            nodes[at][3:5] = len(nodes), len(nodes) + len(centres)
            reach = nearest[by]
            for i, where in enumerate(centres):
                s, e = int(bounds[i]), int(bounds[i + 1])
                nodes.append([int(held[where]), s, e, 0, 0, float(reach[s - start : e - start].max())])
        at += 1
    table = np.array(nodes, float)
    place = np.empty(len(points), int)
    place[order] = np.arange(len(points))
    table[:, 0] = place[table[:, 0].astype(int)]
    return Tree(points[order], rows[order], ids[order], labels[order], table)


# --- the search ------------------------------------------------------------


class Anchors(NamedTuple):
    """Vectors with row, label and, for each slot, the scores that are wanted: low[i, slot] to high[i, slot], both included."""

    vectors: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Best:
    """The first `k` of what each (anchor, slot) was offered: higher score, then smaller id, then smaller row."""

    def __init__(self, anchors: Anchors, k: int):
        shape = (*anchors.low.shape, k)
        self.anchors, self.k = anchors, k
        self.score = np.full(shape, -np.inf)
        self.id, self.row = np.zeros(shape, np.int64), np.full(shape, -1, np.int64)
        self.most = anchors.high.max(axis=1)
        self.least = np.empty(len(anchors.rows))
        self.refresh(np.arange(len(anchors.rows)))

    def refresh(self, which: np.ndarray) -> None:
        """What a score must reach to enter any slot of the anchors."""
        self.least[which] = np.maximum(self.anchors.low[which], self.score[which, :, -1]).min(axis=1)

    def offer(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        low, high = self.anchors.low[anchor], self.anchors.high[anchor]
        # A slot that is full takes equal scores too, for ids decide.
        floor = np.maximum(low, self.score[anchor, :, -1])
        hit, slot = np.nonzero((score[:, None] >= floor) & (score[:, None] <= high))
        if not len(hit):
            return
        slots = self.score.shape[1]
        key = anchor[hit] * slots + slot
        changed = np.unique(key)
        a, s = changed // slots, changed % slots
        keys = np.concatenate([np.repeat(changed, self.k), key])
        scores = np.concatenate([self.score[a, s].ravel(), score[hit]])
        every_id = np.concatenate([self.id[a, s].ravel(), ids[hit]])
        every_row = np.concatenate([self.row[a, s].ravel(), rows[hit]])
        order = np.lexsort((every_row, every_id, -scores, keys))
        keys = keys[order]
        first = np.searchsorted(keys, changed)
        taken = order[first[:, None] + np.arange(self.k)]
        self.score[a, s], self.id[a, s], self.row[a, s] = scores[taken], every_id[taken], every_row[taken]
        self.refresh(np.unique(a))


def search(tree: Tree, anchors: Anchors, k: int, same: bool, most: float) -> Best:
    """The first `k` for each slot among the tree's points of the anchor's label (`same`) or of other labels, but for itself.

    Best first: of all open nodes the one with the highest bound of any anchor comes next, for those anchors alone that it
    may still serve. A node is left out for an anchor if its bounds lie wholly outside the anchor's windows, or below what the
    anchor's slots hold; points of leaves are scored exactly.
    """
    best = Best(anchors, k)
    vectors = anchors.vectors
    base = np.einsum("ij,ij->i", vectors, vectors) + most
    slack = 1e-9 * (base + 1.0)
    centre, start, end, child, last = tree.nodes[:, :5].astype(int).T
    radius = tree.nodes[:, 5]
    heap: list = []

    def push(nodes: np.ndarray, which: np.ndarray) -> None:
        away = np.sqrt(np.maximum(base[which, None] - 2 * (vectors[which] @ tree.points[centre[nodes]].T), 0.0))
        upper = (base[which, None] - np.maximum(away - radius[nodes], 0.0) ** 2) / 2 + slack[which, None]
        lower = (base[which, None] - (away + radius[nodes]) ** 2) / 2 - slack[which, None]
        open_ = (upper >= best.least[which, None]) & (lower <= best.most[which, None])
        for i, node in enumerate(nodes):
            some = open_[:, i]
            if some.any():
                heapq.heappush(heap, (-float(upper[some, i].max()), int(node), which[some], upper[some, i]))

    push(np.array([0]), np.arange(len(vectors)))
    while heap:
        _, node, which, upper = heapq.heappop(heap)
        which = which[upper >= best.least[which]]
        if not len(which):
            continue
        if last[node] > child[node]:
            push(np.arange(child[node], last[node]), which)
            continue
        held = slice(start[node], end[node])
        scores = vectors[which] @ tree.points[held].T
        fits = (scores >= best.least[which, None]) & (scores <= best.most[which, None])
        fits &= (anchors.labels[which, None] == tree.labels[held]) == same
        fits &= anchors.rows[which, None] != tree.rows[held]
        a, p = np.nonzero(fits)
        if len(a):
            best.offer(which[a], scores[a, p], tree.ids[held][p], tree.rows[held][p])
    return best


# --- tables ----------------------------------------------------------------


def counted(vector: Column) -> Column:
    """floor(STEP * x) of each component x; null where a component is null or not finite, or a sum could be inexact."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(1 << 26))))
    steps = F.transform(wide, lambda x: F.floor(x * STEP).cast("double"))
    return F.when(fine & (_square(steps) < EXACT), steps)


def _square(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x * x)


def _matrix(vectors: Sequence[Sequence[float]], dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones with zeros at the end."""
    made = np.zeros((len(vectors), dims))
    for i, vector in enumerate(vectors):
        made[i, : len(vector)] = vector
    return made


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _floats(data: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(shape)


def _trees(points: DataFrame, trees: int, dims: int, most: float) -> DataFrame:
    """One row for each tree: shard, its points and nodes as bytes. Rows go round the trees, so none grows with a label or id."""

    def make(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        columns = (group[name].to_numpy(np.int64) for name in ("row", "id", "label"))
        tree = grow(_matrix(list(group["vector"]), dims), *columns, most)
        return pd.DataFrame([[group["shard"].iloc[0], *(part.tobytes() for part in tree)]])

    fields = "shard long, points binary, rows binary, ids binary, labels binary, nodes binary"
    sharded = points.select((F.col("row") % trees).alias("shard"), "row", "id", "label", "vector")
    return sharded.groupBy("shard").applyInPandas(make, fields)


def _blocks(anchors: DataFrame, blocks: int, slots: int, dims: int) -> DataFrame:
    """Anchors (row, label, vector, windows) by blocks, as bytes: vectors, rows, labels, low, high."""

    def make(group: pd.DataFrame) -> pd.DataFrame:
        low, high = np.full((len(group), slots), np.inf), np.full((len(group), slots), -np.inf)
        for i, windows in enumerate(group["windows"]):
            for window in windows:
                low[i, window["slot"]], high[i, window["slot"]] = window["low"], window["high"]
        vectors = _matrix(list(group["vector"]), dims)
        rows, labels = (group[name].to_numpy(np.int64) for name in ("row", "label"))
        return pd.DataFrame([[part.tobytes() for part in (vectors, rows, labels, low, high)]])

    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    fields = "vectors binary, rows binary, labels binary, low binary, high binary"
    return dealt.groupBy("block").applyInPandas(make, fields)


def _first(
    trees: DataFrame, shards: int, anchors: DataFrame, blocks: int, slots: int, k: int, same: bool, dims: int, most: float
) -> DataFrame:
    """(anchor, slot, rank, row, id, score): the first `k` for each anchor and slot over all trees.

    Every block of anchors meets every tree, and at most `k` rows for each slot come out of a meeting. Both go by shuffles:
    packed vectors, and one block for each tree, are far more than Spark estimates, so neither side is ever broadcast.
    """
    names = ("vectors", "rows", "labels", "low", "high")
    dealt = _blocks(anchors, blocks, slots, dims).select(
        *(F.col(name).alias(f"a_{name}") for name in names),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
    )
    met = dealt.join(trees.hint("merge"), "shard")

    def start():
        def work(*columns):
            out = []
            for vectors, own, own_labels, low, high, points, rows, ids, labels, nodes in zip(*columns, strict=True):
                n, m = len(own) // 8, len(rows) // 8
                some = Anchors(
                    _floats(vectors, n, dims), _ints(own), _ints(own_labels), _floats(low, n, slots), _floats(high, n, slots)
                )
                tree = Tree(_floats(points, m, dims), _ints(rows), _ints(ids), _ints(labels), _floats(nodes, -1, 6))
                best = search(tree, some, k, same, most)
                out.append(
                    [
                        {
                            "anchor": some.rows[a],
                            "slot": s,
                            "row": best.row[a, s, i],
                            "id": best.id[a, s, i],
                            "score": int(best.score[a, s, i]),
                        }
                        for a, s, i in np.argwhere(best.row >= 0)
                    ]
                )
            return [out]

        return work

    needs = [*(f"a_{name}" for name in names), "points", "rows", "ids", "labels", "nodes"]
    field = "array<struct<anchor:long,slot:int,row:long,id:long,score:long>>"
    hits = map_batches(met, [], needs, f"hits {field}", start).select(F.inline("hits"))
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    df: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of the vectors in whole steps of 1 / STEP; higher ones come first, ties by smaller id. Each row
    for which `anchor` holds has its first `positives` other rows of its label, and for each of these the first `negatives`
    rows of other labels with low * positive <= 100 * negative <= high * positive, of scores.

    Rows with a null label, vector or id, or a component that is null, not finite or above 2^26, or a squared norm of 2^53 steps or
    more, take no part. Shorter vectors count as if they had zeros at the end. Repeated rows are rows of their own: each is an
    anchor, and the others' positive. A positive without a negative gives no row; an empty table an empty result. Other columns do not enter.
    """
    label = F.col(label) if isinstance(label, str) else label
    read = df.select(
        F.col(vec_id).cast("long").alias("id"),
        label.cast("long").alias("label"),
        counted(F.col(vector)).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).dropna(subset=["id", "label", "vector"])
    points = stored(read.withColumn("row", F.monotonically_increasing_id()), "points")
    n, n_anchors, dims, most = points.agg(
        F.count("*"), F.count_if("anchor"), F.max(F.size("vector")), F.max(_square(F.col("vector")))
    ).first()
    dims, most = max(dims or 0, 1), float(most or 0)
    shards = max(1, math.ceil(n / max(LEAF, min(TREE_ROWS, TREE_BYTES // (8 * dims)))))
    blocks = max(1, math.ceil(n_anchors / BLOCK_ROWS))
    trees = stored(_trees(points, shards, dims, most), "trees")

    whole = F.struct(F.lit(0).alias("slot"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    anchors = points.filter("anchor").select("row", F.col("id").alias("anchor_id"), "label", "vector")
    found = _first(trees, shards, anchors.withColumn("windows", F.array(whole)), blocks, 1, positives, True, dims, most)
    found = stored(
        found.select(
            "anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "positives",
    )
    window = F.struct(
        "slot",
        F.expr(f"(positive_score * {low} + 99) div 100").cast("double").alias("low"),
        F.expr(f"(positive_score * {high}) div 100").cast("double").alias("high"),
    )
    # Below zero no score is in the window, for low <= high.
    windows = found.filter("positive_score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.collect_list(window).alias("windows"))
    asking = anchors.join(windows, "row")
    hits = _first(trees, shards, asking, blocks, positives, negatives, False, dims, most)
    hits = hits.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row").alias("anchor"), "anchor_id")
    return (
        hits.join(found, ["anchor", "slot"])
        .join(named, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
