"""Exact scoring of queries against their own user's memories, in bounded cells.

A user's memories are hashed into blocks, and so are their queries; a *cell*
is one memory block met by one query block.  Spark partitions the rows by
cell and sorts them, a task streams over its partition, holds one cell at a
time and emits only the best ``k`` of each list.  Top-k lists merge, so the
result is exact, while neither a user with a third of all rows nor a term
found everywhere ever gathers in one task, and no pair is written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORY_BLOCK = 4096
QUERY_BLOCK = 1024

_CANDIDATES = (
    "branch string, query_id string, user_id string, threshold double, "
    "memory_id string, score double"
)


def _sizes(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias(name))


def cell_plan(
    memory_sizes: DataFrame,
    query_sizes: DataFrame,
    memory_block: int,
    query_block: int,
    how: str = "inner",
) -> DataFrame:
    """Blocks per user on both sides: at least one, so that a size that is missing loses nobody."""

    def blocks(n: str, block: int):
        return F.greatest(F.lit(1), F.coalesce(F.ceil(F.col(n) / block), F.lit(1))).cast("int")

    return memory_sizes.join(query_sizes, "user_id", how).select(
        "user_id",
        blocks("n_memories", memory_block).alias("m_blocks"),
        blocks("n_queries", query_block).alias("q_blocks"),
    )


def _rows_by_cell(
    queries: DataFrame, memories: DataFrame, plan: DataFrame, branches: tuple[str, ...]
) -> DataFrame:
    """Both sides as rows of one shape, copied to every cell they take part in.

    A row is hashed to a block of its own side and copied to all blocks of the
    other; for all but huge users there is one block and no copy.
    """

    def block(key: str, n: str):
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    vectors = {"dense": ["dense"], "sparse": ["indices", "values"]}
    shape = ["cell", "side", "row_id", "user_id", "threshold"]
    shape += [c for b in branches for c in vectors[b]]
    stored = (
        memories.join(plan, "user_id")
        .withColumn("mb", block("memory_id", "m_blocks"))
        .withColumn("qb", every("q_blocks"))
        .withColumn("side", F.lit(0))
        .withColumn("row_id", F.col("memory_id"))
        .withColumn("threshold", F.lit(None).cast("double"))
    )
    asked = (
        queries.join(plan, "user_id")
        .withColumn("qb", block("query_id", "q_blocks"))
        .withColumn("mb", every("m_blocks"))
        .withColumn("side", F.lit(1))
        .withColumn("row_id", F.col("query_id"))
    )

    def shaped(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("cell", F.concat_ws(":", "user_id", "mb", "qb"))
        if "sparse" in branches:
            rows = rows.select("*", "sparse.indices", "sparse.values")
        return rows.select(shape)

    return shaped(stored).unionByName(shaped(asked))


def _ragged(column: pa.ListArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and per-row lengths of a list column; null lists are empty."""
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=dtype), lengths.astype(np.int64)


def _unit_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers that hold a dense vector, and those vectors scaled to length one."""
    flat, lengths = _ragged(table["dense"].combine_chunks(), np.float64)
    rows = np.flatnonzero(lengths)
    if not len(rows):
        return rows, np.zeros((0, 0))
    dims = np.unique(lengths[rows])
    if len(dims) > 1:
        raise ValueError(f"dense vectors of different dimensions: {dims.tolist()}")
    vectors = flat.reshape(len(rows), -1)
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return rows, np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _best(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores; equal scores go by name."""
    rounded = np.round(scores, 9)
    pool = np.arange(len(scores))
    if len(scores) > k:
        bar = np.partition(rounded, len(rounded) - k)[len(rounded) - k]
        pool = np.flatnonzero(rounded >= bar)
    return pool[np.lexsort((names[pool], -rounded[pool]))[:k]]


def _dense_hits(asked: pa.Table, stored: pa.Table, order: np.ndarray, k: int):
    q_rows, q = _unit_rows(asked)
    m_rows, m = _unit_rows(stored)
    if not len(q_rows) or not len(m_rows):
        return
    for row, scores in zip(q_rows, q @ m.T):
        best = _best(scores, order[m_rows], k)
        yield row, m_rows[best], scores[best]


def _sparse_hits(asked: pa.Table, stored: pa.Table, order: np.ndarray, k: int):
    """Dot products through an inverted index of the block, one query at a time."""
    m_idx, m_len = _ragged(stored["indices"].combine_chunks(), np.int64)
    m_val, _ = _ragged(stored["values"].combine_chunks(), np.float64)
    q_idx, q_len = _ragged(asked["indices"].combine_chunks(), np.int64)
    q_val, _ = _ragged(asked["values"].combine_chunks(), np.float64)
    by_term = np.argsort(m_idx, kind="stable")
    terms, weights = m_idx[by_term], m_val[by_term]
    owners = np.repeat(np.arange(len(m_len)), m_len)[by_term]
    ends = np.cumsum(q_len)
    for row, (lo, hi) in enumerate(zip(ends - q_len, ends)):
        first = np.searchsorted(terms, q_idx[lo:hi], "left")
        count = np.searchsorted(terms, q_idx[lo:hi], "right") - first
        total = int(count.sum())
        if not total:
            continue
        # Positions of all postings of all query terms, one run per term.
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(total)
        hit = owners[at]
        products = np.repeat(q_val[lo:hi], count) * weights[at]
        scores = np.bincount(hit, products, minlength=len(m_len))
        found = np.flatnonzero(np.bincount(hit, minlength=len(m_len)))
        best = found[_best(scores[found], order[found], k)]
        yield row, best, scores[best]


def _score_cell(rows: pa.Table, branches: tuple[str, ...], k: int) -> pa.RecordBatch | None:
    side = rows["side"].to_numpy()
    split = int(np.searchsorted(side, 1))
    stored, asked = rows.slice(0, split), rows.slice(split)
    if not len(stored) or not len(asked):
        return None
    ids = np.asarray(stored["row_id"].to_pylist(), dtype=object)
    order = np.empty(len(ids), dtype=np.int64)
    order[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    search = {"dense": _dense_hits, "sparse": _sparse_hits}
    names, q_at, m_at, scored = [], [], [], []
    for branch in branches:
        for row, hits, scores in search[branch](asked, stored, order, k):
            names += [branch] * len(hits)
            q_at.append(np.full(len(hits), row))
            m_at.append(hits)
            scored.append(scores)
    if not names:
        return None
    by_query = pa.array(np.concatenate(q_at))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names),
            asked["row_id"].combine_chunks().take(by_query),
            asked["user_id"].combine_chunks().take(by_query),
            asked["threshold"].combine_chunks().take(by_query),
            pa.array(ids[np.concatenate(m_at)], pa.string()),
            pa.array(np.concatenate(scored), pa.float64()),
        ],
        ["branch", "query_id", "user_id", "threshold", "memory_id", "score"],
    )


def score_cells(
    queries: DataFrame,
    memories: DataFrame,
    k: int,
    branches: tuple[str, ...] = ("dense", "sparse"),
    memory_sizes: DataFrame | None = None,
    query_sizes: DataFrame | None = None,
    memory_block: int = MEMORY_BLOCK,
    query_block: int = QUERY_BLOCK,
    sizes_complete: bool = False,
) -> DataFrame:
    """Per-cell top-k candidates of the asked branches.

    ``queries`` has (query_id, user_id, threshold, dense, sparse), ``memories``
    (user_id, memory_id, dense, sparse); a null vector leaves its row out of
    that branch.  The size frames (user_id, n_memories / n_queries) may be
    given where counting the inputs themselves would repeat costly work.  Users that a given frame lacks
    have one block.  With ``sizes_complete`` the caller says that none is lacking, and users
    without queries are left out early.
    """
    given = memory_sizes is not None or query_sizes is not None
    plan = cell_plan(
        memory_sizes if memory_sizes is not None else _sizes(memories, "n_memories"),
        query_sizes if query_sizes is not None else _sizes(queries, "n_queries"),
        memory_block,
        query_block,
        "full" if given and not sizes_complete else "inner",
    )
    rows = _rows_by_cell(queries, memories, plan, branches)
    rows = rows.repartition("cell").sortWithinPartitions("cell", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            cells = table["cell"].combine_chunks().dictionary_encode()
            codes = cells.indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for lo, hi in zip(edges, edges[1:]):
                cell = cells.dictionary[codes[lo]].as_py()
                if cell != current:
                    if held and (out := _score_cell(pa.concat_tables(held), branches, k)):
                        yield out
                    held, current = [], cell
                held.append(table.slice(lo, hi - lo))
        if held and (out := _score_cell(pa.concat_tables(held), branches, k)):
            yield out

    return rows.mapInArrow(run, _CANDIDATES)
