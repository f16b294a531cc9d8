"""Turning texts into dense and sparse vectors."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.binding import let
from memlake.functions.vectors import TERM_BREAK, sparse_vector
from memlake.schema import QUERY_MARKER, SPARSE
from memlake.sources.workdir import work_dir

#: A plug-in maps a batch of texts to one dense vector and one (indices,
#: values) pair per text, in the same order.
Encoder = Callable[[list[str]], tuple[np.ndarray, list[tuple[list[int], list[float]]]]]


def mark_query(text: Column) -> Column:
    """Texts to search for carry a marker; stored texts do not."""
    return F.concat(F.lit(QUERY_MARKER), text)


def sparse_encode(texts: DataFrame, text_col: str) -> DataFrame:
    """Built-in sparse encoder: adds ``sparse``.  Row-local, so nothing is shuffled."""
    return texts.withColumn("sparse", sparse_vector(text_col))


def sparse_postings(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The sparse encoding as rows ``(id, idx, w)``, one per distinct term of a text."""
    terms = let(sparse_vector(text_col), lambda v: F.arrays_zip(v["indices"], v["values"]))
    return texts.select(F.col(id_col).alias("id"), F.explode(terms).alias("p")).select(
        "id", F.col("p.indices").alias("idx"), F.col("p.values").alias("w")
    )


def inverse_document_frequency(postings: DataFrame, n_texts: DataFrame) -> DataFrame:
    """``(idx, idf)`` with ``idf = ln(1 + N / df)``; ``n_texts`` is a frame of one number."""
    return postings.groupBy("idx").agg(F.count(F.lit(1)).alias("df")).select(
        "idx", F.log1p(n_texts.scalar() / F.col("df")).alias("idf")
    )


def gather_vectors(
    postings: DataFrame, idf: DataFrame | None = None, normalise: bool = False
) -> DataFrame:
    """Postings to one ``(id, sparse)`` row per text, indices ascending.

    ``idf`` weighs the terms; how it is joined is left to the size statistics,
    as a vocabulary grows with the data.  ``normalise`` scales to unit length.
    """
    if idf is not None:
        postings = postings.join(idf, "idx").select(
            "id", "idx", (F.col("w") * F.col("idf")).cast("float").alias("w")
        )
    # The length is an aggregate of its own: inside the lambda below it would
    # be worked out again for every element.
    vectors = postings.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("p"),
        F.sqrt(F.sum(F.col("w").cast("double") * F.col("w"))).alias("length"),
    )
    scale = F.col("length") if normalise else F.lit(1.0)
    return vectors.select(
        "id",
        F.struct(
            F.transform("p", lambda x: x["idx"]).alias("indices"),
            F.transform("p", lambda x: (x["w"] / scale).cast("float")).alias("values"),
        )
        .cast(SPARSE)
        .alias("sparse"),
    )


#: Terms whose weights are broadcast, at most: those that most texts have.
FREQUENT = 1 << 18


def weighted_vectors(
    texts: DataFrame, id_col: str, text_col: str, normalise: bool = False, frequent: int = FREQUENT
) -> DataFrame:
    """Sparse vectors ``(id, sparse)`` of texts, terms weighed by ``ln(1 + N / df)``.

    What :func:`gather_vectors` makes of :func:`sparse_postings` and
    :func:`inverse_document_frequency`.  Vectors are made once and stored.
    Terms in so many texts that there can be ``frequent`` of them at most get
    their weights by broadcast, where their text is; only postings of the
    others meet by term, and none of those has many.
    """
    spark, root = texts.sparkSession, work_dir(texts.sparkSession, "vectors")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    vectors = kept(texts.select(F.col(id_col).alias("id"), sparse_vector(text_col).alias("sparse")), "sparse")
    counts = kept(
        vectors.select(F.explode("sparse.indices").alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("df")), "df"
    )
    # Of all postings 1 / frequent at least belong to each of them.
    least = -(-(counts.agg(F.sum("df")).first()[0] or 0) // frequent)
    weights = counts.select("idx", "df", F.log1p(F.lit(vectors.count()) / F.col("df")).alias("idf"))
    common = F.broadcast(weights.where(F.col("df") >= least).drop("df"))
    postings = vectors.select(
        "id", F.explode(F.arrays_zip(F.col("sparse.indices").alias("idx"), F.col("sparse.values").alias("w"))).alias("p")
    ).select("id", "p.idx", "p.w")

    def weighed(rows: DataFrame, idf: DataFrame) -> DataFrame:
        return rows.join(idf, "idx").select("id", "idx", (F.col("w") * F.col("idf")).cast("float").alias("w"))

    rest = postings.join(common.select("idx"), "idx", "left_anti")
    both = weighed(postings, common).unionByName(weighed(rest, weights.where(F.col("df") < least).drop("df")))
    return gather_vectors(both, normalise=normalise)


def encode(
    texts: DataFrame, text_col: str, encoder: Encoder, sparse: bool = True, batch: int = 1024
) -> DataFrame:
    """Run a batch encoder plug-in over all texts; adds ``dense`` and ``sparse``.

    Rows keep their other columns.  No rows in, no rows out.  A batch for
    which the plug-in returns too few vectors fails instead of misaligning.
    """
    names = texts.columns
    sparse_field = f", sparse {SPARSE}" if sparse else ""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                out = frame.iloc[start : start + batch].copy()
                dense, pairs = encoder([t or "" for t in out[text_col]])
                if len(dense) != len(out) or (sparse and len(pairs) != len(out)):
                    raise ValueError("encoder returned another number of vectors than texts")
                out["dense"] = [np.asarray(v, dtype=np.float32) for v in dense]
                if sparse:
                    out["sparse"] = [{"indices": i, "values": v} for i, v in pairs]
                yield out[[*names, "dense", *(["sparse"] if sparse else [])]]

    return texts.mapInPandas(run, f"{fields}, dense array<float>{sparse_field}")


#: A text that any working plug-in can encode: who fails on it too is down.
PROBE = "a"


def encode_isolated(
    texts: DataFrame,
    text_col: str,
    encoder: Encoder,
    dim: int | None = None,
    batch: int = 1024,
    probe: str = PROBE,
) -> DataFrame:
    """Like :func:`encode`, but a text that the plug-in fails on fails alone: adds ``dense``, ``sparse`` and ``problem``.

    A batch that raises is halved until each failing text stands by itself; its vectors are null and ``problem``
    says why, as it does for vectors that are not finite or have another dimension than ``dim``.  The others' vectors stay.
    When a text has failed, the plug-in must still encode ``probe``: if it can't, it is down, which is no text's
    fault, and its error is raised.
    """
    names = texts.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)

    def encoded(part: list[str]):
        dense, pairs = encoder(part)
        if len(dense) != len(part) or len(pairs) != len(part):
            raise ValueError("encoder returned another number of vectors than texts")
        return dense, pairs

    def checked(vector, pair):
        vector = np.asarray(vector, dtype=np.float32)
        if dim is not None and len(vector) != dim:
            return None, None, "wrong dimension"
        if not (np.isfinite(vector).all() and np.isfinite(np.asarray(pair[1], dtype=np.float32)).all()):
            return None, None, "not finite"
        return vector, {"indices": pair[0], "values": pair[1]}, None

    def by_halves(part: list[str]) -> list[tuple]:
        try:
            return [checked(vector, pair) for vector, pair in zip(*encoded(part))]
        except Exception as error:
            if len(part) > 1:
                middle = len(part) // 2
                return by_halves(part[:middle]) + by_halves(part[middle:])
            encoded([probe])
            return [(None, None, f"{type(error).__name__}: {error}")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                out = frame.iloc[start : start + batch].copy()
                made = by_halves([t or "" for t in out[text_col]])
                out["dense"], out["sparse"], out["problem"] = (
                    pd.Series(list(column), index=out.index, dtype=object) for column in zip(*made)
                )
                yield out[[*names, "dense", "sparse", "problem"]]

    return texts.mapInPandas(run, f"{fields}, dense array<float>, sparse {SPARSE}, problem string")


def hashed_encoder(dim: int = 64) -> Encoder:
    """A model-free plug-in: hashed bag of words, dense buckets and sparse terms.

    Gives the same sparse vectors as :func:`sparse_encode`; the dense vector
    holds the sparse weights summed into ``idx mod dim``.
    """

    def run(texts: list[str]):
        import regex

        split = regex.compile(TERM_BREAK).split
        dense = np.zeros((len(texts), dim))
        pairs = []
        for row, text in enumerate(texts):
            terms = split(text.removeprefix(QUERY_MARKER).lower())
            tf = Counter(
                int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in terms if t
            )
            indices = sorted(tf)
            values = [float(np.float32(1 + np.log(tf[i]))) for i in indices]
            for i, v in zip(indices, values):
                dense[row, i % dim] += v
            pairs.append((indices, values))
        return dense, pairs

    return run


def attach_vectors(
    texts: DataFrame, vectors: DataFrame, on: str, how: str = "left"
) -> DataFrame:
    """Join vectors made elsewhere to their texts, by id and never by position."""
    return texts.join(vectors, on, how)


def encode_check(
    texts: DataFrame, vectors: DataFrame, on: str, dim: int, dense: str = "dense"
) -> DataFrame:
    """Texts without a vector, or with one of another dimension: ``(id, problem)``."""
    sized = vectors.select(on, F.coalesce(F.size(dense), F.lit(0)).alias("n"))
    return (
        texts.select(on)
        .join(sized, on, "left")
        .withColumn(
            "problem",
            F.when(F.col("n").isNull(), "missing").when(F.col("n") != dim, "wrong dimension"),
        )
        .where(F.col("problem").isNotNull())
        .select(on, "problem")
    )
