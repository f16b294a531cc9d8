"""Sparse vectors of texts as one expression: no explode, no grouping, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.binding import let
from memlake.schema import QUERY_MARKER, SPARSE

#: Letters and digits of any script make a term.
TERM_BREAK = r"[^\p{L}\p{N}]+"


def term_index(term: Column) -> Column:
    """Index of a term: the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint")


def sparse_vector(text: Column | str) -> Column:
    """Term indices, ascending, and their weights ``1 + ln(tf)``.

    Terms are counted by sorting their indices and measuring the runs, which
    is linear after the sort.  Terms that share an index are counted together.
    A query marker at the start is not part of the text; null makes an empty
    vector.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    body = F.when(
        F.startswith(text, F.lit(QUERY_MARKER)),
        F.substr(text, F.lit(len(QUERY_MARKER) + 1)),
    ).otherwise(text)
    terms = F.filter(F.split(F.lower(body), TERM_BREAK), lambda t: t != "")

    def starts_of_runs(sorted_: Column) -> Column:
        places = F.when(
            F.size(sorted_) > 0, F.sequence(F.lit(0), F.size(sorted_) - 1)
        ).otherwise(F.array().cast("array<int>"))
        return F.filter(
            places, lambda i: (i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1))
        )

    def measure(sorted_: Column) -> Column:
        return let(
            starts_of_runs(sorted_),
            lambda starts: F.struct(
                F.transform(starts, lambda s: F.get(sorted_, s)).alias("indices"),
                F.transform(
                    starts,
                    lambda s, n: (
                        1 + F.log(F.coalesce(F.get(starts, n + 1), F.size(sorted_)) - s)
                    ).cast("float"),
                ).alias("values"),
            ),
        )

    return let(F.sort_array(F.transform(terms, term_index)), measure).cast(SPARSE)
