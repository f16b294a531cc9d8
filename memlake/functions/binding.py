"""Small helpers for building column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(column: str, width: int) -> Column:
    """Integer quotient; exact for all bigints, as a division through doubles is not."""
    return F.expr(f"`{column}` div {int(width)}")
