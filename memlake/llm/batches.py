"""Helpers shared by the corpus operators: Arrow batches, texts, hashes, shared folders."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from memlake.sources.workdir import work_dir

#: Rows and bytes of one Arrow batch, unless the session says otherwise. Texts can be long: a worker holds one batch.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Has Spark remove shuffle files when a query ends. Else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes where the session still has Spark's own bounds."""
    for key, ours, default in ((_ROWS, BATCH_ROWS, 10_000), (_BYTES, BATCH_BYTES, None)):
        now = spark.conf.get(key, None)
        if now is None or now == str(default) or default is None and int(now.rstrip("bB") or 0) >= (1 << 31) - 1:
            spark.conf.set(key, str(ours))


def map_batches(
    df: DataFrame,
    keep: Sequence[str],
    needs: Sequence[str],
    fields: str,
    start: Callable[[], Callable[..., Sequence]],
) -> DataFrame:
    """The columns `keep` of `df`, and `fields` (DDL) made from the columns `needs`.

    `start` runs once in each task and returns a function from one list of values for each column of
    `needs` to one list (or Arrow array) for each field. A kept column that is named like a field gives way to it.
    """
    bound_batches(df.sparkSession)
    made = StructType.fromDDL(fields)
    taken = {name.lower() for name in made.names}
    keep = [name for name in keep if name.lower() not in taken]
    read = [F.col(f"`{name}`").alias(f"_in{i}") for i, name in enumerate(needs)]
    kept = [F.col(f"`{name}`").alias(f"_keep{i}") for i, name in enumerate(keep)]
    source = df.select(*kept, *read)
    schema = StructType([*source.schema.fields[: len(keep)], *made.fields])
    arrow = to_arrow_schema(made)
    n = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if not batch.num_rows:
                continue
            work = work or start()
            columns = work(*(batch.column(n + i).to_pylist() for i in range(batch.num_columns - n)))
            arrays = [
                column if isinstance(column, pa.Array) else pa.array(column, field.type)
                for column, field in zip(columns, arrow, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], *arrays], names=[*batch.schema.names[:n], *arrow.names]
            )

    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(f"_keep{i}").alias(name) for i, name in enumerate(keep)), *made.names)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: a lost executor costs a re-read.

    The shuffle files of the write go when it ends, so a query of many such steps holds those of one step at a time.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
