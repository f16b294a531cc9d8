"""The job log: building, writing, reading and decoding ingest jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.ids import content_id
from memlake.functions.wire import job_of
from memlake.schema import INSERT_THRESHOLD


def assemble_jobs(turns: DataFrame) -> DataFrame:
    """Turn rows (conv_id, user_id, turn, role, content) into one job row per conversation.

    A job is one record on the wire, with all its messages; so is it here, however long the conversation.
    """
    message = F.struct(F.col("turn"), F.col("role"), F.col("content"))
    gathered = turns.groupBy("user_id", "conv_id").agg(
        F.array_sort(F.collect_list(message)).alias("m")
    )
    return gathered.select(
        F.concat(F.lit("r"), F.col("conv_id")).alias("req_id"),
        "user_id",
        F.transform(
            "m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
        ).alias("messages"),
        F.lit(INSERT_THRESHOLD).alias("threshold"),
        F.col("conv_id").alias("seq"),
    )


def emit_jobs(
    requests: DataFrame,
    threshold: float = INSERT_THRESHOLD,
    replayable: Column | None = None,
) -> DataFrame:
    """Insert requests to job lines (column ``value``), ready for a file or queue sink.

    Every job gets a new random id and the fixed threshold.  With
    ``replayable`` the id is derived from that column instead, so that a
    rerun emits the same job.
    """
    req_id = F.uuid() if replayable is None else content_id(replayable)
    stamped = requests.withColumn("req_id", req_id)
    wire = F.to_json(
        F.struct(
            F.col("req_id").alias("ReqId"),
            F.col("user_id").alias("UserId"),
            F.col("messages").alias("Messages"),
            F.lit(float(threshold)).alias("Threshold"),
        ),
        {"ignoreNullFields": "false"},
    )
    return stamped.select("req_id", "user_id", wire.alias("value"))


def publish_jobs(lines: DataFrame, path: str | None = None, sink: str = "text", **options) -> None:
    """Append job lines to a log: text files by default, or any sink taking a ``value`` column."""
    writer = lines.select("value").write.mode("append").format(sink).options(**options)
    writer.save(path) if path else writer.save()


def job_stream(
    spark: SparkSession,
    path: str | None = None,
    source: str = "text",
    schema: str | None = None,
    **options,
) -> DataFrame:
    """Stream of raw job lines: column ``value``, and what the source says of their order.

    That is its own ``seq`` where it has one, else ``order``: partition and offset of a queue, or time, path and
    place in it of a file. Text files by default; any source with a ``value`` column will do, such as
    ``source="kafka"`` with that connector's options.  Tasks share the work.
    """
    reader = spark.readStream.format(source).options(**options)
    if schema:
        reader = reader.schema(schema)
    rows = reader.load(path) if path else reader.load()
    value = F.col("value").cast("string").alias("value")
    if "seq" in rows.columns:
        return rows.select(value, "seq")
    if {"partition", "offset"} <= set(rows.columns):
        return rows.select(value, F.struct("partition", "offset").alias("order"))
    if not path:
        return rows.select(value)
    file = F.col("_metadata")
    order = F.struct(
        file["file_modification_time"].alias("time"),
        file["file_path"].alias("path"),
        file["file_block_start"].alias("block"),
    )
    return rows.select(value, order.alias("order"))


def decode_jobs(lines: DataFrame) -> DataFrame:
    """Decode job lines (column ``value``); adds ``reason``, null where the line is good.

    A line is dead when it is not one JSON object, or when a field has the
    wrong type.  Keys match in any case, the last of equal ones wins, unknown ones are ignored; missing
    and null fields take the zero value of their type (an empty string, 0, null messages).
    """
    others = [c for c in lines.columns if c != "value"]
    parsed = lines.select(*others, "value", job_of("value").alias("j"))
    return parsed.select(
        "j.req_id",
        "j.user_id",
        "j.messages",
        "j.threshold",
        *others,
        F.col("value").alias("raw"),
        "j.reason",
    )


def split_decoded(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good jobs, and dead letters that are kept but never retried."""
    good = decoded.where(F.col("reason").isNull()).drop("raw", "reason")
    return good, decoded.where(F.col("reason").isNotNull()).select("raw", "reason")
