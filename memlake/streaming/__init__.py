"""The write path as a stream: job lines in, two memory tables out."""

from memlake.streaming.ingest import (
    ModelPlanner,
    PreparedPlans,
    RulePlanner,
    delete_from_store,
    ingest_batch,
    ingest_stream,
)

__all__ = [
    "ModelPlanner",
    "PreparedPlans",
    "RulePlanner",
    "delete_from_store",
    "ingest_batch",
    "ingest_stream",
]
