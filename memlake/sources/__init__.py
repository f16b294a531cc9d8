"""Where rows come from and go to: job logs, vector tables, the memory store."""

from memlake.sources.jobs import (
    assemble_jobs,
    decode_jobs,
    emit_jobs,
    job_stream,
    publish_jobs,
    split_decoded,
)
from memlake.sources.store import MemoryStore
from memlake.sources.workdir import work_dir

__all__ = [
    "MemoryStore",
    "assemble_jobs",
    "decode_jobs",
    "emit_jobs",
    "job_stream",
    "publish_jobs",
    "split_decoded",
    "work_dir",
]
