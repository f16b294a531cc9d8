"""Column functions: everything here maps columns to columns, row by row."""

from memlake.functions.binding import whole
from memlake.functions.ids import content_id, memory_id
from memlake.functions.text import (
    context_query_text,
    fallback_query_text,
    last_user_content,
    normalise_fact,
    sentences,
    transcript_text,
    trim_space,
    trim_user_key,
)
from memlake.functions.vectors import sparse_vector

__all__ = [
    "content_id",
    "context_query_text",
    "fallback_query_text",
    "last_user_content",
    "memory_id",
    "normalise_fact",
    "sentences",
    "sparse_vector",
    "transcript_text",
    "trim_space",
    "trim_user_key",
    "whole",
]
