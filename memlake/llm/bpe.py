"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.batches import map_batches

#: Texts longer than this are encoded in parts of about this many characters.
PART = 100_000
#: A character that is no white space, then a blank: a safe place to cut is between them.
_SAFE = re.compile(r"\S(?= )")
#: White space as the library's patterns have it: Unicode's property, without the separators 0x1C to 0x1F.
_BLANK = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def load(rank_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file: a line for each token, its bytes in base64 and its rank."""
    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PART) -> Iterator[str]:
    """`text` in parts of at least `size` characters, cut where no match of a GPT-2 style pattern reaches across.

    In such a pattern a match of other than white space takes at most one blank, in front, and only white
    space is looked ahead at. So between a character that is no white space and a blank every match
    ends, and the one after it looks back at nothing. Without such a place the rest is one part.
    """
    start = 0
    while len(text) - start > size and (cut := _SAFE.search(text, start + size - 1)):
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def long_blanks(text: str, size: int = PART) -> Iterator[tuple[str, bool]]:
    """`text` in parts; True marks a part that is one match of a GPT-2 style pattern: white space of `size` characters or more.

    Such a pattern takes a run of white space in one match, but for the last character if other text follows, which
    goes with that. No match reaches into the run from before. The library's regex fails on runs of about a million.
    """
    start = 0
    for run in re.finditer(f"(?<!{_BLANK}){_BLANK}{{{size},}}+", text):
        end = run.end() - (run.end() < len(text))
        yield text[start : run.start()], False
        yield text[run.start() : end], True
        start = end
    yield text[start:], False


def encode_text(encoding: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """The ids of a whole text; null or empty: none."""
    if not text:
        return np.zeros(0, np.int32)
    if len(text) <= PART:
        return np.array(encoding.encode_ordinary(text), np.int32)
    ids = []
    for part, single in long_blanks(text):
        if single:
            ids.append(encoding._encode_single_piece(part))
        else:
            ids += map(encoding.encode_ordinary, safe_parts(part))
    return np.concatenate([np.array(part, np.int32) for part in ids])


def encode(
    df: DataFrame,
    rank_path: str,
    pattern: str,
    text: str = "text",
    keep: list[str] | None = None,
    decoded: bool = False,
) -> DataFrame:
    """The columns `keep` (all) of `df`, `ids` array<int>, and with `decoded` also the ids' bytes, `decoded` binary.

    Ids are those of the tiktoken library for the whole text, without special tokens (their strings are
    ordinary text). A null or empty text has no ids. `rank_path` is a file that each executor can open, as an
    installed package's. Each row is encoded by itself; repeated rows stay. `ids` and `decoded` in the input give way.
    """

    def start():
        encoding = load(rank_path, pattern)

        def work(texts):
            rows = [encode_text(encoding, value) for value in texts]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])))
            if not decoded:
                return [ids]
            return [ids, [encoding.decode_bytes(row.tolist()) for row in rows]]

        return work

    return map_batches(
        df, df.columns if keep is None else keep, [text], "ids array<int>" + ", decoded binary" * decoded, start
    )


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of `df` and `decoded` binary, the raw bytes of `ids`.

    Bytes need not be valid UTF-8: a token can end within a character. Null or empty ids: no bytes. An id
    without rank fails the job.
    """

    def start():
        encoding = load(rank_path, pattern)
        return lambda rows: [[encoding.decode_bytes(row) if row else b"" for row in rows]]

    return map_batches(df, df.columns if keep is None else keep, [ids], "decoded binary", start)


def digests(encoded: DataFrame) -> DataFrame:
    """Of encode(..., decoded=True): n_tokens, and SHA-256 of the ids (decimal, one space between) and of the bytes."""
    return encoded.select(
        "*",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
