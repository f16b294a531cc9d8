"""Substring dedup: runs of words chosen by content, compared by digest; content-defined chunks by a gear rolling hash."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.batches import map_batches
from memlake.llm.hashing import BLOCK, Hasher, chain, mix

#: Bytes that the gear hash sees: a boundary depends on the bytes just before it, and on nothing else.
WINDOW = 32
#: A place is a candidate if the hash's top BITS bits are zero; a boundary, if no candidate lies within MIN bytes before.
BITS, MIN, MAX = 4, 16, 512
#: Words of a run, and least words of a repeated passage: whatever repeats has so many words in a row in common.
MIN_WORDS = 25
#: Of so many neighbouring runs the one with the least hash is kept. So a stretch of MIN_WORDS + NEIGHBOURS - 1 words has
#: the same run kept wherever it occurs, whatever is around it, and NEIGHBOURS - 1 words at most are missing at either end.
NEIGHBOURS = 13

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash, h = (h << 1) + G[byte], of the last 32 bytes."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


def boundaries(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Ends of chunks (one past the last byte) in `data`, where texts begin at `begins`; ends of texts not included."""
    hits = np.flatnonzero(gear(data) >> np.uint32(32 - BITS) == 0) + 1
    hits = hits[np.diff(hits, prepend=-MIN) >= MIN]
    own = begins[np.searchsorted(begins, hits, side="right") - 1]
    return hits[hits - own >= WINDOW]


def cut(texts: list[bytes]):
    """For each text the ends of its chunks, in bytes; the last one is the text's length."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < BLOCK):
            size += len(texts[last])
            last += 1
        data = np.frombuffer(b"".join(texts[first:last]), np.uint8)
        bounds = np.cumsum([0, *map(len, texts[first:last])])
        if len(data):
            found = boundaries(data, bounds[:-1])
            places = np.searchsorted(found, bounds, side="right")
        for i in range(last - first):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if a == b:
                yield []
                continue
            ends = [int(x) - a for x in found[places[i] : places[i + 1]] if x < b]
            ends.append(b - a)
            if max(np.diff(ends, prepend=0)) > MAX:
                pieces, at = [], 0
                for end in ends:
                    pieces += [*range(at + MAX, end, MAX), end]
                    at = end
                ends = pieces
            yield ends
        first = last


def chunks(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of `df` and `chunks`, array of digest (128 bits), start, end (bytes of UTF-8), words.

    Chunks cover the text; `words` counts the words that begin in one. Null and empty texts have no chunks.
    """

    def start():
        def work(texts):
            encoded = [(value or "").encode() for value in texts]
            rows = []
            for data, ends in zip(encoded, cut(encoded)):
                space = _SPACE[np.frombuffer(data, np.uint8)]
                starts_word = ~space
                starts_word[1:] &= space[:-1]
                seen = np.concatenate([[0], np.cumsum(starts_word)])
                begins = [0, *ends[:-1]]
                words = (seen[ends] - seen[begins]).tolist() if ends else []
                rows.append(
                    [
                        {"digest": xxhash.xxh3_128_digest(data[a:b]), "start": a, "end": b, "words": n}
                        for a, b, n in zip(begins, ends, words)
                    ]
                )
            return [rows]

        return work

    fields = "chunks array<struct<digest:binary,start:int,end:int,words:int>>"
    return map_batches(df, df.columns if keep is None else keep, [text], fields, start)


def kept_runs(hashes: np.ndarray) -> np.ndarray:
    """Places of the least hash in each window of NEIGHBOURS (all of them, if fewer), the first one if several are least.

    Of more equal hashes in a row each NEIGHBOURS-th and the last one are enough: any window that has one of
    them as its least has one that is kept.
    """
    if len(hashes) <= NEIGHBOURS:
        return np.array([hashes.argmin()]) if len(hashes) else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, NEIGHBOURS)
    places = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(hashes))))
    last = np.concatenate([~same[1:], [True]])
    row = (places - begin[places]) % NEIGHBOURS == 0
    return places[row | last[places] | (places == len(windows) - 1)]


def runs(df: DataFrame, text: str, keep: list[str], width: int = MIN_WORDS) -> DataFrame:
    """The columns `keep` of `df` and `runs`, array of digest (128 bits), start, end (bytes of UTF-8), word (the first one's
    number): the runs of `width` words that are kept, byte for byte with the blanks between. Fewer words: none."""

    def start():
        hasher = Hasher()

        def work(texts):
            encoded = [(value or "").encode() for value in texts]
            rows = []
            for first, last, words, bounds, joined in hasher.blocks(encoded):
                hashes, space = chain(words, width), _SPACE[joined]
                turn = np.flatnonzero(space[1:] != space[:-1]) + 1
                turn = turn if space[0] else np.concatenate([[0], turn])
                at = 0
                for i in range(last - first):
                    data, a, b = encoded[first + i], int(bounds[i]), int(bounds[i + 1])
                    places = kept_runs(hashes[a : max(a, b - width + 1)])
                    begins = (turn[2 * (a + places)] - at).tolist()
                    ends = (turn[2 * (a + places + width - 1) + 1] - at).tolist()
                    rows.append(
                        [
                            {"digest": xxhash.xxh3_128_digest(data[x:y]), "start": x, "end": y, "word": n}
                            for x, y, n in zip(begins, ends, places.tolist())
                        ]
                    )
                    at += len(data) + 1
            return [rows]

        return work

    return map_batches(df, keep, [text], "runs array<struct<digest:binary,start:int,end:int,word:int>>", start)


def passages(df: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Stretches made of runs of `min_words` words that occur in several documents, each with the first of them.

    doc_id, start_byte, end_byte, n_words, n_copies (of its rarest run), first_doc_id (the smallest id that
    has one of its runs) and duplicate (false in the first document). Runs that repeat and overlap form one
    stretch. What repeats over `min_words` + NEIGHBOURS - 1 words or more is always found, up to NEIGHBOURS - 1
    words at either end; shorter repeats are found if their run is one of those kept. Rows with the same id count as one
    document, and so don't repeat each other; rows without id or text have no passages. Empty tables give empty results.
    """
    source = df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text <> ''")
    every = runs(source, "text", ["doc_id"], min_words).select("doc_id", F.inline("runs"))
    # Counted before the shuffle: a run of a third of all documents is one row for each task.
    repeated = (
        every.groupBy("digest")
        .agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), F.count("*").alias("n_runs"))
        .where("first_doc_id < last")
        .select("digest", "first_doc_id", "n_runs")
    )
    found = every.join(repeated, "digest")
    by_place = Window.partitionBy("doc_id").orderBy("start", "end", "digest")
    stretches = found.withColumn(
        "stretch", F.sum(F.when(F.col("start") <= F.lag("end").over(by_place), 0).otherwise(1)).over(by_place)
    )
    return (
        stretches.groupBy("doc_id", "stretch")
        .agg(
            F.min("start").cast("long").alias("start_byte"),
            F.max("end").cast("long").alias("end_byte"),
            (F.max("word") - F.min("word") + min_words).cast("long").alias("n_words"),
            F.min("n_runs").alias("n_copies"),
            F.min("first_doc_id").alias("first_doc_id"),
        )
        .select("*", (F.col("first_doc_id") < F.col("doc_id")).alias("duplicate"))
        .drop("stretch")
    )
