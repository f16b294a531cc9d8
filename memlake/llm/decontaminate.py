"""Benchmark decontamination: every passage of every text against a BM25 index of the test items.

The index is inverted and cut into blocks of items, each term with its greatest impact in each block. A passage skips,
as block-max WAND does, the blocks whose summed maxima stay below the threshold; the items of the others
are scored exactly. Passages and blocks are handled as whole arrays.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.batches import map_batches

#: BM25 parameters.
K1, B = 1.2, 0.75
#: A passage is two neighbouring segments of so many words; so each run of SEGMENT words lies in a passage whole.
SEGMENT = 32
#: Items are retrieved from this share of their own score on; of items longer than LONG words, of LONG words' share.
THRESHOLD, LONG = 0.5, 48
#: Share of an item's question and of its answer that a text must have, in word triples.
OVERLAP, GRAM = 0.6, 3
#: Items with fewer words identify nothing and are left out.
LEAST_WORDS = 5
#: Blocks of an index, and characters of items that one index holds at most; more items make several indexes.
BLOCKS, INDEX_CHARS = 16, 4_000_000

_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of other characters than ASCII."""
    return text.lower().encode().translate(_PLAIN).split() if text else []


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's last sentence is its answer, the rest its question; of a single sentence the second half."""
    sentences = [words for words in map(words_of, _SENTENCE.split(text)) if words]
    if len(sentences) > 1:
        return [word for words in sentences[:-1] for word in words], sentences[-1]
    words = sentences[0] if sentences else []
    return words[: len(words) // 2], words[len(words) // 2 :]


def grams(words: Sequence[bytes]) -> set[tuple[bytes, ...]]:
    """Word triples; of fewer words the whole sequence."""
    n = min(GRAM, len(words))
    return set(zip(*(words[k:] for k in range(n)))) if n else set()


def overlap(part: Sequence[bytes], region: Sequence[bytes]) -> float:
    """Share of the part's triples that the region has; an empty part is there whole."""
    wanted = grams(part)
    if not wanted:
        return 1.0
    n = min(GRAM, len(part))
    return len(wanted & set(zip(*(region[k:] for k in range(n))))) / len(wanted)


class Index:
    """Postings of the items' terms, as impacts relative to what makes an item retrieved at 1."""

    def __init__(self, items: Sequence[tuple[int, str]]):
        read = [(item_id, text, words_of(text)) for item_id, text in items]
        read = [row for row in read if len(row[2]) >= LEAST_WORDS]
        # Items of like length side by side: their impacts are alike, so the blocks' maxima are close.
        read.sort(key=lambda row: (len(row[2]), row[0], row[1]))
        self.ids = [row[0] for row in read]
        self.parts = [question_and_answer(text) for _, text, _ in read]
        self.lengths = np.array([len(words) for _, _, words in read], np.int64)
        n = len(read)
        documents = Counter(word for _, _, words in read for word in set(words))
        self.terms = {word: i for i, word in enumerate(sorted(documents))}
        average = self.lengths.mean() if n else 1.0
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for i, (_, _, words) in enumerate(read):
            impacts = {}
            for word, tf in Counter(words).items():
                idf = math.log(1 + (n - documents[word] + 0.5) / (documents[word] + 0.5))
                impacts[word] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / average))
            needed = THRESHOLD * sum(impacts.values()) * min(1.0, LONG / len(words))
            for word, impact in impacts.items():
                postings[self.terms[word]].append((i, impact / needed))
        self.starts = np.cumsum([0, *map(len, postings)])
        self.items = np.array([i for row in postings for i, _ in row], np.int32)
        self.impacts = np.array([x for row in postings for _, x in row])
        self.size = max(1, -(-n // BLOCKS))
        self.blocks = max(1, -(-n // self.size))
        self.maxima = np.zeros((len(self.terms), self.blocks), np.float32)
        owner = np.repeat(np.arange(len(self.terms)), np.diff(self.starts))
        np.maximum.at(self.maxima, (owner, self.items // self.size), np.nextafter(self.impacts.astype(np.float32), np.inf))

    def exact(self, terms: np.ndarray, blocks: np.ndarray) -> list[tuple[int, float]]:
        """(item, score) of the items in `blocks` that reach 1 for a passage with the distinct `terms`."""
        wanted = np.zeros(self.blocks, bool)
        wanted[blocks] = True
        spans = [slice(a, b) for a, b in zip(self.starts[terms], self.starts[terms + 1])]
        items = np.concatenate([self.items[s] for s in spans])
        kept = wanted[items // self.size]
        scores = np.bincount(items[kept], np.concatenate([self.impacts[s] for s in spans])[kept], len(self.ids))
        return [(int(i), float(scores[i])) for i in np.flatnonzero(scores >= 1 - 1e-9)]

    def search(self, rows: Sequence[Sequence[bytes]]):
        """For each list of words the retrieved (item, score, first word of the passage), every passage queried."""
        found: list[list[tuple[int, float, int]]] = [[] for _ in rows]
        if not self.ids:
            return found
        sizes = [-(-len(words) // SEGMENT) for words in rows]
        first_segment = np.cumsum([0, *sizes])
        keys = []
        for row, words in enumerate(rows):
            terms = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
            segments = np.arange(len(words), dtype=np.int64) // SEGMENT + first_segment[row]
            keys.append((segments * len(self.terms) + terms)[terms >= 0])
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        if not len(keys):
            return found
        segments, terms = np.divmod(keys, len(self.terms))
        starts = np.flatnonzero(np.diff(segments, prepend=-1))
        bounds = np.zeros((int(first_segment[-1]) + 1, self.blocks), np.float32)
        bounds[segments[starts]] = np.add.reduceat(self.maxima[terms], starts, axis=0)
        last = np.zeros(len(bounds), bool)
        last[first_segment[1:] - 1] = True
        both = bounds.copy()
        both[:-1][~last[:-1]] += bounds[1:][~last[:-1]]
        # Rounding of the sums must not lose a passage that is just as good as needed.
        hopeful = both >= 1 - 1e-4
        places = np.searchsorted(segments, np.arange(len(bounds) + 1))
        owner = np.searchsorted(first_segment, np.arange(len(bounds)), side="right") - 1
        for segment in np.flatnonzero(hopeful.any(axis=1)).tolist():
            until = segment + (1 if last[segment] else 2)
            distinct = np.unique(terms[places[segment] : places[until]])
            row = int(owner[segment])
            for item, score in self.exact(distinct, np.flatnonzero(hopeful[segment])):
                found[row].append((item, score, (segment - int(first_segment[row])) * SEGMENT))
        return found

    def leaks(self, rows: Sequence[Sequence[bytes]]) -> list[list[dict]]:
        """For each list of words the items whose question and answer are verified near a passage that retrieved them."""
        result = []
        for words, hits in zip(rows, self.search(rows)):
            best: dict[int, dict] = {}
            for item, score, at in hits:
                reach = int(self.lengths[item])
                region = words[max(0, at - reach) : at + 2 * SEGMENT + reach]
                question, answer = (overlap(part, region) for part in self.parts[item])
                if question >= OVERLAP and answer >= OVERLAP:
                    made = {"item_id": self.ids[item], "score": score * THRESHOLD, "question": question, "answer": answer}
                    rank = (question + answer, score)
                    old = best.get(self.ids[item])
                    if old is None or rank > (old["question"] + old["answer"], old["score"] / THRESHOLD):
                        best[self.ids[item]] = made
            result.append([best[item_id] for item_id in sorted(best)])
        return result


def indexes(items: DataFrame, chars: int = INDEX_CHARS):
    """The indexes of the items (item_id, text), one after another, each of about `chars` characters at most.

    The items' size is looked at first; a large benchmark is read and searched in parts. Items without id or
    text are left out, and those of fewer than LEAST_WORDS words.
    """
    usable = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text <> ''")
    size = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-size // chars)
    for part in range(parts):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        yield Index([(row.item_id, row.text) for row in rows])


def mark(df: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of `df` and `leaks`: array of item_id, score, question, answer.

    `score` is the best passage's BM25 as a share of the item's own (of LONG words for longer items), `question` and
    `answer` the shares of their word triples found there. Null and empty texts leak nothing, nor does any text
    if there are no items. Row by row: repeated rows stay, an input column named leaks gives way.
    """
    kept = [name for name in (df.columns if keep is None else keep) if name.lower() != "leaks"]
    fields = "array<struct<item_id:long,score:double,question:double,answer:double>>"
    carried = df.select(*kept, F.col(text).alias("_text"), F.array().cast(fields).alias("leaks"))
    for index in indexes(items):
        sent = df.sparkSession.sparkContext.broadcast(index)  # of INDEX_CHARS characters

        def start(sent=sent):
            return lambda texts: [sent.value.leaks([words_of(value) for value in texts])]

        made = map_batches(carried, [*kept, "_text", "leaks"], ["_text"], f"more {fields}", start)
        carried = made.select(*kept, "_text", F.concat("leaks", "more").alias("leaks"))
    return carried.drop("_text")
