"""Token counts under a unigram piece model: forward scores shared along the prefixes of a trie."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from memlake.llm.batches import map_batches

#: Nodes of a task's trie, at most; beyond that it starts anew (results don't change).
NODES = 400_000
#: Pre-tokens longer than this are scored without the trie, so that one endless word does not fill it.
TRIE_LENGTH = 40
#: Words that are placed at a time.
BLOCK = 1 << 15
#: Natural logarithm that a byte of a character without piece costs.
BYTE_SCORE = -15.0


def load(model_path: str) -> dict[str, float]:
    """The pieces of a sentencepiece file and their scores as log-probabilities.

    A BPE file has merge ranks for scores; the piece of rank r gets Zipf's log-probability, -ln(r + 1) less a constant.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    pieces = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if not special(i)}
    if min(pieces.values(), default=0.0) > -100:  # log-probabilities already
        return pieces
    usable = {piece: -score for piece, score in pieces.items() if score > -1e8}
    total = math.log(sum(1 / (rank + 1) for rank in usable.values()))
    return {piece: -math.log(rank + 1) - total for piece, rank in usable.items()}


class Matches:
    """Which pieces end at each place of a word: an Aho-Corasick automaton over the pieces.

    `piece` of a state is the state of the longest piece that ends where it is reached, `shorter` that of the
    longest one below it (0: none), so no other substring is ever looked up.
    """

    def __init__(self, pieces: dict[str, float]):
        self.goto: dict[int, int] = {}
        below: list[list[tuple[int, int]]] = [[]]
        own = {}
        for piece, score in pieces.items():
            state = 0
            for code in map(ord, piece):
                key = state << 21 | code
                if key not in self.goto:
                    self.goto[key] = len(below)
                    below[state].append((code, len(below)))
                    below.append([])
                state = self.goto[key]
            own[state] = (len(piece), score)
        fail, longest, shorter = ([0] * len(below) for _ in range(3))
        level = [0]
        while level:  # by depth: the state a state falls back to is shorter than itself
            after = []
            for state in level:
                for code, child in below[state]:
                    back = fail[state]
                    while (onward := self.goto.get(back << 21 | code)) is None and back:
                        back = fail[back]
                    fail[child] = (onward or 0) if state else 0
                    shorter[child] = longest[fail[child]]
                    longest[child] = child if child in own else shorter[child]
                    after.append(child)
            level = after
        self.fail, self.piece, self.shorter = map(np.array, (fail, longest, shorter))
        self.length, self.score = np.zeros(len(below), np.int64), np.zeros(len(below))
        for state, (length, score) in own.items():
            self.length[state], self.score[state] = length, score

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        out = np.zeros(len(states), np.int64)
        todo = np.arange(len(states))
        while len(todo):
            onward = _get(self.goto, states << 21 | codes)
            done = onward >= 0
            out[todo[done]] = onward[done]
            left = ~done & (states > 0)
            todo, states, codes = todo[left], self.fail[states[left]], codes[left]
        return out


def _get(table: dict[int, int], keys: np.ndarray) -> np.ndarray:
    """The values of many keys, -1 where there is none."""
    return np.fromiter(map(table.get, keys.tolist(), repeat(-1)), np.int64, len(keys))


class Trie:
    """Distinct pre-tokens; each node has the best score of its prefix and that segmentation's token count.

    A node's forward score is computed once, from the nodes above it, however many pre-tokens share it. Of equally
    good segmentations the one with the shortest last piece counts.
    """

    def __init__(self, pieces: dict[str, float]):
        self.matches = Matches(pieces)
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.size = 1
        self._nodes = np.zeros(1024, [("score", float), ("tokens", int), ("terminal", int), ("state", int)])

    scores = property(lambda self: self._nodes["score"][: self.size])
    tokens = property(lambda self: self._nodes["tokens"][: self.size])
    terminal = property(lambda self: self._nodes["terminal"][: self.size])

    def insert(self, word: str, times: int = 1) -> int:
        """Adds to the terminal count of `word`; returns its token count."""
        return self.insert_all([word], [times])[0]

    def insert_all(self, words: list[str], times: list[int]) -> list[int]:
        """`insert` of many different words, in ascending order."""
        counts = []
        for first in range(0, len(words), BLOCK):
            block = words[first : first + BLOCK]
            last = self._place(block)
            self.terminal[last] += times[first : first + BLOCK]
            counts += self.tokens[last].tolist()
        return counts

    def _place(self, words: list[str]) -> np.ndarray:
        """The last node of each word, made where it is new: level by level, one node for each different prefix."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        codes = np.array(words).view(np.uint32).reshape(n, -1).astype(np.int64)
        # Length of the prefix that a word has in common with the one before it.
        differ = codes[1:] != codes[:-1]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), codes.shape[1])
        shared = np.concatenate([[-1], np.minimum(shared, np.minimum(sizes[1:], sizes[:-1]))])
        at = np.zeros((codes.shape[1] + 1, n), np.int64)
        for depth in range(1, int(sizes.max(initial=0)) + 1):
            new = (sizes >= depth) & (shared < depth)
            rows = np.flatnonzero(new)
            keys = at[depth - 1, rows] << 21 | codes[rows, depth - 1]
            nodes = _get(self.children, keys)
            fresh = np.flatnonzero(nodes < 0)
            if len(fresh):
                nodes[fresh] = self._forward(at, depth, rows[fresh], codes[rows[fresh], depth - 1])
                self.children.update(zip(keys[fresh].tolist(), nodes[fresh].tolist()))
            at[depth] = nodes[np.cumsum(new) - 1]  # of words that are shorter it is not read
        return at[sizes, np.arange(n)]

    def _forward(self, at: np.ndarray, depth: int, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """New nodes `depth` characters below the root, for the prefixes of `rows`; `at` has the nodes above."""
        matches, above = self.matches, at[depth - 1, rows]
        first, self.size = self.size, self.size + len(rows)
        if self.size > len(self._nodes):
            self._nodes = np.concatenate([self._nodes, np.zeros(self.size, self._nodes.dtype)])
        score, tokens = self._nodes["score"], self._nodes["tokens"]
        state = matches.step(self._nodes["state"][above], codes)
        size = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        alone = score[above] + BYTE_SCORE * size
        best, count = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)
        piece = matches.piece[state]
        live = np.flatnonzero(piece)
        while len(live):  # the longest piece first; of equally good ones the last, which is the shortest, stays
            ending = piece[live]
            before = at[depth - matches.length[ending], rows[live]]
            reached = score[before] + matches.score[ending]
            better = reached >= best[live]
            best[live[better]], count[live[better]] = reached[better], tokens[before[better]] + 1
            piece[live] = matches.shorter[ending]
            live = live[piece[live] > 0]
        made = slice(first, self.size)
        score[made] = np.where(best > alone, best, alone)
        tokens[made] = np.where(best > alone, count, tokens[above] + size)
        self._nodes["state"][made] = state
        return np.arange(first, self.size)


def count_alone(word: str, matches: Matches) -> int:
    """The token count of one word, without trie: for very long words, in memory of a few numbers a character."""
    scores, tokens, state = [0.0], [0], 0
    goto, fail, piece, shorter = matches.goto, matches.fail, matches.piece, matches.shorter
    for i, char in enumerate(word):
        while (onward := goto.get(state << 21 | ord(char))) is None and state:
            state = int(fail[state])
        state = onward or 0
        size = len(char.encode())
        alone = scores[i] + BYTE_SCORE * size
        best, count, ending = -math.inf, 0, int(piece[state])
        while ending:
            before = i + 1 - int(matches.length[ending])
            reached = scores[before] + float(matches.score[ending])
            if reached >= best:
                best, count = reached, tokens[before] + 1
            ending = int(shorter[ending])
        scores.append(max(best, alone))
        tokens.append(count if best > alone else tokens[i] + size)
    return tokens[-1]


def words_of(text: str | None) -> list[str]:
    """Runs of characters other than space and 0x09-0x0D."""
    return [word.decode() for word in text.encode().split()] if text else []


class Counting:
    """Counts tokens batch by batch with one trie for a task."""

    def __init__(self, pieces: dict[str, float]):
        self.trie = Trie(pieces)

    def counts(self, texts: Iterable[str | None]) -> tuple[list[int], list[int]]:
        rows = [text.encode().split() if text else [] for text in texts]
        times = Counter()
        for words in rows:
            times.update(words)
        if self.trie.size > NODES:
            self.trie.clear()
        cost, usual = {}, []
        for word in sorted(times):
            token = "▁" + word.decode()
            if len(token) <= TRIE_LENGTH:
                usual.append((word, token))
            else:
                cost[word] = count_alone(token, self.trie.matches)
        counted = self.trie.insert_all([token for _, token in usual], [times[word] for word, _ in usual])
        cost.update(zip((word for word, _ in usual), counted))
        return [len(words) for words in rows], [sum(map(cost.__getitem__, words)) for words in rows]


def count(df: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of `df`, n_words and n_tokens of the whole `text`, row by row.

    A word's tokens are those of its most probable segmentation, a word mark in front; a character that no
    piece covers counts one token for each of its UTF-8 bytes. Null and empty texts have neither words nor
    tokens. `model_path` is a file that each executor can open. Equally named input columns give way.
    """

    def start():
        counting = Counting(load(model_path))
        return lambda texts: counting.counts(texts)

    return map_batches(df, df.columns if keep is None else keep, [text], "n_words long, n_tokens long", start)
