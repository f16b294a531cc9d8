"""Toxicity: a weighted finite-state grammar over clauses, with insults learned from labelled documents."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.batches import map_batches
from memlake.llm.linear import calibrate, sigmoid

#: Labelled rows of each class that are learned from, at most; chosen by a hash of the id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: A word or word beginning may be an insult if its documents are toxic that much more often than chance allows
#: (standard deviations), if its log-odds reach LEAST_ODDS, and if a share of the toxic documents has it.
LEAST_SURPRISE, LEAST_ODDS, LEAST_DOCUMENTS, LEAST_SHARE = 5.0, 4.0, 3, 0.004
#: Lengths of word beginnings, and candidates looked at, at most (the most frequent ones).
BEGINNINGS, MOST_CANDIDATES = (4, 5, 6), 5000
#: Insults are chosen until each toxic document has that many, or none explains enough of the documents that lack them.
COVER = 2
#: A document is predicted toxic from this score on.
THRESHOLD = 0.3
#: Weight of all matched clauses from which on more of them change nothing.
FULL = 40.0

# Closed classes of the grammar, in the languages of the corpus.
TARGETS = frozenset("you your youre yourself him her them du dich dir ihr euch tu toi vous te tú ti usted ustedes".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't nobody nicht kein keine nie pas jamais ne ni nunca jamás tampoco".split())
REPORTS = frozenset("said says wrote quoted called claimed alleged sagte sagt schrieb zitiert dit écrit cité dijo dice escribió citó".split())
THREATS = frozenset("kill hurt destroy beat strangle stab shoot hang töten umbringen erschlagen tuer frapper étrangler matar golpear".split())

INSULT, THREAT, TARGET, NEGATION, REPORT = "insult", "threat", "target", "negation", "report"

_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[.!?;\n]")
_CLAUSE_END = frozenset(".!?;\n")
#: How far a negation reaches, in words.
REACH = 3


@dataclass
class Lexicon:
    """The first transducer: words to classes with weights. Insults are whole words, or beginnings of words."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    known: dict[str, tuple[str, float] | None] = field(default_factory=dict, repr=False, compare=False)

    def read(self, word: str) -> tuple[str, float] | None:
        """Class and weight of a lower-case word; None for a word of no class."""
        try:
            return self.known[word]
        except KeyError:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[word] = self._read(word)
            return found

    def _read(self, word: str) -> tuple[str, float] | None:
        weight = self.words.get(word, 0.0)
        for n in BEGINNINGS:
            if len(word) >= n:
                weight = max(weight, self.beginnings.get(word[:n], 0.0))
        if weight:
            return INSULT, weight
        for name, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            if word in words:
                return name, 1.0
        return None


# The second transducer, the clause grammar. A state is (target seen, threat pending, reported). Transitions on a class give the
# next state and the arc's factor; what the grammar does not name loops without weight.
_STATES = [(target, threat, reported) for target in (0, 1) for threat in (0, 1) for reported in (0, 1)]


def _grammar() -> dict[tuple[tuple[int, int, int], str], tuple[tuple[int, int, int], float]]:
    arcs = {}
    for target, threat, reported in _STATES:
        state = (target, threat, reported)
        spoken = 0.5 if reported else 1.0
        arcs[state, INSULT] = (state, spoken * (1.25 if target else 1.0))
        arcs[state, THREAT] = ((target, 1, reported), spoken * (1.0 if target else 0.0))
        arcs[state, TARGET] = ((1, 0, reported), spoken * (1.0 if threat else 0.0))
        arcs[state, REPORT] = ((target, threat, 1), 0.0)
    return arcs


GRAMMAR = _grammar()
#: Weight of a threat with its target, and factor of an arc under a negation.
THREAT_WEIGHT, NEGATED = 0.5, 0.25


def clause_weight(classes: Sequence[tuple[str, float] | None]) -> float:
    """Weight of the path that the composed transducers take through a clause: 0 without insult or aimed threat."""
    state, total, negated = (0, 0, 0), 0.0, 0
    for found in classes:
        negated -= 1
        if found is None:
            continue
        name, weight = found
        if name == NEGATION:
            negated = REACH + 1
            continue
        state, factor = GRAMMAR[state, name]
        if factor:
            total += factor * (weight if name == INSULT else THREAT_WEIGHT) * (NEGATED if negated > 0 else 1.0)
    return total


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def weight_of(text: str | None, lexicon: Lexicon) -> tuple[float, int]:
    """Total weight of a whole text's clauses, FULL at most, and the number of clauses with weight."""
    if not text:
        return 0.0, 0
    words = tokens(text)
    classes = [lexicon.read(word) for word in words]
    if not any(found and found[0] in (INSULT, THREAT) for found in classes):
        return 0.0, 0
    total, matched, begin = 0.0, 0, 0
    ends = [i for i, word in enumerate(words) if word in _CLAUSE_END]
    for end in [*ends, len(words)]:
        weight = clause_weight(classes[begin:end])
        total += weight
        matched += weight > 0
        begin = end + 1
    return min(total, FULL), matched


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a row's label is never learned from: crc32 of the id as text, mod 4, is 2. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _word_features(words: Iterable[str]) -> set[str]:
    made = set()
    for word in words:
        if len(word) > 1 or word not in _CLAUSE_END:
            made.add(word)
            made.update(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)
    return made


def learn(rows: DataFrame) -> Lexicon:
    """The lexicon of labelled texts (text, toxic). Counts of documents are made in tasks, batch by batch, then summed."""

    def start():
        def work(texts, labels):
            toxic, clean = Counter(), Counter()
            for text, label in zip(texts, labels):
                (toxic if label else clean).update(_word_features(set(tokens(text or ""))))
            both = [(word, toxic[word], clean[word]) for word in toxic.keys() | clean.keys()]
            # One row for the batch, carried by its first document.
            return [[both, *([None] * (len(texts) - 1))]]

        return work

    batches = map_batches(rows, [], ["text", "toxic"], "found array<struct<word:string,toxic:long,clean:long>>", start)
    totals = rows.agg(F.sum("toxic"), F.count("*")).first()
    n_toxic, n_rows = int(totals[0] or 0), int(totals[1])
    n_clean = n_rows - n_toxic
    if not n_toxic or not n_clean:
        return Lexicon()
    share = n_toxic / n_rows
    counted = batches.select(F.inline("found")).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = F.col("toxic") + F.col("clean")
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    chosen = (
        counted.where(F.col("toxic") >= max(LEAST_DOCUMENTS, math.ceil(LEAST_SHARE * n_toxic)))
        .withColumn("surprise", (F.col("toxic") - n * share) / F.sqrt(n * share * (1 - share)))
        .withColumn("odds", odds)
        .where((F.col("surprise") >= LEAST_SURPRISE) & (F.col("odds") >= LEAST_ODDS))
        .orderBy(F.desc("toxic"), "word")
        .limit(MOST_CANDIDATES)
        .collect()
    )
    lexicon = Lexicon()
    odds_of = {row.word: min(row.odds, 8.0) for row in chosen}
    for word in _cover(rows.where("toxic = 1"), odds_of, max(LEAST_DOCUMENTS, LEAST_SHARE * n_toxic)):
        (lexicon.beginnings if word.endswith("*") else lexicon.words)[word.rstrip("*")] = odds_of[word]
    return lexicon


def _cover(toxic: DataFrame, odds_of: dict[str, float], least: float) -> list[str]:
    """Of the candidates those that it takes to explain the toxic texts, each one COVER times if possible.

    What copies of a toxic text have in common explains nothing more once its insults are chosen. The
    candidates of each text come to the driver: the learned sample is bounded, and so is their number.
    """
    sent = toxic.sparkSession.sparkContext.broadcast(frozenset(odds_of))

    def start():
        wanted = sent.value
        return lambda texts: [[sorted(_word_features(set(tokens(text or ""))) & wanted) for text in texts]]

    texts = [row.found for row in map_batches(toxic, [], ["text"], "found array<string>", start).collect()]
    holders: dict[str, list[int]] = {word: [] for word in odds_of}
    for i, found in enumerate(texts):
        for word in found:
            holders[word].append(i)
    lacking, chosen = [COVER] * len(texts), []
    while holders:
        gain = {word: sum(lacking[i] > 0 for i in ids) for word, ids in holders.items()}
        best = max(holders, key=lambda word: (gain[word], odds_of[word], len(word), word))
        if gain[best] < least:
            break
        chosen.append(best)
        for i in holders.pop(best):
            lacking[i] -= 1
        # A word that begins with a chosen beginning, or begins as one, says the same again.
        stem = best.rstrip("*")
        for word in [w for w in holders if w.startswith(stem) or stem.startswith(w.rstrip("*"))]:
            del holders[word]
        holders = {word: ids for word, ids in holders.items() if gain[word] >= least}
    return chosen


@dataclass
class Model:
    """A lexicon and the calibration of its weights; untrained: probability 0 for every text."""

    lexicon: Lexicon = field(default_factory=Lexicon)
    slope: float = 0.0
    offset: float = -20.0

    def scores(self, weights: Sequence[float]) -> np.ndarray:
        return sigmoid(self.slope * np.sqrt(np.array(weights, float)) + self.offset)


def _weights(df: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text") -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.beginnings))  # MOST_CANDIDATES at most

    def start():
        own = Lexicon(*sent.value)

        def work(texts):
            return list(zip(*(weight_of(value, own) for value in texts)))

        return work

    return map_batches(df, keep, [text], "weight double, n_clauses int", start)


def train(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Model:
    """Learn from labelled rows that are not held out, at most `toxic` and `clean` of them, the same ones each time.

    Insults come from two thirds of them, the calibration from the rest. Ids labelled more than once count as toxic
    if any label says so; null ids and labels don't count. Without labels of both classes nothing is learned.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(~held_out())
        .withColumn("order", F.xxhash64("doc_id"))
    )
    parts = [known.where(f"toxic = {k}").orderBy("order", "doc_id").limit(n) for k, n in ((1, toxic), (0, clean))]
    chosen = parts[0].unionByName(parts[1]).select("doc_id", "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    lexicon = learn(rows.where(fold != 3).select("text", "toxic"))
    checked = _weights(rows, lexicon, ["doc_id", "toxic"]).withColumn("fold", fold)
    table = checked.select("doc_id", "weight", "toxic", "fold").toArrow().sort_by([("doc_id", "ascending"), ("weight", "ascending")])
    weights, truth = np.sqrt(table["weight"].to_numpy()), table["toxic"].to_numpy().astype(np.int64)
    apart = table["fold"].to_numpy() == 3
    if 0 < truth[apart].sum() < apart.sum() and truth[apart].sum() >= 5:
        weights, truth = weights[apart], truth[apart]
    if not lexicon.words and not lexicon.beginnings or len(set(truth.tolist())) < 2:
        return Model()
    return Model(lexicon, *calibrate(weights, truth))


def judge(df: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, weight and n_clauses (those that match), row by row.

    Null and empty texts have no clauses, and so the lowest score of all. Only the text is read for the score.
    """
    sent = (model.slope, model.offset)
    weighed = _weights(df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), model.lexicon, ["doc_id"])
    x = F.least(F.greatest(sent[0] * F.sqrt("weight") + sent[1], F.lit(-35.0)), F.lit(35.0))
    scored = weighed.withColumn("score", 1 / (1 + F.exp(-x)))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "weight",
        "n_clauses",
    )
