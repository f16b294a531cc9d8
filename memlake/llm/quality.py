"""Quality rules: countable facts of a text, fixed base limits, and a calibrated n-gram classifier."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.batches import bound_batches, map_batches
from memlake.llm.hashing import Hasher, chain
from memlake.llm.linear import Rows, calibrate, fit, sigmoid

#: Labelled rows that the classifier is fitted on, at most; chosen by a hash of the id.
SAMPLE = 4000
#: Hash buckets of word n-grams (one and two words) and of character n-grams (three bytes), the same number each.
BUCKETS = 1 << 15
#: Scale of the relative frequencies, so that usual weights are near one.
SCALE = 100.0
#: A text is rejected from this probability of poor quality on.
THRESHOLD = 0.9
#: Base limits: words at least, and per cent of the words in repeated windows at most.
MIN_WORDS, MAX_REPEATED = 10, 20

_WHITE = " \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"


def facts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null: none of all."""
    text = text or ""
    encoded = text.encode()
    words = encoded.split()
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(_WHITE)]
    return (
        n,
        len(text) - sum(map(text.count, _WHITE)),
        len(encoded) - len(encoded.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
    )


def repeated(words: Sequence[bytes], width: int = 5) -> int:
    """The number of words that lie in a window of `width` words found twice or more."""
    windows = list(zip(*(words[k:] for k in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, reach = 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + width - max(reach, i)
            reach = i + width
    return covered


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


class Grams:
    """Hashed n-grams of texts: for each text the buckets of its word n-grams and of its character n-grams."""

    def __init__(self):
        self.hasher = Hasher()

    def of(self, texts: Sequence[str | None]):
        """For each text two arrays of buckets, below BUCKETS and from there on."""
        encoded = [(text or "").encode() for text in texts]
        mask = np.uint64(BUCKETS - 1)
        for first, last, words, bounds, joined in self.hasher.blocks(encoded):
            single, double = (words & mask).astype(np.int32), (chain(words, 2) & mask).astype(np.int32)
            letters = joined.astype(np.uint32)
            three = (letters[:-2] * 0x9E3779B1 + letters[1:-1] * 0x85EBCA77 + letters[2:] * 0xC2B2AE3D).astype(np.uint32)
            three = ((three ^ (three >> 15)) * np.uint32(0x2C1B3C6D) >> 17).astype(np.int32) + BUCKETS
            start = 0
            for i in range(last - first):
                a, b = int(bounds[i]), int(bounds[i + 1])
                end = start + len(encoded[first + i])
                yield np.concatenate([single[a:b], double[a : max(b - 1, a)]]), three[start : max(end - 2, start)]
                start = end + 1


class Classifier:
    """Hashed n-gram logistic regression with a calibrated probability that a text is of poor quality.

    An untrained one (no labelled rows, or all of one class) gives every text probability 0.
    """

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def score(self, grams: Grams, texts: Sequence[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        means = [
            sum(self.weights[part].sum() / len(part) for part in parts if len(part)) for parts in grams.of(texts)
        ]
        return sigmoid(self.slope * (SCALE * np.array(means) + self.bias) + self.offset)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on `sample` labelled rows at most, the same ones each time; one in four only calibrates.

    `labels` has doc_id and quality (0: poor). Ids labelled more than once count with their lowest quality;
    null ids and labels don't count. Rows are featurised in tasks; sparse rows come to the driver, `sample` at most.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def start():
        grams = Grams()

        def work(texts):
            columns, values = [], []
            for parts in grams.of(texts):
                found = [np.unique(part, return_counts=True) for part in parts]
                columns.append(np.concatenate([bucket for bucket, _ in found]))
                values.append(np.concatenate([SCALE * times / max(times.sum(), 1) for _, times in found]))
            return columns, values

        return work

    made = map_batches(rows, ["doc_id", "quality"], ["text"], "columns array<int>, amounts array<float>", start)
    table = made.toArrow()
    order = pc.sort_indices(table, [("doc_id", "ascending"), ("quality", "ascending")]).to_numpy()[: 2 * sample]
    labelled = 1 - table["quality"].to_numpy()[order].astype(np.int64)
    if len(set(labelled.tolist())) < 2:
        return Classifier()
    held = np.arange(len(order)) % 4 == 3
    if len(set(labelled[held].tolist())) < 2 or labelled[held].sum() < 20:
        held[:] = False
    fitted = np.flatnonzero(~held)
    checked = np.flatnonzero(held) if held.any() else fitted

    def sparse(chosen: np.ndarray) -> Rows:
        pairs = ((table["columns"][i], table["amounts"][i]) for i in order[chosen].tolist())
        return Rows(((columns.values.to_numpy(), amounts.values.to_numpy()) for columns, amounts in pairs), 2 * BUCKETS)

    fitting, checking = sparse(fitted), sparse(checked)
    # The driver has little memory: what came goes before the fit begins.
    del table
    pa.default_memory_pool().release_unused()
    weights, bias = fit(fitting, labelled[fitted])
    scores = checking.times(weights) + bias
    return Classifier(weights.astype(np.float32), bias, *calibrate(scores, labelled[checked]))


def judge(df: DataFrame, model: Classifier, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of `df`, the facts of `text`, base_failed, p_poor and kept, row by row.

    A text is kept unless it fails a base limit or its probability of poor quality reaches THRESHOLD.
    Null counts as empty: no words, so it fails. Equally named input columns give way to the results.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # 2 * BUCKETS weights, whatever the input

    def start():
        grams, classifier = Grams(), sent.value

        def work(texts):
            counted = [facts(text) for text in texts]
            failed = [base_failed(row[0], row[4]) for row in counted]
            poor = classifier.score(grams, texts)
            return [*zip(*counted), failed, poor.tolist(), [not f and p < THRESHOLD for f, p in zip(failed, poor)]]

        return work

    fields = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, p_poor double, kept boolean"
    )
    return map_batches(df, df.columns if keep is None else keep, [text], fields, start)
