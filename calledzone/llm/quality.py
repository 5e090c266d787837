"""Quality classifier: averaged hashed word and character n-gram vectors, softmax output.

Every word of a text stands for itself and its character n-grams, every two neighbouring words for a word pair. A word that
stands among the BACK words before it enters its pairs as the distance to it, so that what pairs tell of repeated words
holds for words never learned. Features are hashed into BUCKETS learned vectors, averaged over the text, and a
softmax layer makes two class probabilities of the average. Vectors and layer are trained by numpy stochastic
gradient descent (with per-row step sizes), text by text, in one task over at most TRAIN_ROWS labelled texts, each reduced
to at most BUCKETS counted features before it goes there. The trained layer is linear in the average,
so scoring adds up one number a word and one a pair.

Defined cases: null text counts as empty; empty texts have the zero average and get the layer's bias as score. Null ids are
scored and count as not held out. Repeated rows score alike. Without labels every score is one half. An empty
table gives an empty result. Other columns are not looked at, and inputs of a score are words alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .scratch import held_out, keep, map_arrow, slices, two_columns
from .words import MULTIPLIERS, mix

TRAIN_ROWS = 6_000
BUCKETS = 1 << 16
WIDTH = 8
NGRAMS = (3, 4)
EPOCHS = 4
RATE = 0.5
BACK = 8
REMEMBERED = 400_000


def features(word: str) -> list[int]:
    """Buckets of a word and its character n-grams."""
    marked = f"<{word}>"
    grams = {marked[k:k + n] for n in NGRAMS for k in range(len(marked) - n + 1)}
    return [xxhash.xxh3_64_intdigest(f) % BUCKETS for f in (f"w{word}", *sorted(grams))]


def name_of(word: str) -> int:
    """64-bit hash that stands for a word in its pairs."""
    return xxhash.xxh3_64_intdigest(word)


_DISTANCES = np.array([name_of(f"\x00{back}") for back in range(BACK + 1)], np.uint64)


def pairs(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all pairs of neighbouring words, and the text of each; `names` holds the hashes of the words in order,
    `owner` the text each of them stands in."""
    told = names.copy()
    for back in range(min(BACK, len(names) - 1), 0, -1):  # the nearest one last, so that it counts
        again = (names[back:] == names[:-back]) & (owner[back:] == owner[:-back])
        told[back:][again] = _DISTANCES[back]
    inside = owner[1:] == owner[:-1]
    mixed = mix(told[:-1] * MULTIPLIERS[0] + told[1:] * MULTIPLIERS[1])
    return (mixed % np.uint64(BUCKETS)).astype(np.int64)[inside], owner[1:][inside]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, tuple[list[int], int]] = {}
    for batch in slices(batches):
        places, counts = [], []
        for text in batch.column("text").to_pylist():
            every, names = [], []
            for word in text.split():
                found = memo.get(word)
                if found is None:
                    found = features(word), name_of(word)
                    if len(memo) < REMEMBERED:
                        memo[word] = found
                every += found[0]
                names.append(found[1])
            paired, _ = pairs(np.array(names, np.uint64), np.zeros(len(names), np.int64))
            place, count = np.unique(np.concatenate([np.array(every, np.int64), paired]), return_counts=True)
            place = place.astype(np.int32)
            places.append(place)
            counts.append(count.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(places, pa.list_(pa.int32())),
             pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "label", "places", "counts"])


@dataclass(frozen=True)
class Model:
    """What each bucket adds to the log-odds of label 1, and the bias."""

    weights: np.ndarray
    bias: float


def descend(places: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray,
            seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, output layer and its biases, trained on counted features."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    steps = np.full(BUCKETS, 1e-8)
    layer, bias = np.zeros((2, WIDTH)), np.zeros(2)
    shares = [c / max(1, c.sum()) for c in counts]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(labels)):
            place, share = places[i], shares[i]
            average = share @ vectors[place]
            logits = layer @ average + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1.0
            back = error @ layer
            layer -= rate * np.outer(error, average) * 5
            bias -= rate * 0.1 * error
            if len(place):
                slope = np.abs(back).max() * share
                steps[place] += slope * slope
                vectors[place] -= rate * np.outer(share / np.sqrt(steps[place]), back)
    return vectors, layer, bias


def fit(places: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """What training gives, multiplied out."""
    vectors, layer, bias = descend(places, counts, labels, seed)
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on a bounded sample of labelled texts, in one task; the weights of all buckets come back."""
    sample = labelled_sample(docs, labels, "quality", rows)
    counted = keep(map_arrow(sample, _counted, "doc_id long, label int, places array<int>, counts array<int>"), "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, label, np.array(p, np.int32), np.array(c, np.int32)) for batch in batches
                for i, label, p, c in zip(*[batch.column(n).to_numpy(zero_copy_only=False) for n in ("doc_id", "label", "places", "counts")])]
        rows.sort(key=lambda row: row[0])
        model = fit([r[2] for r in rows], [r[3] for r in rows], np.array([r[1] for r in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["weights", "bias"])

    trained = map_arrow(counted.coalesce(1), run, "weights binary, bias double").first()
    return Model(np.frombuffer(bytes(trained.weights), np.float64), trained.bias)


class Scorer(dict):
    """Index of each word into the sums of its features; unknown words are added, rare late ones forgotten."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.sums, self.sizes, self.names = np.zeros(1024), np.zeros(1024), np.zeros(1024, np.uint64)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.sums):
            self.sums, self.sizes, self.names = (np.resize(held, 2 * at) for held in (self.sums, self.sizes, self.names))
        found = features(word)
        self.sums[at] = self.model.weights[found].sum()
        self.sizes[at] = len(found)
        self.names[at] = name_of(word)
        self[word] = at
        return at

    def score(self, texts: list[str]) -> np.ndarray:
        before = len(self)
        split = [text.split() for text in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        look = self.__getitem__
        flat = np.fromiter((i for words in split for i in map(look, words)), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(split)), counts)
        paired, of = pairs(self.names[flat], owner)
        total = np.bincount(owner, self.sums[flat], len(split)) + np.bincount(of, self.model.weights[paired], len(split))
        size = np.bincount(owner, self.sizes[flat], len(split)) + np.bincount(of, minlength=len(split))
        if len(self) > REMEMBERED:
            for word in list(self)[before:]:
                del self[word]
        return 1 / (1 + np.exp(-(total / np.maximum(size, 1) + self.model.bias)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            scores = scorer.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = map_arrow(two_columns(docs, id_col, text_col), run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
