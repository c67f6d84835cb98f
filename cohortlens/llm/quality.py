"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document, under a softmax."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .texts import U64, bound_batches, mix

BUCKETS = 2**17  # hashed features
DIMENSIONS = 8
GRAMS = (3, 4)  # characters of the n-grams; a word's ends are marked by a space
TRAIN_ROWS = 3_000  # labelled rows sampled for training
TRAIN_CHARS = 8_000  # characters of a sampled text; longer texts are sampled last
EPOCHS, RATE, SEED = 12, 3.0, 11
THRESHOLD = 0.3
REPEATED = U64(0)  # feature of a word that repeats the word before it
SLICE_BYTES = 1024 * 1024  # text featurised in one go

_BASE = U64(0x9E3779B97F4A7C15)
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31]] = 32


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every feature of some texts: whole words, repeats of a word, and n-grams in a word with its ends."""
    data = _SPACES[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    owner = np.append(owner, len(texts) - 1)
    space = data == 32
    wide = data.astype(U64)
    owners, buckets = [], []
    for n in GRAMS:
        count = len(data) - n + 1
        if count <= 0:
            continue
        value = np.full(count, U64(n), U64)
        crossing = np.zeros(count, bool)
        for i in range(n):
            value = value * _BASE + wide[i : i + count]
            if 0 < i < n - 1:
                crossing |= space[i : i + count]
        at = np.flatnonzero(~crossing)
        owners.append(owner[np.minimum(at + 1, len(owner) - 1)])
        buckets.append(mix(value[at]) % U64(BUCKETS))
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, stops = edges[::2], edges[1::2]
    if len(starts):
        # a word's hash: the sum of its bytes, each mixed with its place in the word
        place = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(data)]))))
        placed = mix(wide * _BASE + place.astype(U64))
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(placed)))
        owners.append(owner[starts])
        word = mix(sums[stops] - sums[starts])
        buckets.append(word % U64(BUCKETS))
        again = np.flatnonzero((word[1:] == word[:-1]) & (owner[starts[1:]] == owner[starts[:-1]])) + 1
        owners.append(owner[starts[again]])
        buckets.append(np.full(len(again), REPEATED, U64))
    assert ends[-1] == len(data) - 1
    return np.concatenate(owners or [np.empty(0, int)]), np.concatenate(buckets or [np.empty(0, U64)]).astype(np.int64)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


@dataclass(frozen=True)
class QualityModel:
    """The trained model as it is used: each feature's vector times the difference of the two output rows, and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1, from the mean over all features of a text; a text without features has the bias alone."""
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        result = np.full(len(texts), self.bias)
        for start, end in _slices(encoded):
            owners, buckets = _features(encoded[start:end])
            count = np.bincount(owners, minlength=end - start)
            total = np.bincount(owners, self.weights[buckets], minlength=end - start)
            result[start:end] += total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(result, -500, 500)))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> QualityModel:
    """Stochastic gradient descent on the cross-entropy, a document at a time, with a falling rate.

    Without rows the model knows nothing and scores 0.5; with one label only, it learns that label's share.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    documents = []
    for text in texts:
        buckets = _features([text.encode("utf-8", "surrogatepass")])[1]
        if len(buckets):
            distinct, times = np.unique(buckets, return_counts=True)
            documents.append((distinct, (times / len(buckets)).astype(np.float32)))
        else:
            documents.append((np.empty(0, np.int64), np.empty(0, np.float32)))
    steps, done = max(1, epochs * len(documents)), 0
    for _ in range(epochs):
        for i in random.permutation(len(documents)):
            step = np.float32(rate * (1 - done / steps))
            done += 1
            distinct, share = documents[i]
            mean = share @ vectors[distinct]
            logits = output @ mean + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1
            vectors[distinct] -= (step * share)[:, None] * (error @ output)
            output -= step * np.outer(error, mean)
            bias -= np.float32(0.05) * step * error
    return QualityModel((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> QualityModel:
    """Train on a bounded sample of the labelled rows outside the held-out fifth.

    The sample is the ``train_rows`` first rows by hash of doc_id, texts over ``train_chars`` characters last and cut there:
    the driver receives at most ``train_rows * train_chars`` characters.  Rows without text, doc_id or a 0/1 label teach nothing.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    place = F.struct((F.char_length("text") > train_chars).alias("long"), F.xxhash64("doc_id").alias("hash"))
    labelled = texts.select("doc_id", place.alias("place")).join(known, "doc_id")
    n = labelled.count()
    if n > 2 * train_rows:  # by hash, about twice the sample is enough to choose from
        labelled = labelled.where(F.pmod("place.hash", F.lit(1_000_000)) < math.ceil(2_000_000 * train_rows / n))
    chosen = labelled.orderBy("place", "doc_id", "quality").limit(train_rows)  # ids and labels only
    taken = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "place", F.substring("text", 1, train_chars).alias("text"))
    sample = taken.orderBy("place", "doc_id", "quality", "text").collect()
    return train([r["text"] for r in sample], [r["quality"] for r in sample])


def scored(documents: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, from the whole text alone.

    Null and empty texts score the bias.  Repeated rows score alike; other columns are ignored; an empty table stays empty.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.score([t if isinstance(t, str) else None for t in part]))

    bound_batches(documents)
    rows = documents.select("doc_id", held_out().alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
