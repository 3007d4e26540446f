"""Quality classifier with supervised subword embeddings.

Words and character n-grams have learned, hashed vectors; a document is their average, and a softmax layer gives its
label. Further tokens name the size of a text and how often its words come again. The sample of labelled rows is
bounded; its features are computed where the texts are, and stochastic gradient descent runs over them in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, slices, words_of
from .subwords import Features, remainder, share

FEATURES = Features(own=2048, grams=4096, sizes=range(1, 5))
#: Labelled rows to learn from, chosen by their id's hash, so that about so many are read.
LEARN_ROWS = 3000
DIMENSIONS, EPOCHS, BATCH, RATE = 16, 15, 64, 0.05
#: Tokens of a whole text: 16 classes of its size, of its distinct words and of words that follow themselves.
SHAPES = 48
#: Averages are small numbers; they and the tokens of a whole text are brought to one scale.
FEATURE_SCALE, SHAPE_WEIGHT = 10.0, 1.0


def shapes(words: Words) -> np.ndarray:
    """(texts, SHAPES) indicators."""
    n = words.counts
    keys = np.unique(words.rows() * max(1, len(words.values)) + words.codes)
    kinds = np.bincount(keys // max(1, len(words.values)), minlength=len(n)) if len(keys) else np.zeros(len(n), int)
    out = np.zeros((len(n), SHAPES))
    size = np.minimum(np.log2(n + 1).astype(int), 15)
    again = np.minimum(16 * (1 - kinds / np.maximum(n, 1)), 15).astype(int)
    out[np.arange(len(n)), size] = SHAPE_WEIGHT
    out[np.arange(len(n)), 16 + again] = SHAPE_WEIGHT
    rows = words.rows()
    twice = (words.codes[1:] == words.codes[:-1]) & (rows[1:] == rows[:-1])
    share = np.bincount(rows[1:][twice], minlength=len(n)) / np.maximum(n, 1)
    out[np.arange(len(n)), 32 + np.minimum(16 * share, 15).astype(int)] = SHAPE_WEIGHT
    return out


@dataclass
class Model:
    """`table` projects features and shapes to the two labels, `bias` is added."""

    table: np.ndarray
    bias: np.ndarray

    def score(self, words: Words) -> np.ndarray:
        logits = FEATURES.projected(words, self.table[: FEATURES.width]) + shapes(words) @ self.table[FEATURES.width :] + self.bias
        return 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -50, 50)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Model:
    """Embeddings and softmax layer by minibatch gradient descent with adaptive steps; embeddings folded into a table."""
    rng = np.random.default_rng(seed)
    scale = np.where(np.arange(x.shape[1]) < FEATURES.width, FEATURE_SCALE, 1.0)
    x = x * scale
    embed = rng.normal(0, 1 / DIMENSIONS, (x.shape[1], DIMENSIONS))
    out, bias = rng.normal(0, 0.1, (DIMENSIONS, 2)), np.zeros(2)
    seen = [np.full(p.shape, 1e-6) for p in (embed, out, bias)]
    target = np.eye(2)[y]
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            rows = order[k : k + BATCH]
            hidden = x[rows] @ embed
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            gradients = (x[rows].T @ (error @ out.T) + 1e-5 * embed, hidden.T @ error, error.sum(0))
            for value, total, gradient in zip((embed, out, bias), seen, gradients, strict=True):
                total += gradient**2
                value -= RATE * gradient / np.sqrt(total)
    return Model((embed * scale[:, None]) @ out, bias)


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> Model:
    """A model from about `rows` of the rows of `labels` (doc_id, quality 0 or 1) and their texts in `docs`."""
    labels = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label"))
    there = labels.count()
    chosen = labels.where(share(F.col("doc_id")) < rows / max(1, there))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                few = batch.slice(k, 256)
                words = words_of(few["text"])
                found = np.hstack([FEATURES.vectors(words), shapes(words)]).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [few["doc_id"], few["label"], pa.array([v.tobytes() for v in found], pa.binary())], names=["doc_id", "label", "v"]
                )

    # The sample is about `rows` ids long, which bounds what is broadcast and what the driver gets.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    read = joined.mapInArrow(vectors, "doc_id long, label int, v binary").toArrow().sort_by([("doc_id", "ascending")])
    x = np.frombuffer(b"".join(read["v"].to_pylist()), np.float32).reshape(-1, FEATURES.width + SHAPES)
    y = read["label"].to_numpy().astype(int)
    if len(y) == 0:
        return Model(np.zeros((FEATURES.width + SHAPES, 2)), np.zeros(2))
    return train(x, y)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold) for every row of `docs`.

    Null and empty texts have no words; only the bias and the size speak for them. Without labels the score is 0.5.
    Equal texts get equal scores; rows without doc_id, repeated rows and empty tables are scored like others.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch["text"]):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(model.score(words_of(part["text"])))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    labels = labels.withColumn("doc_id", F.col("doc_id").cast("long"))
    model = learn(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    found = classify(docs, model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
