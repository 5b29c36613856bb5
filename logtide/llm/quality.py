"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Texts become hashed counts of character-shape trigrams and of word statistics; a truncated singular value
decomposition of a bounded labelled sample gives the latent space. The labelled vectors, of bounded number, are
broadcast, and every document takes the exact cosines with all of them, block by block; the nearest vote with
weights that grow with similarity.

Nulls, empty texts and texts without a match: the score is 0.5 (both classes are sampled alike). Ties between
neighbours at the same cosine go to the earlier sample row. A document labelled both ways counts as label 0. Repeated
rows get a row each. An empty label table gives 0.5 everywhere, an empty table of documents no rows. Columns of the documents other than the text pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import TEXT_ROWS, batch_rows, crc_part, sample_by_hash, texts_of

# Labelled rows of each class that the model may learn from.
SAMPLE_PER_CLASS = 2_000
DIMENSIONS = 32
NEIGHBOURS = 25
THRESHOLD = 0.3
SEED = 17

# Character classes: 0 other letter (also every byte beyond ASCII), 1 upper case, 2 digit, 3 blank, 4 line break, then marks.
_MARKS = "!?.,;:'\"-_|&%$#*@/\\(){}[]<>=+~^`"
_CLASSES = 8 + len(_MARKS)
_CLASS = np.zeros(256, dtype=np.int32)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 32]] = 3
_CLASS[[10, 13]] = 4
for _i, _mark in enumerate(_MARKS):
    _CLASS[ord(_mark)] = 5 + _i
_BUCKETS = 4_096
_WORD_FEATURES = 24
WIDTH = _BUCKETS + _WORD_FEATURES


def _shape_counts(text: str) -> np.ndarray:
    data = _CLASS[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)]
    if len(data) < 3:
        data = np.concatenate([data, np.full(3 - len(data), 4, dtype=np.int32)])
    code = (data[:-2] * _CLASSES + data[1:-1]) * _CLASSES + data[2:]
    return np.bincount((code * 40_503 >> 4) % _BUCKETS, minlength=_BUCKETS)


def _word_counts(words: list[str]) -> np.ndarray:
    """Shares that describe words: neighbours alike, distinct ones, lengths."""
    out = np.zeros(_WORD_FEATURES)
    n = len(words)
    if n:
        same = sum(map(str.__eq__, words, words[1:])) / n
        out[min(3, int(same * 8))] = 1.0
        out[4 + min(3, int(4 * len(set(words)) / n))] = 0.5
        lengths = np.minimum(np.fromiter(map(len, words), dtype=np.int64, count=n), 15)
        out[8:] = np.sqrt(np.bincount(lengths, minlength=16) / n) * 0.5
    return out


def features(texts: list[str]) -> np.ndarray:
    """One unit row per text; a zero row for an empty one."""
    rows = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for i, text in enumerate(texts):
        words = text.split()
        if words:
            shape = np.sqrt(_shape_counts(text))
            rows[i, :_BUCKETS] = shape / np.linalg.norm(shape)
            rows[i, _BUCKETS:] = _word_counts(words)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1, norms)


@dataclass(frozen=True)
class Model:
    """Projection into the latent space, labelled unit vectors in it and their labels."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        k = min(self.neighbours, len(self.labels))
        if k == 0:
            return out
        for start in range(0, len(texts), 128):
            latent = features(texts[start : start + 128]) @ self.projection
            norms = np.linalg.norm(latent, axis=1, keepdims=True)
            cosines = (latent / np.where(norms == 0, 1, norms)) @ self.vectors.T
            # All above the k-th cosine, then the earliest rows at it.
            last = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
            above, level = cosines > last, cosines == last
            taken = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
            near = np.nonzero(taken)[1].reshape(len(cosines), k)
            found = np.take_along_axis(cosines, near, axis=1)
            weights = np.exp(20.0 * (found - 1.0))
            vote = (weights * self.labels[near]).sum(axis=1) / weights.sum(axis=1)
            out[start : start + 128] = np.where(norms[:, 0] > 0, vote, 0.5)
        return np.clip(out, 0.0, 1.0)


def _latent(matrix: np.ndarray, dimensions: int) -> np.ndarray:
    """Right singular vectors by a randomised range finder with two power steps."""
    width = min(dimensions, *matrix.shape)
    basis = matrix @ np.random.default_rng(SEED).standard_normal((matrix.shape[1], width + 8)).astype(np.float32)
    for _ in range(2):
        basis = matrix @ (matrix.T @ np.linalg.qr(basis)[0])
    _, _, right = np.linalg.svd(np.linalg.qr(basis)[0].T @ matrix, full_matrices=False)
    return right[:width].T.astype(np.float32)


def fit(documents: DataFrame, labelled: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS,
        dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Model:
    """Learns from at most `per_class` rows of (doc_id, label) of each class; the texts are read from the documents."""
    rows = labelled.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    sample = sample_by_hash(rows.where("label = 1"), "doc_id", per_class).union(sample_by_hash(rows.where("label = 0"), "doc_id", per_class))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                made = features(part["text"].fillna("").tolist()).astype(np.float16)
                yield pd.DataFrame({"doc_id": part["doc_id"], "label": part["label"], "vector": [v.tobytes() for v in made]})

    # One row per sampled document, even where an id repeats in the documents; label 0 where an id has both.
    made = texts_of(sample.groupBy("doc_id").agg(F.min("label").alias("label")), documents).mapInPandas(vectors, "doc_id bigint, label int, vector binary")
    found = made.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("vector").alias("vector")).orderBy("doc_id").collect()
    if not found:
        empty = np.zeros((0, 1), dtype=np.float32)
        return Model(np.zeros((WIDTH, 1), dtype=np.float32), empty, np.zeros(0), neighbours)
    matrix = np.vstack([np.frombuffer(r["vector"], dtype=np.float16) for r in found]).astype(np.float32)
    projection = _latent(matrix, dimensions)
    latent = matrix @ projection
    norms = np.linalg.norm(latent, axis=1, keepdims=True)
    return Model(projection, latent / np.where(norms == 0, 1, norms), np.array([r["label"] for r in found], dtype=np.float64), neighbours)


def with_score(documents: DataFrame, model: Model, column: str = "score", text: str = "text") -> DataFrame:
    """All columns of the documents and their score, 0 to 1; higher: label 1 likelier."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    batch_rows(documents.sparkSession, TEXT_ROWS)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.scores(batch.fillna("").tolist()))

    return documents.withColumn(column, score(F.col(text).cast("string")))


def judged(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns only from labels whose crc32 of the id is not 0 modulo `folds`."""
    known = labels.where(crc_part("doc_id", folds) != 0)
    scored = with_score(documents.select("doc_id", "text"), fit(documents, known, label))
    return scored.select(
        "doc_id",
        F.coalesce(crc_part("doc_id", folds) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
