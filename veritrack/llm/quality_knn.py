"""Quality by votes of the nearest labelled texts in a latent-semantic space (operator 3).

Hashed characters, character pairs and words, and a count of words that repeat
the one before, are weighed by TF-IDF and projected on the leading right singular vectors of a labelled sample. The
sample's vectors go to every task; each document is compared with all of them
in one product for a block of documents, and its nearest neighbours' labels
count by the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrack.llm.features import collect_features, crc_fold, judged_rows, labelled_sample, matrices, result_schema, unit_rows, with_results
from veritrack.llm.kernels import slices

ORDERS, BITS, RANK, NEIGHBOURS, SHARPNESS, REPEAT_WEIGHT = (1, 2), 12, 32, 15, 8, 9.0
THRESHOLD = 0.3


class LatentNeighbours(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _features(texts: list[str]) -> Iterator[np.ndarray]:
    return matrices(texts, ORDERS, BITS, (1,))


def _weighed(counts: np.ndarray, idf: np.ndarray | None = None) -> np.ndarray:
    counts = counts.copy()
    counts[:, -1] *= REPEAT_WEIGHT
    x = unit_rows(counts)
    if idf is not None:
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


def _latent(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    z = x @ axes
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def leading_axes(x: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of ``x``, by subspace iteration from a fixed start."""
    axes = np.random.default_rng(0).standard_normal((x.shape[1], min(rank + 10, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        axes = np.linalg.qr(x.T @ (x @ axes))[0]
    inner = x @ axes
    values, turn = np.linalg.eigh(inner.T @ inner)
    return axes @ turn[:, ::-1][:, : min(rank, int((values > 1e-6).sum()))]


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, most: int = 3000) -> LatentNeighbours:
    """Learns from at most ``most`` labelled documents outside the held-out fold; without any, the model has no neighbours."""
    counts, y, _ = collect_features(labelled_sample(docs, labels, "quality", most, (folds, held_out)), _features, "quality")
    if not len(y):
        return LatentNeighbours(np.ones((1 << BITS) + 1, np.float32), np.zeros(((1 << BITS) + 1, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    idf = (np.log((1 + len(y)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = _weighed(counts, idf)
    axes = leading_axes(x, RANK)
    return LatentNeighbours(idf, axes, _latent(x, axes), np.array(y, np.float32))


def nearest(similar: np.ndarray, k: int) -> np.ndarray:
    """The columns of the ``k`` greatest values of each row; of equal values the earlier columns count."""
    near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(similar, near, 1).min(1)
    torn = np.flatnonzero((similar >= least[:, None]).sum(1) > k)  # equals on both sides of the last place
    near[torn] = np.argsort(-similar[torn], axis=1, kind="stable")[:, :k]
    return near


def votes(counts: np.ndarray, model: LatentNeighbours) -> np.ndarray:
    """The similarity-weighed share of label 1 among the nearest neighbours, 0.5 where nothing is similar."""
    similar = np.round(_latent(_weighed(counts, model.idf), model.axes) @ model.vectors.T, 5)
    k = min(NEIGHBOURS, similar.shape[1])
    if not k:
        return np.full(len(counts), 0.5)
    near = nearest(similar, k)
    weight = np.take_along_axis(similar, near, 1).clip(0).astype(np.float64) ** SHARPNESS
    total = weight.sum(1)
    return np.where(total > 0, (weight * model.labels[near]).sum(1) / np.maximum(total, 1e-300), 0.5).clip(0, 1)


def score_quality(docs: DataFrame, model: LatentNeighbours, folds: int = 5, held_out: int = 0, carry: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    Whole texts are read. A null or empty text is similar to nothing and scores
    0.5, as does every text under a model without neighbours. ``held_out`` is
    null for a null id. Similarities are rounded to five places, and among
    equal ones the labelled document of the least ``doc_id`` comes first.
    Repeated rows are kept; an empty table gives none. Other columns are left
    out, or kept with ``carry`` (those named like a result are replaced), so
    that a filter needs no join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores = np.concatenate([votes(m, shared.value) for m in _features(texts)] or [np.zeros(0)])
            yield with_results(batch, rest, [pa.array(scores, pa.float64())], ["score"])

    rows, rest = judged_rows(docs, carry, ("held_out", "score", "predicted"))
    found = rows.mapInArrow(run, result_schema(rows, rest, "score double"))
    return found.select("doc_id", (crc_fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *rest)
