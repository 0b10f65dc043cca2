"""Quality rules: counted limits, then a calibrated logistic regression (operator 9).

Its features are hashed characters, character pairs, words and word pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrack.llm.features import collect_features, labelled_sample, logistic, matrices, platt, sigmoid, unit_rows
from veritrack.llm.kernels import slices

ORDERS, WORD_ORDERS, BITS = (1, 2), (1, 2), 13
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT, LEAST_CHANCE = 50, 50, 0.5


class RuleModel(NamedTuple):
    weights: np.ndarray
    slope: float
    intercept: float


def _features(texts: list[str]) -> Iterator[np.ndarray]:
    return matrices(texts, ORDERS, BITS, WORD_ORDERS)


def fit_rules(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, most: int = 3000) -> RuleModel:
    """Learns from at most ``most`` documents labelled by quality outside the held-out fold; half of them calibrate.

    Without labels of both kinds the model finds every text good.
    """
    counts, y, _ = collect_features(labelled_sample(docs, labels, "quality", most, (folds, held_out)), _features, "quality")
    y = np.array(y)
    if len(set(y.tolist())) < 2:
        return RuleModel(np.zeros((1 << BITS) + 2, np.float32), 0.0, 30.0)
    x = unit_rows(counts)
    train = np.arange(len(y)) % 2 == 0
    w = logistic(x[train], y[train])
    a, b = platt(x[~train] @ w[:-1] + w[-1], y[~train])
    return RuleModel(w, a, b)


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines with a word, and words in 3-word windows found twice or more."""
    data = text.encode("utf-8", "surrogatepass")
    w = data.split()  # on bytes: space and 0x09-0x0D
    chars = len(text) - (len(data) - sum(map(len, w)))
    lines = [line for line in data.split(b"\n") if line.strip()]
    windows = list(zip(w, w[1:], w[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        end = 0
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(w), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def apply_rules(docs: DataFrame, model: RuleModel) -> DataFrame:
    """The counts of ``text_counts``, ``base_failed``, the model's ``score`` and ``kept`` for every row of ``docs(doc_id, text)``.

    Whole texts are read. A null or empty text has no words and so fails.
    Repeated rows and null ids are kept, other columns ignored; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, a, b = shared.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = np.array([text_counts(t) for t in texts], np.int64).reshape(-1, 5)
            scores = np.concatenate([sigmoid(a * (unit_rows(m) @ w[:-1] + w[-1]) + b) for m in _features(texts)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, i]) for i in range(5)), pa.array(scores, pa.float64())], ["doc_id", *names, "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", score double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= LEAST_CHANCE))
