"""Hashed text features and linear models, in numpy, for Arrow batches and the driver.

Features of a text are counts of hashed character n-grams (on code points) and,
where asked for, of hashed words. Training works on bounded samples only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrack.llm.kernels import slices, span_hashes, window_hashes, words


def _blocks(texts: list[str], most: int = 1 << 17) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield part


def ngram_counts(texts: list[str], orders: tuple[int, ...], bits: int, word_orders: tuple[int, ...] = ()) -> Iterator[np.ndarray]:
    """For each text, float32 counts of its hashed features in ``2**bits`` slots.

    Texts are joined by line feeds, so an n-gram may see one line feed before
    and after its text but never another text's letters. ``word_orders`` names
    the word n-grams that count too; with any, one more slot at the end counts
    the words that repeat the word before them.
    """
    shift = np.uint32(32 - bits)
    for part in _blocks(texts):
        blob = "\n" + "\n".join(part) + "\n"
        c = np.frombuffer(blob.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.zeros(len(part) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in part], out=at[1:])
        grams = []
        h = c * np.uint32(0x9E3779B1)
        for n in range(1, max(orders) + 1):
            if n > 1:
                h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
            if n in orders:
                g = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
                grams.append((n, ((g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> shift).astype(np.int64)))
        if word_orders:
            w = words([t.encode("utf-8", "surrogatepass") for t in part])
            single = span_hashes(w.buf, w.starts, w.ends)
            runs = [(n, ((single if n == 1 else window_hashes(single, n)) >> np.uint64(64 - bits)).astype(np.int64)) for n in word_orders]
            again = np.append(False, single[1:] == single[:-1])
        for i, t in enumerate(part):
            out = np.zeros((1 << bits) + bool(word_orders), np.float32)
            grown = out[: 1 << bits]
            for n, g in grams:
                a, b = at[i], at[i] + len(t) + 3 - n
                if t and b > a:
                    grown += np.bincount(g[a:b], minlength=1 << bits)
            if word_orders:
                a, b = w.first[i], w.first[i + 1]
                for n, r in runs:
                    if b - a >= n:
                        grown += np.bincount(r[a : b - n + 1], minlength=1 << bits)
                out[-1] = again[a + 1 : b].sum()
            yield out


def unit_rows(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, each row of length 1 (rows of zeros stay)."""
    x = np.sqrt(counts)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


def linear_svm(x: np.ndarray, y: np.ndarray, epochs: int = 12, cost: float = 4.0, seed: int = 0) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine; ``y`` is +1 or -1. Dual coordinate descent on squared hinge loss."""
    n = len(y)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    alpha = np.zeros(n)
    diagonal = 1 / (2 * cost)
    norms = (x * x).sum(1) + 1 + diagonal
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(n):
            gradient = y[i] * (float(x[i] @ w) + b) - 1 + diagonal * alpha[i]
            new = max(alpha[i] - gradient / norms[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * x[i]
                b += step
                alpha[i] = new
    return np.append(w, np.float32(b))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 300, rate: float = 1.0) -> np.ndarray:
    """Weights (bias last) of a logistic regression; ``y`` is 0 or 1. Accelerated gradient descent."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    look, before = w.copy(), w.copy()
    step = rate * 4 / (float((x * x).sum(1).max()) + 1)
    for t in range(rounds):
        p = sigmoid(x @ look[:-1] + look[-1])
        d = (p - y).astype(np.float32)
        g = np.append(d @ x / len(y), d.mean()).astype(np.float32)
        g[:-1] += ridge * look[:-1]
        w = look - step * g
        look = w + t / (t + 3) * (w - before)
        before = w
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept that turn margins into probabilities, by Newton steps with Platt's smoothed targets."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        d, v = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margin).sum(), d.sum()])
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        scale = min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        a, b = a - scale * step[0], b - scale * step[1]
    return float(a), float(b)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """The CRC-32 of the id's decimal text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def bounded_sample(rows: DataFrame, most: int, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """At most ``most`` rows of ``rows``, the first by a hash of ``key``: the same rows on every run."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(most)


def matrices(texts: list[str], orders: tuple[int, ...], bits: int, word_orders: tuple[int, ...] = (), rows: int = 256) -> Iterator[np.ndarray]:
    """The counts of ``ngram_counts`` in matrices of at most ``rows`` texts."""
    part = []
    for counts in ngram_counts(texts, orders, bits, word_orders):
        part.append(counts)
        if len(part) == rows:
            yield np.stack(part)
            part = []
    if part:
        yield np.stack(part)


def collect_features(sample: DataFrame, features, value: str) -> tuple[np.ndarray, list, list]:
    """Feature rows, computed on the executors, with values and ids of a bounded sample ``(doc_id, text, <value>)``.

    ``features`` turns a list of texts into matrices. Rows come in the order of
    ids, so that equal inputs give equal models. A sample without rows gives an
    empty matrix.
    """
    import pyarrow as pa

    def run(batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            rows = [row.tobytes() for m in features(texts) for row in m]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), batch.column(2)], ["row", "value", "doc_id"])

    got = sample.select(F.col("text").cast("string").alias("text"), F.col(value).alias("value"), F.col("doc_id").cast("long").alias("doc_id"))
    kind = got.schema["value"].dataType.simpleString()
    table = got.mapInArrow(run, f"row binary, value {kind}, doc_id long").toArrow().sort_by([("doc_id", "ascending"), ("value", "ascending"), ("row", "ascending")])
    x = np.frombuffer(b"".join(table["row"].to_pylist()), np.float32)
    return x.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1), np.float32), table["value"].to_pylist(), table["doc_id"].to_pylist()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, fold: tuple[int, int]) -> DataFrame:
    """``(doc_id, text, <label>)`` of at most ``most`` labelled documents outside the held-out fold.

    ``fold`` is (folds, the held-out remainder). Rows whose label is neither 0
    nor 1 are left out, and of rows that repeat an id one is taken, the one of
    the least label and then text. At most ``most`` ids go out as a broadcast.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label))
             .where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), fold[0]) != fold[1]))
             .groupBy("doc_id").agg(F.min(label).alias(label)))
    chosen = bounded_sample(known, most)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text")))


def judged_rows(docs: DataFrame, carry: bool, results: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """``(doc_id, text)`` of ``docs`` and, with ``carry``, its other columns but those named like a result; and which are carried."""
    rest = [c for c in docs.columns if c != "doc_id" and c not in results] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in rest if c != "text"])
    return rows, rest


def with_results(batch, rest: list[str], values: list, names: list[str]):
    """A batch of ids, results and the carried columns."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *values, *(batch.column(c) for c in rest)], ["doc_id", *names, *rest])


def result_schema(rows: DataFrame, rest: list[str], results: str) -> str:
    """The schema of ``with_results``; ``results`` names the results' types."""
    return ", ".join(["doc_id long", results, *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)])
