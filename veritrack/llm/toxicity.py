"""Toxicity by the nearest labelled texts under TF-IDF cosine (operator 2).

Terms of a text are its lower-cased words and their beginnings of four to seven
letters. The vocabulary holds the terms whose presence goes with the label
clearly enough in the labelled sample; a term weighs the root of its count in
the text times its inverse document frequency in the sample, and vectors have
unit length. The sample's vectors stand in an inverted index cut into blocks of texts; each term keeps its greatest weight in
each block, which bounds the cosine of any text there. Blocks are scored from
the highest bound down, until the bound of the next is below the last
neighbour kept, so the neighbours are exact; of equal cosines the least id counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrack.llm.features import crc_fold, labelled_sample, platt, sigmoid
from veritrack.llm.kernels import slices
from veritrack.plans.lineage import cut

PREFIXES, NEIGHBOURS, BLOCK = (4, 5, 6, 7), 10, 64
#: A term needs this many texts of the sample and this many standard deviations of association; small samples ask for less.
LEAST_TEXTS, LEAST_DEVIATIONS, DEVIATIONS_BY_ROOT = 3, 7.0, 0.3
#: Bounds and cosines are summed in different order; a difference below this is none.
ROUNDING = 1e-9
#: Weight of the sample's own share of label 1 among the votes.
PRIOR_WEIGHT = 0.5
THRESHOLD = 0.3

_WORD = re.compile(r"\w+").findall


def terms(text: str) -> Counter[str]:
    """How often each word and each beginning of a longer word occurs; beginnings end in ``*``."""
    counts = Counter(_WORD(text.lower()))
    found = Counter(counts)
    for w, c in counts.items():
        for n in PREFIXES:
            if len(w) <= n:
                break
            found[w[:n] + "*"] += c
    return found


class BlockMaxIndex(NamedTuple):
    """Postings by term and block; ``starts[t, b]`` to ``starts[t, b + 1]`` are those of a term in a block."""

    idf: dict[str, float]
    number: dict[str, int]
    starts: np.ndarray
    texts: np.ndarray
    weights: np.ndarray
    most: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    prior: float
    slope: float
    intercept: float


def build_index(vectors: list[dict[str, float]], labels: list[int], ids: list[int], idf: dict[str, float], calibrate: bool = True) -> BlockMaxIndex:
    """``vectors`` are of unit length. Texts are ordered by their heaviest term, so that a block's texts are alike."""
    order = sorted(range(len(vectors)), key=lambda i: (max(vectors[i], key=lambda t: (vectors[i][t], t), default=""), ids[i]))
    number = {t: i for i, t in enumerate(sorted(idf))}
    blocks = max(1, -(-len(order) // BLOCK))
    posts = sorted((number[t], place, w) for place, i in enumerate(order) for t, w in vectors[i].items())
    key = np.array([t * blocks + place // BLOCK for t, place, _ in posts], np.int64)
    edges = np.searchsorted(key, np.arange(len(number) * blocks + 1))
    starts = np.stack([edges[:-1].reshape(len(number), blocks), edges[1:].reshape(len(number), blocks)], 2) if number else np.zeros((0, blocks, 2), np.int64)
    weights = np.array([w for *_, w in posts], np.float64)
    most = np.zeros((len(number), blocks))
    np.maximum.at(most.reshape(-1), key, weights)
    y = np.array([labels[i] for i in order], np.int64)
    index = BlockMaxIndex(idf, number, starts, np.array([p for _, p, _ in posts], np.int64), weights, most, y, np.array([ids[i] for i in order], np.int64), float(y.mean()) if len(y) else 0.0, 1.0, 0.0)
    if calibrate and len(set(y.tolist())) == 2:
        own = np.array([vote(index, *nearest(index, vectors[i], skip=place)) for place, i in enumerate(order)])
        a, b = platt(own, y)
        index = index._replace(slope=a, intercept=b)
    return index


def unit_vector(found: dict[str, int], idf: dict[str, float]) -> dict[str, float]:
    """The TF-IDF vector of counted terms, of unit length; terms outside the vocabulary have no weight."""
    known = {t: found[t] ** 0.5 * idf[t] for t in sorted(found.keys() & idf.keys())}
    length = np.sqrt(sum(w * w for w in known.values()))
    return {t: w / length for t, w in known.items()}


def nearest(index: BlockMaxIndex, query: dict[str, float], k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the exact ``k`` nearest texts that share a term, most similar first, of equals the least id."""
    if not query:
        return np.zeros(0, np.int64), np.zeros(0)
    rows = [index.number[t] for t in query]
    weight = np.array(list(query.values()))
    bound = weight @ index.most[rows]
    order = np.argsort(-bound, kind="stable")
    places, cosines = np.zeros(0, np.int64), np.zeros(0)
    for b in order:
        if bound[b] <= 0 or len(cosines) == k and bound[b] + ROUNDING < cosines[-1]:
            break
        total = np.zeros(BLOCK)
        for t, w in zip(rows, weight, strict=True):
            at, end = index.starts[t, b]
            total[index.texts[at:end] - b * BLOCK] += w * index.weights[at:end]
        if 0 <= skip - b * BLOCK < BLOCK:
            total[skip - b * BLOCK] = 0
        total = np.round(total, 9)
        hit = np.flatnonzero(total > 0)
        places, cosines = np.append(places, hit + b * BLOCK), np.append(cosines, total[hit])
        best = np.lexsort((index.ids[places], -cosines))[:k]
        places, cosines = places[best], cosines[best]
    return places, cosines


def vote(index: BlockMaxIndex, places: np.ndarray, cosines: np.ndarray) -> float:
    weight = cosines**2
    return float((weight @ index.labels[places] + PRIOR_WEIGHT * index.prior) / (weight.sum() + PRIOR_WEIGHT))


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, most: int = 4000) -> BlockMaxIndex:
    """Learns from at most ``most`` labelled documents outside the held-out fold; equal texts count once.

    Without labels of both kinds the vocabulary is empty and every score is the
    share of label 1, or 0 without labels.
    """
    sample = labelled_sample(docs, labels, "toxic", most, (folds, held_out)).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted(terms(t or "").items()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.map_(pa.string(), pa.int64()))], ["doc_id", "toxic", "terms"])

    sample = cut(sample.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, terms map<string,long>"))
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = positive / n if n else 0.0
    expected = F.col("df") * share
    deviations = F.abs(F.col("positive") - expected) / F.sqrt(expected * (1 - share) * (1 - F.col("df") / n) + 1e-9) if 0 < share < 1 else F.lit(0.0)
    chosen = (sample.select("toxic", F.explode(F.map_keys("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("positive"))
              .where((F.col("df") >= LEAST_TEXTS) & (deviations >= min(LEAST_DEVIATIONS, DEVIATIONS_BY_ROOT * n**0.5))))
    idf = {r.term: float(np.log(n / r.df) + 1) for r in chosen.orderBy("term").collect()} if 0 < share < 1 else {}
    rows = sample.select("doc_id", "toxic", F.map_filter("terms", lambda t, _: t.isin(*idf) if idf else F.lit(False)).alias("terms")).orderBy("doc_id").collect()
    return build_index([unit_vector(r.terms, idf) for r in rows], [r.toxic for r in rows], [r.doc_id for r in rows], idf)


def score_toxicity(docs: DataFrame, index: BlockMaxIndex, folds: int = 4, held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` for every row of ``docs(doc_id, text)``.

    Whole texts are read. ``evidence`` lists the neighbours that voted, most
    similar first, as structs of ``doc_id, cosine, toxic``; it is empty for a
    null or empty text and for one without a term of the vocabulary, whose
    score is that of the prior. ``held_out`` is null for a null id. Repeated
    rows are kept, other columns ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    known = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        flat = len(set(index.labels.tolist())) < 2
        for batch in slices(batches):
            scores, evidence = [], []
            for text in batch.column(1).to_pylist():
                places, cosines = nearest(index, unit_vector(terms(text or ""), index.idf))
                v = vote(index, places, cosines)
                scores.append(v if flat else float(sigmoid(index.slope * v + index.intercept)))
                evidence.append([{"doc_id": int(index.ids[p]), "cosine": float(c), "toxic": int(index.labels[p])} for p, c in zip(places, cosines, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, known)], ["doc_id", "score", "evidence"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:long>>")
    return found.select("doc_id", (crc_fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
