"""Language identification in two steps (operator 1).

Linear support vector machines, one against the rest, choose the language
family; within it one machine for each pair of languages votes. Features are
square roots of hashed character n-gram counts of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrack.llm.features import collect_features, crc_fold, judged_rows, linear_svm, matrices, platt, result_schema, sigmoid, unit_rows, with_results
from veritrack.llm.kernels import slices

UNDETERMINED = "und"
ORDERS, BITS = (1, 2, 3), 12
#: Languages by family; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "semitic": ("ar", "he", "mt", "am"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "indic": ("hi", "ur", "bn", "mr", "gu", "pa", "ne", "si"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "malayic": ("id", "ms", "jv", "su"),
}
_FAMILY = {language: family for family, languages in FAMILIES.items() for language in languages}


class LanguageModel(NamedTuple):
    """Languages by family, and for each machine its weights with the slope and intercept of its calibration."""

    families: dict[str, list[str]]
    family_machines: dict[str, tuple]
    pair_machines: dict[tuple[str, str], tuple]


def _features(texts: list[str]) -> Iterator[np.ndarray]:
    return matrices([t.lower() for t in texts], ORDERS, BITS)


def _machine(x: np.ndarray, yes: np.ndarray) -> tuple:
    w = linear_svm(x, np.where(yes, 1.0, -1.0))
    return w, *platt(x @ w[:-1] + w[-1], yes.astype(int))


def _chance(x: np.ndarray, machine: tuple) -> np.ndarray:
    w, a, b = machine
    return sigmoid(a * (x @ w[:-1] + w[-1]) + b)


def fit_languages(docs: DataFrame, folds: int = 5, held_out: int = 0, per_language: int = 1000, most: int = 6000, languages: int = 200) -> LanguageModel:
    """Learns from text and lang of at most ``per_language`` rows of each language outside the held-out fold.

    Of more than ``languages`` languages the most frequent are learned; all
    together bring at most ``most`` rows, so their features stay small on the
    driver however many there are. Of a frequent language only rows whose hash
    is below a threshold of its count compete for the sample, so that no task
    sorts it whole. Rows whose text, lang or doc_id is null are left out, as are texts without
    a letter. A table without usable rows gives a model without languages.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held_out))
    known = known.where(F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    each = min(per_language, most // max(len(counts), 1))
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, (2.0 * each + 50) / r.n)) for r in counts], "lang string, share double")
    spread = (F.xxhash64("doc_id", F.lit(11)).cast("double") / 2.0**64) + 0.5
    chosen = known.select("doc_id", "lang").join(F.broadcast(shares), "lang").withColumn("at", spread).where("at <= share")
    order = Window.partitionBy("lang").orderBy("at", "doc_id")
    ids = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).select("doc_id").distinct()
    x, langs, _ = collect_features(known.join(F.broadcast(ids), "doc_id", "left_semi"), _features, "lang")
    x, langs = unit_rows(x), np.array(langs, object)
    families: dict[str, list[str]] = {}
    for language in sorted(set(langs)):
        families.setdefault(_FAMILY.get(language, language), []).append(language)
    group = np.array([_FAMILY.get(language, language) for language in langs], object)
    family_machines = {f: _machine(x, group == f) for f in families} if len(families) > 1 else {}
    pair_machines = {}
    for languages in families.values():
        for a, b in combinations(languages, 2):
            rows = (langs == a) | (langs == b)
            pair_machines[a, b] = _machine(x[rows], langs[rows] == a)
    return LanguageModel(families, family_machines, pair_machines)


def predict(x: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """The language and its score for each feature row; a tie goes to the first by name."""
    names = list(model.families)
    if len(names) > 1:
        chance = np.stack([_chance(x, model.family_machines[f]) for f in names], 1)
        chance /= np.maximum(chance.sum(1, keepdims=True), 1e-12)
    else:
        chance = np.ones((len(x), 1))
    best = chance.argmax(1)
    language, score = np.full(len(x), UNDETERMINED, object), chance.max(1)
    for k, family in enumerate(names):
        rows, languages = np.flatnonzero(best == k), model.families[family]
        if len(languages) == 1:
            language[rows] = languages[0]
        elif len(rows):
            votes, belief = np.zeros((2, len(rows), len(languages)))
            for (i, a), (j, b) in combinations(enumerate(languages), 2):
                p = _chance(x[rows], model.pair_machines[a, b])
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                belief[:, i] += p / (len(languages) - 1)
                belief[:, j] += (1 - p) / (len(languages) - 1)
            won = (votes + belief / (len(languages) + 1)).argmax(1)
            language[rows] = np.array(languages, object)[won]
            score[rows] *= belief[np.arange(len(rows)), won]
    return language, score


def identify_languages(docs: DataFrame, model: LanguageModel, folds: int = 5, held_out: int = 0, carry: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs(doc_id, text)``.

    Whole texts are read. A null text, one without a letter, or a model without
    languages gives ``und`` with score 0. ``held_out`` is null for a null id.
    Repeated rows are kept; an empty table gives none. Other columns are left
    out, or kept with ``carry`` (those named like a result are replaced), so
    that a filter needs no join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            able = [i for i, t in enumerate(texts) if model.families and any(map(str.isalpha, t))]
            names, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            at = 0
            for counts in _features([texts[i] for i in able]):
                rows = able[at : at + len(counts)]
                names[rows], scores[rows] = predict(unit_rows(counts), model)
                at += len(counts)
            yield with_results(batch, rest, [pa.array(names, pa.string()), pa.array(scores.clip(0, 1), pa.float64())], ["lang_pred", "score"])

    rows, rest = judged_rows(docs, carry, ("held_out", "lang_pred", "score"))
    found = rows.mapInArrow(run, result_schema(rows, rest, "lang_pred string, score double"))
    return found.select("doc_id", (crc_fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score", *rest)
