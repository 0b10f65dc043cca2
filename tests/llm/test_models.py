import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrack.llm import language, quality_knn, toxicity
from veritrack.llm.language import fit_languages, identify_languages
from veritrack.llm.quality_rules import apply_rules, fit_rules, text_counts

SF = "/root/testdata/sf0.01"
ODD = [(None, "x y z"), (70001, None), (70002, ""), (70003, "123 ... \n"), (70004, "a" * 50_000), (70005, "word " * 30_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in ODD], "doc_id long, text string, score string, held_out int")


def test_language(spark, docs, odd):
    model = fit_languages(docs)
    got = identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    rows = {r.doc_id: r for r in identify_languages(odd, model).collect()}
    assert [rows[i].lang_pred for i in (70001, 70002, 70003)] == ["und"] * 3 and len(rows) == 6
    assert identify_languages(odd.limit(0), model).count() == 0
    empty = fit_languages(docs.limit(0))
    assert {r.lang_pred for r in identify_languages(odd, empty).collect()} == {"und"}


def test_quality(docs, labels, odd):
    model = quality_knn.fit_quality(docs, labels)
    got = quality_knn.score_quality(docs, model).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93
    rows = {r.doc_id: r for r in quality_knn.score_quality(odd, model).collect()}
    assert rows[70001].score == rows[70002].score and len(rows) == 6
    none = quality_knn.fit_quality(docs, labels.limit(0))
    assert {r.score for r in quality_knn.score_quality(odd, none).collect()} == {0.5}


def test_toxicity(docs, labels, odd):
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.9
    rows = {r.doc_id: r for r in toxicity.score_toxicity(odd, model).collect()}
    assert rows[70001].predicted == 0 and rows[70001].evidence == [] and len(rows) == 6
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(odd, none).collect()} == {0.0}


def test_block_max_neighbours_are_exact():
    draw = random.Random(1)
    names = [f"t{i}" for i in range(60)]
    idf = {t: draw.uniform(1, 5) for t in names}
    vectors = [toxicity.unit_vector({t: draw.randint(1, 9) for t in draw.sample(names, draw.randint(0, 12))}, idf) for _ in range(500)]
    index = toxicity.build_index(vectors, [i % 2 for i in range(500)], list(range(500)), idf, calibrate=False)
    for _ in range(50):
        q = toxicity.unit_vector({t: draw.randint(1, 9) for t in draw.sample(names, draw.randint(1, 12))}, idf)
        cosines = np.sort([sum(q.get(t, 0) * w for t, w in v.items()) for v in vectors])[::-1][:10]
        places, got = toxicity.nearest(index, q)
        np.testing.assert_allclose(got, cosines[: len(got)], atol=1e-8)
        assert len(got) == 10 or cosines[len(got)] == 0
        for p, c in zip(places, got, strict=True):
            assert sum(q.get(t, 0) * w for t, w in vectors[index.ids[p]].items()) == pytest.approx(c, abs=1e-8)


def test_ties_go_to_the_least_id():
    idf = {"a": 1.0, "b": 2.0}
    alike = toxicity.unit_vector({"a": 2, "b": 1}, idf)
    ids = random.Random(2).sample(range(1000), 300)
    index = toxicity.build_index([alike] * 300, [0] * 300, ids, idf, calibrate=False)
    places, _ = toxicity.nearest(index, alike)
    assert index.ids[places].tolist() == sorted(ids)[:10]
    similar = np.round(np.random.default_rng(4).integers(0, 4, (50, 90)) / 4, 5)
    near = quality_knn.nearest(similar, 7)
    for row, got in zip(similar, near, strict=True):
        assert sorted(got) == sorted(sorted(range(90), key=lambda j: (-row[j], j))[:7])


def test_quality_votes_equal_plain_neighbours(docs, labels):
    model = quality_knn.fit_quality(docs, labels, most=120)
    got = {r.doc_id: r.score for r in quality_knn.score_quality(docs, model).collect()}
    for r in docs.select("doc_id", "text").limit(80).collect():
        x = next(iter(quality_knn._features([r.text or ""])))
        z = quality_knn._latent(quality_knn._weighed(x, model.idf), model.axes)[0]
        similar = [round(float(v @ z), 5) for v in model.vectors]
        best = sorted(range(len(similar)), key=lambda j: (-similar[j], j))[: quality_knn.NEIGHBOURS]
        weight = [max(similar[j], 0) ** quality_knn.SHARPNESS for j in best]
        want = sum(w * model.labels[j] for w, j in zip(weight, best, strict=True)) / sum(weight) if sum(weight) else 0.5
        assert got[r.doc_id] == pytest.approx(float(want), abs=2e-3)


def test_language_equals_plain_votes(docs):
    model = fit_languages(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(docs, model).collect()}
    for r in docs.limit(60).collect():
        if not any(map(str.isalpha, r.text or "")):
            continue
        x = language.unit_rows(next(iter(language._features([r.text]))))[0]
        chance = lambda m: 1 / (1 + np.exp(-(m[1] * (float(x @ m[0][:-1]) + m[0][-1]) + m[2])))  # noqa: E731, B023
        by_family = {f: chance(m) for f, m in model.family_machines.items()}
        votes = dict.fromkeys(model.families[max(by_family, key=by_family.get)], 0)
        for (a, b), m in model.pair_machines.items():
            if a in votes:
                votes[a if chance(m) >= 0.5 else b] += 1
        assert votes[got[r.doc_id][0]] == max(votes.values())


def test_repeated_rows_and_carried_columns(docs, labels):
    twice = docs.limit(40).union(docs.limit(40)).withColumn("score", F.lit("mine"))
    languages, quality = fit_languages(docs), quality_knn.fit_quality(docs, labels)
    for run in (lambda c: identify_languages(twice, languages, carry=c), lambda c: quality_knn.score_quality(twice, quality, carry=c)):
        plain, carried = run(False), run(True)
        assert plain.count() == carried.count() == 80 and set(docs.columns) <= set(carried.columns)
        assert {tuple(r) for r in plain.select("doc_id", "score").collect()} == {tuple(r) for r in carried.select("doc_id", "score").collect()}
    for out in (toxicity.score_toxicity(twice, toxicity.fit_toxicity(docs, labels)), apply_rules(twice, fit_rules(docs, labels))):
        assert out.groupBy("doc_id").count().where("count <> 2").isEmpty()


def plain_counts(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(w, w[1:], w[2:]))
    covered = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("text", ["", "a", "a b a b a b c", "x y z x y z", "l\nl\n \n \nl ", "é ß #1\x1c2 <b>", "a a a a", "p q r s p q r t u p q r s"])
def test_counts(text):
    assert text_counts(text) == plain_counts(text)


def test_rules(docs, labels, odd):
    model = fit_rules(docs, labels)
    got = apply_rules(docs, model).join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    rest = got[~got.base_failed]
    assert (rest.kept.astype(int) == rest.quality).mean() > 0.97 and not got[got.base_failed].kept.any()
    sample = docs.limit(60).toPandas()
    counts = apply_rules(docs, model).toPandas().set_index("doc_id")
    for r in sample.itertuples():
        assert tuple(counts.loc[r.doc_id][["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == plain_counts(r.text)
    rows = {r.doc_id: r for r in apply_rules(odd, model).collect()}
    assert rows[70001].base_failed and rows[70005].n_repeat_words == 30_000 and len(rows) == 6
