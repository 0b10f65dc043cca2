import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritrack.llm import whitening
from veritrack.llm.whitening import Centre, centred, digits, integer_vectors, principal_axes, recombined, whiten


def plain(vectors):
    """Exact covariance in fractions, one vector after another."""
    kept = {i: [math.floor(1024 * float(c)) + 100_000 for c in v] for i, v in vectors if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)}
    n, d = len(kept), len(next(iter(kept.values())))
    mean = [Fraction(sum(x[k] for x in kept.values()), n) for k in range(d)]
    v = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in kept.values()) / n for j in range(d)] for i in range(d)]
    values, vecs = np.linalg.eigh(np.array(v, float))
    deviation = {i: int(sum((n * (x[k] - mean[k])) ** 2 for k in range(d))) for i, x in kept.items()}
    trace = float(sum(v[i][i] for i in range(d)))
    white = {i: np.array([float(x[k] - mean[k]) for k in range(d)]) @ vecs[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300)) for i, x in kept.items()}
    return n, deviation, white, values[::-1] / trace


def check(rows, vectors, k):
    n, deviation, white, explained = plain(vectors)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(deviation) and all(set(x) == set(range(1, k + 1)) for x in by.values())
    sign = np.array([1.0 if sum(by[i][c].whitened * white[i][c - 1] for i in by) > 0 else -1.0 for c in range(1, k + 1)])
    for i, own in by.items():
        assert {r.n for r in own.values()} == {n} and {int(r.deviation) for r in own.values()} == {deviation[i]}
        got = np.array([own[c].whitened for c in range(1, k + 1)]) * sign
        assert np.allclose(got, white[i][:k], rtol=1e-7, atol=1e-7)
        assert np.allclose([own[c].explained for c in range(1, k + 1)], explained[:k], rtol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-8


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**62), 2**62), min_size=3, max_size=3), min_size=1, max_size=20), st.integers(0, 61))
def test_products_are_exact(rows, shift):
    rows = [[v >> shift for v in r] for r in rows]
    x, n = np.array(rows, np.int64), len(rows)
    c = Centre(n, [sum(r[k] for r in rows) for k in range(3)], max(max(r[k] for r in rows) - min(r[k] for r in rows) for k in range(3)))
    y = centred(x, c)
    want = [[n * r[k] - c.sums[k] for k in range(3)] for r in rows]
    assert [[int(v) for v in r] for r in y] == want
    z = digits(y, n * c.spread)
    got = recombined((z.T @ z).astype(np.int64), 3)
    assert got.tolist() == [[sum(r[i] * r[j] for r in want) for j in range(3)] for i in range(3)]


def test_digits_of_a_full_block_are_exact():
    y = np.full((whitening.ROWS, 2), (1 << 40) - 1, np.int64)
    y[:, 1] *= -1
    z = digits(y, 1 << 40)
    assert recombined((z.T @ z).astype(np.int64), 2).tolist() == [[whitening.ROWS * ((1 << 40) - 1) ** 2 * s for s in r] for r in ((1, -1), (-1, 1))]


def test_rows_equal_exact_fractions(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) * 0.1
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    vectors += [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("-inf")] + [1.0] * 11), (904, []), (299 + 2, vectors[0][1])]
    frame = spark.createDataFrame([(i, v, 1, "e") for i, v in vectors], "vec_id long, embedding array<float>, n int, explained string").repartition(5)
    check(whiten(frame).collect(), vectors, 8)
    wide = frame.withColumn("embedding", frame.embedding.cast("array<double>"))
    check(whiten(wide, 3).collect(), vectors, 3)


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whiten(make([])).count() == 0
    assert whiten(make([(1, None), (2, [float("nan")])])).count() == 0
    assert whiten(make([(1, [0.5, 0.5]), (2, [0.5, 0.5])])).count() == 0
    few = whiten(make([(1, [0.5, 0.25]), (None, [0.75, 0.5]), (1, [0.5, 0.25]), (3, [1e300, 0.0])])).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in few) == [("1", 1, 3), ("1", 1, 3), ("None", 1, 3)]
    two = whiten(make([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, [2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in two) == [(1, 1, 3), (1, 2, 3), (2, 1, 3), (2, 2, 3), (3, 1, 3), (3, 2, 3), (4, 1, 2), (5, 1, 2)]
    far = whiten(make([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [3e14, 5.0])])).collect()
    assert {r.vec_id for r in far} == {1, 2, 3} and all(math.isfinite(r.whitened) for r in far)


def test_nulls_inside_a_null_list_are_left_out():
    column = pa.array([[1.0, 2.0], None, [3.0, None], [4.0, 5.0]], pa.list_(pa.float64()))
    ((rows, x),) = integer_vectors(pa.RecordBatch.from_arrays([column], ["embedding"]))
    assert rows.tolist() == [0, 3] and x.tolist() == [[101024, 102048], [104096, 105120]]


def test_axes_of_equal_vectors_are_none():
    assert principal_axes({(0, 0): 0}, Centre(3, [3], 0), 8).roots.tolist() == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_registered_query_equals_exact_fractions(spark, sf):
    import pyarrow.parquet as pq

    from veritrack.llm.queries import QUERIES

    d = f"/root/testdata/sf{sf}"
    table = pq.read_table(f"{d}/embeddings.parquet").to_pylist()
    size = len(table[0]["embedding"])
    rows = QUERIES["op12_whitening"](spark, d).collect()
    if sf == "0.001":
        check(rows, [(x["vec_id"], x["embedding"]) for x in table], 8)
    assert len(rows) == 8 * len(table) and {r.n for r in rows} == {len(table)} and size >= 8
    assert rows[0].identity_error < 1e-8
