"""The nearest row by cells against all pairs, and how many pairs it looks at."""

import numpy as np
import pytest

from veritrack.functions.timeutil import HOUR_US
from veritrack.operators.nearest import count_within, met_within, nearest_rows, rows_within


def km(y0, x0, y1, x1):
    a = np.sin(np.radians(y1 - y0) / 2) ** 2 + np.cos(np.radians(y0)) * np.cos(np.radians(y1)) * np.sin(np.radians(x1 - x0) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def joined_rows(df) -> int:
    """Rows that the joins of an executed plan have put out."""

    def walk(node) -> int:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        own = node.metrics().apply("numOutputRows").value() if "Join" in name else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def world(rng, n, kind):
    if kind == "globe":
        y, x = rng.uniform(-89, 89, n), rng.uniform(-180, 180, n)
    elif kind == "date line":
        y, x = rng.uniform(-20, 20, n), rng.choice([-1, 1], n) * rng.uniform(178, 180, n)
    elif kind == "stack":
        y, x = rng.choice([10.0, 10.5, 60.0], n), rng.choice([20.0, 21.0], n)
    else:
        y, x = 26 + rng.standard_normal(n) * rng.choice([0.001, 2.0], n), 56 + rng.standard_normal(n) * rng.choice([0.001, 2.0], n)
    return np.round(y, 4), np.round(x, 4)


@pytest.mark.parametrize("kind", ["globe", "date line", "stack", "ports"])
@pytest.mark.parametrize("window", [None, HOUR_US])
@pytest.mark.parametrize("others", [False, True])
def test_nearest_equals_all_pairs(spark, kind, window, others):
    rng = np.random.default_rng(len(kind))
    (py, px), (ry, rx) = world(rng, 60, kind), world(rng, 150, kind)
    pt, rt = (rng.integers(0, 5 * HOUR_US, n) // (HOUR_US // 4) * (HOUR_US // 4) for n in (60, 150))
    pm, rm = rng.integers(1, 8, 60), rng.integers(1, 8, 150)
    probes = [(i, int(pt[i]), int(pt[i] // HOUR_US), float(py[i]), float(px[i]), int(pm[i])) for i in range(60)]
    rows = [(int(rt[i]), int(rt[i] // HOUR_US), float(ry[i]), float(rx[i]), int(rm[i])) for i in range(150)]
    odd = [(900, 0, 0, None, 1.0, 1), (901, 99 * HOUR_US, 99, 1.0, 1.0, 1), (902, int(pt[0]), int(pt[0] // HOUR_US), float(py[0]), float(px[0]), None)]
    a = spark.createDataFrame(probes + odd, "id long, t long, hour long, lat double, lon double, mmsi long")
    b = spark.createDataFrame(rows + rows[:5] + [(0, 0, None, 1.0, 2), (0, 0, 5.0, 5.0, None)], "t long, hour long, lat double, lon double, mmsi long")
    want = {}
    for i, t, h, y, x, m in probes + odd[2:]:
        if others and m is None:
            continue
        near = [(float(km(y, x, r[2], r[3])), r[4], r[2], r[3]) for r in rows if (abs(r[0] - t) <= window if window else r[1] == h) and not (others and r[4] == m)]
        if near:
            least = min(near)[0]
            want[i] = min((round(v[0], 9), *v[1:]) for v in near if v[0] <= least + 1e-9)
    got = {r.id: (round(r.km, 9), r.mmsi, r.lat, r.lon) for r in nearest_rows(a, b, "id", window, others).collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        assert abs(got[i][0] - w[0]) < 1e-6, (i, got[i], w)
        assert got[i][1:] == w[1:] or abs(got[i][0] - w[0]) < 1e-9


def test_rows_within_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    for kind in ("ports", "globe"):
        (py, px), (ry, rx) = world(rng, 80, kind), world(rng, 200, kind)
        t = rng.integers(0, 3 * HOUR_US, 200)
        a = spark.createDataFrame([(i, int(t[i]), float(py[i]), float(px[i])) for i in range(80)], "id long, t long, lat double, lon double")
        b = spark.createDataFrame([(i, int(t[-i - 1]), float(ry[i]), float(rx[i])) for i in range(200)], "mmsi long, t long, lat double, lon double")
        got = {(r.id, r.other) for r in rows_within(a, b, 150.0, HOUR_US, ("id",)).collect()}
        want = {(i, j) for i in range(80) for j in range(200) if km(py[i], px[i], ry[j], rx[j]) <= 150 and abs(int(t[i]) - int(t[-j - 1])) <= HOUR_US}
        assert got == want


def test_an_hour_of_100_000_rows_is_never_paired_whole(spark):
    rng = np.random.default_rng(9)
    n, probes = 100_000, 2000
    y, x = np.where(rng.random(n) < 0.5, 26 + rng.standard_normal(n) * 0.2, rng.uniform(24, 28, n)), np.where(rng.random(n) < 0.5, 56 + rng.standard_normal(n) * 0.2, rng.uniform(54, 58, n))
    at = rng.integers(0, n, probes)
    qy, qx = y[at] + rng.standard_normal(probes) * 0.01, x[at] + rng.standard_normal(probes) * 0.01
    qy[:100], qx[:100] = rng.uniform(10, 12, 100), rng.uniform(40, 42, 100)  # far from everything
    import pandas as pd

    rows = spark.createDataFrame(pd.DataFrame({"mmsi": np.arange(n), "hour": 7, "lat": y, "lon": x}))
    asked = spark.createDataFrame(pd.DataFrame({"id": np.arange(probes), "hour": 7, "lat": qy, "lon": qx, "mmsi": -1}))
    found = nearest_rows(asked, rows, "id")
    got = {r.id: r.km for r in found.collect()}
    assert len(got) == probes
    for i in range(0, probes, 37):
        assert abs(got[i] - km(qy[i], qx[i], y, x).min()) < 1e-6
    assert joined_rows(found) < 2000 * probes  # all pairs would be 100,000 for each probe


@pytest.mark.parametrize("kind", ["globe", "date line", "stack", "ports"])
def test_count_within_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(len(kind))
    (py, px), (ry, rx) = world(rng, 80, kind), world(rng, 400, kind)
    pk, rk = rng.integers(0, 3, 80), rng.integers(0, 2, 400)
    a = spark.createDataFrame([(i, int(pk[i]), float(py[i]), float(px[i])) for i in range(80)] + [(900, 0, None, 1.0)], "id long, k int, lat double, lon double")
    b = spark.createDataFrame([(int(rk[i]), float(ry[i]), float(rx[i])) for i in range(400)] + [(0, None, 1.0)], "k int, lat double, lon double")
    for radius in (1.0, 150.0, 6000.0):
        got = {r.id: r.n for r in count_within(a, b, "id", radius, "k").collect()}
        assert got == {**{i: int(((km(py[i], px[i], ry, rx) <= radius) & (rk == pk[i])).sum()) for i in range(80)}, 900: 0}


def test_probes_among_rows_meet_few_of_them(spark):
    import pandas as pd

    from veritrack.operators import nearest

    rng = np.random.default_rng(12)
    n = 6000
    y, x = rng.integers(2550, 2700, n) / 100, rng.integers(5550, 5700, n) / 100
    ais = spark.createDataFrame(pd.DataFrame({"event_id": np.arange(n), "mmsi": np.arange(n) % 3000, "hour": 7, "lat": y, "lon": x}))
    asked = ais.selectExpr("event_id AS id", "0L AS t", "lat", "lon", "mmsi AS own", "hour AS _b")
    placed = ais.selectExpr("hour AS _b", "0L AS rt", "mmsi AS m", "lat AS y", "lon AS x")
    tried = nearest._from_own_cells(nearest._bounded(asked, placed, True).where("k is not null"), placed, None, True)
    got = {r.id: r.n.km for r in tried.collect()}
    assert len(got) > 0.99 * n and joined_rows(tried) < 60 * n  # the large cells alone made over 500 pairs a probe
    for i in range(0, n, 397):
        other = np.arange(n) % 3000 != i % 3000
        assert i not in got or abs(got[i] - km(y[i], x[i], y[other], x[other]).min()) < 1e-6


def test_a_crowded_cell_is_left_to_the_large_cells(spark):
    rows = [(m, 7, 26 + 1e-6 * m, 56.0) for m in range(400)]
    ais = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, mmsi long, hour long, lat double, lon double")
    got = {r.event_id: (r.mmsi, round(r.km * 1e4)) for r in nearest_rows(ais, ais, "event_id", others=True).collect()}
    assert len(got) == 400 and all(abs(m - i) == 1 and d == 1 for i, (m, d) in got.items())


@pytest.mark.parametrize("kind", ["globe", "date line", "stack", "ports"])
def test_vessels_met_equal_all_pairs(spark, kind):
    rng = np.random.default_rng(len(kind) + 7)
    (py, px), (ry, rx) = world(rng, 80, kind), world(rng, 200, kind)
    pt, rt = (rng.integers(-3 * HOUR_US, 3 * HOUR_US, n) // (HOUR_US // 4) * (HOUR_US // 4) for n in (80, 200))
    rm = rng.integers(1, 20, 200)
    a = spark.createDataFrame([(i, int(pt[i]), float(py[i]), float(px[i])) for i in range(80)] + [(900, 0, None, 1.0)], "id long, t long, lat double, lon double")
    b = spark.createDataFrame([(int(rm[i]), int(rt[i]), float(ry[i]), float(rx[i])) for i in range(200)] + [(None, 0, 26.0, 56.0), (3, None, 26.0, 56.0), (3, 0, None, 56.0)], "mmsi long, t long, lat double, lon double")
    for radius in (20.0, 150.0):
        want = {}
        for i in range(80):
            for j in range(200):
                d = float(km(py[i], px[i], ry[j], rx[j]))
                if abs(pt[i] - rt[j]) <= HOUR_US and d <= radius:
                    want[i, int(rm[j])] = min(d, want.get((i, int(rm[j])), d))
        rows = met_within(a, b, radius, HOUR_US, ("id",)).collect()
        got = {(r.id, r.other): r.km for r in rows}
        assert len(rows) == len(got) and set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-9 * max(1.0, want[k]) + 1e-6 for k in got)


def test_pairs_of_vessels_are_not_shuffled(spark, monkeypatch):
    """The only exchanges of a rendezvous are the two before its join: 200 detections and 200 vessels in one place make 40,000 pairs."""
    from veritrack import catalog

    a = spark.range(200).selectExpr("id AS sar_id", "id + 1000 AS mmsi", "0L AS t", "26D AS lat", "56D AS lon")
    b = spark.range(200).selectExpr("id AS mmsi", "0L AS t", "26D AS lat", "56.01D AS lon")
    monkeypatch.setattr(catalog, "_sar", lambda s, d: a)
    monkeypatch.setattr(catalog, "_ais", lambda s, d: b)
    met = catalog.J_11_J_17_rendezvous(spark, "")
    assert len(met.collect()) == 40_000

    def written(node) -> int:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return written(node.executedPlan())
        if "QueryStage" in name:
            return written(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        children = node.children()
        return own + sum(written(children.apply(i)) for i in range(children.size()))

    assert written(met._jdf.queryExecution().executedPlan()) < 10_000
