import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritrack.functions.geo import bearing, destination, haversine
from veritrack.operators import dwell, match, passing, relink, screen, trajectory
from veritrack.operators.calibrate import knee
from veritrack.operators.match import interpolate, match_and_classify, tier

H = 3_600_000_000


def track(spark, rows):
    return spark.createDataFrame([(i, m, t, t // H, float(y), float(x)) for i, (m, t, y, x) in enumerate(rows)], "event_id long, mmsi long, t long, hour long, lat double, lon double")


def sar(spark, rows):
    return spark.createDataFrame([(i, m, t, t // H, float(y), float(x)) for i, (m, t, y, x) in enumerate(rows)], "sar_id long, mmsi long, t long, hour long, lat double, lon double")


def test_destination_undoes_bearing(spark):
    df = spark.createDataFrame([(10.0, 20.0, 11.0, 21.5), (-5.0, 100.0, -4.5, 99.0), (25.0, 56.0, 25.0, 56.5)], "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    y, x = destination(cols[0], cols[1], bearing(*cols), haversine(*cols))
    for r in df.select(y.alias("y"), x.alias("x"), "c", "d").collect():
        assert (r.y, r.x) == pytest.approx((r.c, r.d), abs=1e-9)


def test_antipodes_do_not_fail(spark):
    r = spark.range(1).select(haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d")).first()
    assert r.d == pytest.approx(math.pi * 6371.0088)


def test_interpolation_boundaries(spark):
    t = track(spark, [(1, 0, 0, 0), (1, H, 1, 1), (1, H, 2, 2), (1, 3 * H, 4, 4), (2, 5 * H, 9, 9)])
    p = sar(spark, [(1, -1, 0, 0), (1, 0, 0, 0), (1, H, 0, 0), (1, 2 * H, 0, 0), (1, 3 * H, 0, 0), (1, 3 * H + 1, 0, 0), (2, 5 * H, 0, 0), (None, H, 0, 0), (3, H, 0, 0)])
    got = {r.sar_id: (r.ais_lat, r.gap_s) for r in interpolate(p, t).collect()}
    assert got == {1: (0, 0), 2: (1, 0), 3: (3, 3600), 4: (4, 0), 6: (9, 0)}


def test_nearest_path_ties_and_empty(spark):
    t = track(spark, [(7, 0, 0, 1), (5, 0, 0, -1)])
    got = match_and_classify(sar(spark, [(None, 10, 0, 0), (None, H, 0, 0)]), t).orderBy("sar_id").collect()
    assert got[0].matched_mmsi == 5 and got[0].time_gap_seconds is None
    assert got[1].classification == "no_ais_activity"
    assert match_and_classify(sar(spark, []), t).count() == 0


def test_tiers_are_inclusive(spark):
    rows = spark.createDataFrame([(0.0,), (1.5,), (1.51,), (20.0,), (20.01,), (None,)], "d double").select(tier(F.col("d")).alias("c"), tier(F.col("d"), 0.0).alias("z")).collect()
    assert [r.c for r in rows] == ["matched", "matched", "discrepant", "discrepant", "likely_spoofed", "no_ais_activity"]
    assert [r.z for r in rows][:2] == ["matched", "discrepant"]


def test_bracket_sides(spark):
    t = track(spark, [(1, 0, 0, 5), (1, 2 * H, 0, 5), (2, 0, 0, 5), (3, H, 0, 5)])
    got = {r.sar_id: r.bracket_status for r in screen.bracket(sar(spark, [(1, H, 0, 0), (2, H, 0, 0), (3, H, 0, 0), (4, H, 0, 0)]), t).collect()}
    assert got == {0: "elsewhere", 1: "consistent", 2: "consistent", 3: "unsupported"}


def test_triples_scale_with_the_gap(spark):
    t = track(spark, [(1, 0, 0, 0), (1, H, 0, 0), (1, 2 * H, 0, 0.04), (2, 0, 0, 0), (2, H, 0, 0), (2, 17 * H, 0, 0.17), (3, 0, 0, 0), (3, 0, 0, 1), (3, H, 0, 1)])
    got = {(r.mmsi, r.t // H): r.tier for r in trajectory.predict_triples(t).collect()}
    assert got == {(1, 2): "normal", (2, 17): "normal"}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.lists(st.integers(0, 30), min_size=n + 2, max_size=n + 2), min_size=n, max_size=n)))
def test_assignment_is_cheapest(rows):
    from itertools import permutations

    import numpy as np

    cost = np.array(rows, float)
    chosen = relink.assign(cost)
    assert len(set(chosen)) == len(chosen)
    best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in permutations(range(cost.shape[1]), len(cost)))
    assert cost[np.arange(len(cost)), chosen].sum() == best


def test_relink_contested_vessel(spark):
    t = track(spark, [(1, 0, 0, 0), (1, 2 * H, 0, 0)])
    got = {r.sar_id: r.relinked_mmsi for r in relink.relink(sar(spark, [(None, H, 0, 0.01), (None, H, 0, 0.02)]), t).collect()}
    assert got == {0: 1, 1: None}


def test_relink_keeps_locks_and_penalties(spark):
    # vessel 1 is locked by detection 0; vessel 2 is elsewhere on both sides; vessel 3 has no fix within two hours
    t = track(spark, [(1, 0, 0, 0), (1, 2 * H, 0, 0), (2, 0, 0, 1), (2, 2 * H, 0, -1), (3, -2 * H, 0, 0.01), (3, 4 * H, 0, 0.01), (4, 0, 0, 0.03), (4, 2 * H, 0, 0.03)])
    d = sar(spark, [(1, H, 0, 0), (None, H, 0, 0.001), (2, H, 0, 0.02)])
    got = {r.sar_id: (r.relinked_mmsi, r.link_status) for r in relink.relink(d, t, spark.createDataFrame([(0,)], "sar_id long")).collect()}
    assert got[0] == (1, "locked") and sorted([got[1], got[2]], key=str) == [(4, "relinked"), (None, "dark_vessel")]


def test_dwell_edges(spark):
    rows = [(1, h * H, 0, 0) for h in range(7)] + [(2, h * H, 0, 0) for h in range(6)] + [(3, 0, 0, 0), (3, 6 * H, 0, 0)] + [(4, 0, 0, 0), (4, 7 * H, 0, 0)]
    got = {r.mmsi: r.duration_h for r in dwell.dwell_episodes(track(spark, rows)).collect()}
    assert got == {1: 6.0, 3: 6.0}


@pytest.mark.parametrize("hours,tier", [(20, "ordinary"), (44.6, "ordinary"), (48, "ordinary"), (48.01, "extended"), (110, "extended"), (168, "extended"), (219.5, "prolonged")])
def test_duration_tiers(spark, hours, tier):
    assert spark.range(1).select(dwell.duration_tier(F.lit(float(hours))).alias("t")).first().t == tier


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0] * 5, [0.0, 1.0, 2.0, 3.0], [1.0, 1.1, 1.2, 1.3, 9.0], [0.0, 0.0, 0.0, 5.0, 5.0, 6.0]])
def test_knee_equals_its_definition(spark, values):
    y = sorted(values)
    want = y[-1]
    n = len(y)
    if n > 2 and y[0] != y[-1]:
        d = [round(abs((y[-1] - y[0]) * i - (n - 1) * (v - y[0])) / math.hypot(n - 1, y[-1] - y[0]), 9) for i, v in enumerate(y)]
        want = y[d.index(max(d))]
    assert knee(spark.createDataFrame([(v,) for v in values], "v double"), "v").first().knee == want


def test_route_verdicts(spark):
    rows = [(0.9, 0.01, None), (1.0, 0.01, None), (5.0, 0.01, None), (0.5, 2.0, None), (45 * 1.852, 1.0, None), (46 * 1.852, 1.0, None), (50.0, 2.0, 400.0), (130.0, 3.0, 300.0), (10.0, None, None)]
    df = spark.createDataFrame(rows, "km double, h double, sea double")
    _, _, verdict = trajectory.route_verdict(F.col("km"), F.col("h"), F.col("sea"), F.lit("unknown"))
    got = [r.v for r in df.select(verdict.alias("v")).collect()]
    assert got == ["PLAUSIBLE", "IMPLAUSIBLE_BUT_POSSIBLE", "PHYSICALLY_IMPOSSIBLE", "PLAUSIBLE", "IMPLAUSIBLE_BUT_POSSIBLE", "PHYSICALLY_IMPOSSIBLE", "PLAUSIBLE", "PHYSICALLY_IMPOSSIBLE", "UNDETERMINED"]


def test_range_join_is_not_a_nested_loop(spark):
    p = match.range_join(sar(spark, [(1, H, 0, 0)]).select("sar_id", "t"), track(spark, [(1, 0, 0, 0)]).select(F.col("t").alias("rt")), H)
    assert p.count() == 1
    assert "NestedLoop" not in p._jdf.queryExecution().toString()


def test_crowded_overpass_writes_few_links(spark):
    # one instant, three detections and many vessels: beyond the three nearest none is needed, as the links are dealt over cells
    t = track(spark, [(m, h * H, 0, m * 1e-5) for m in range(1, 400) for h in (0, 2)])
    d = sar(spark, [(None, H, 0, 0), (None, H, 0, 0), (None, H, 0, 0)])
    pool = d.select("sar_id", "t", "lat", "lon", F.lit(3).cast("long").alias("n"))
    assert relink.candidate_edges(pool, t, 15.0).count() <= 3 * 3 * 4
    assert sorted(r.relinked_mmsi for r in relink.relink(d, t).collect()) == [1, 2, 3]


def test_copies_of_a_vessel_are_one_link(spark):
    # 30 detections of an instant near 300 vessels with one track: a link each to their site, where each had one to its 30 nearest vessels
    t = track(spark, [(m, h * H, 0, h * 0.01) for m in range(300, 0, -1) for h in (0, 2)])
    d = sar(spark, [(None, H, 0, 0.01 + i * 1e-4) for i in range(30)])
    pool = d.select("sar_id", "t", "lat", "lon", F.lit(30).cast("long").alias("n"))
    assert relink.candidate_edges(pool, t, 15.0).count() == 30
    assert sorted(r.relinked_mmsi for r in relink.relink(d, t).collect()) == list(range(1, 31))


def test_candidates_are_counted_by_sites(spark, monkeypatch):
    # 300 vessels with one track, 7 of them taken at the instant of the first detection: two fixes and a piece of the free, a piece cut in two of the taken
    t = track(spark, [(m, h * H, 0, h * 0.01) for m in range(1, 301) for h in (0, 2)])
    d = sar(spark, [(None, H, 0, 0.01), (None, H + 60_000_000, 0, 0.01)])
    held = spark.createDataFrame([(100 + m, m, H) for m in range(1, 8)], "sar_id long, mmsi long, t long")
    met, meet = [], passing.meet
    monkeypatch.setattr(passing, "meet", lambda spots, rows, *rest: met.append(rows.count()) or meet(spots, rows, *rest))
    assert {r.sar_id: r.n for r in relink.candidates_in_radius(d, t, held).collect()} == {0: 293, 1: 300}
    assert met == [5]


@pytest.mark.parametrize("first,seed", [(1, 1), (1, 2), (8, 3)])
def test_relinking_costs_what_the_whole_assignment_costs(spark, monkeypatch, first, seed):
    # vessels share places or cross between far fixes, some are taken; a single nearest site is seldom enough
    import random

    import numpy as np

    monkeypatch.setattr(relink, "FIRST", first)
    monkeypatch.setattr(relink, "OVERPASS", 1000 if seed != 2 else 3)
    r = random.Random(seed)
    rows, where = [], {}
    for m in range(1, 25):
        x, step = r.randrange(8) / 100, r.choice([0, 0, 0, 0.2])
        rows += [(m, 0, 0, x - step), (m, 2 * H, 0, x + step)] + ([(m, 3 * H, 0, x)] if m % 2 else [])
        where[m] = (x, step == 0 or m % 2)
    spots = [(1 + i if i < 4 else None, H, 0, r.randrange(900) / 1e4) for i in range(20)]
    locked = spark.createDataFrame([(0,), (2,)], "sar_id long")
    d = sar(spark, spots)
    got = {x.sar_id: x for x in relink.relink(d, track(spark, rows), locked).collect()}
    assert len(got) == 20 and {got[0].relinked_mmsi, got[2].relinked_mmsi} == {1, 3}
    linked = [x.relinked_mmsi for x in got.values() if x.relinked_mmsi]
    assert len(linked) == len(set(linked))
    free, vessels = [i for i in range(20) if i not in (0, 2)], [m for m in where if m not in (1, 3)]
    km = np.array([[2 * 6371.0088 * math.asin(abs(math.sin(math.radians(spots[i][3] - where[m][0]) / 2))) if where[m][1] else 1e6 for m in vessels] for i in free])
    cost = np.c_[np.where(km <= 5, km, 1e6), np.full((len(free), len(free)), 5.0)]
    best = cost[np.arange(len(free)), relink.assign(cost)].sum()
    assert sum(5.0 if got[i].relinked_km is None else got[i].relinked_km for i in free) == pytest.approx(best)
    for i in free:
        if got[i].relinked_mmsi:
            assert got[i].relinked_km == pytest.approx(km[free.index(i), vessels.index(got[i].relinked_mmsi)])


def test_candidates_are_counted_over_cells_and_the_date_line(spark):
    # vessels 1 and 2 are near, 2 beyond the date line, 3 is beyond the radius, 4 has no fix within three hours, 5 is taken
    t = track(spark, [(m, h * H, 0, x) for m, x in ((1, 179.2), (2, -179.9), (3, 178.5), (5, 179.7)) for h in (0, 2)] + [(4, -4 * H, 0, 179.7), (4, 6 * H, 0, 179.7)])
    d = sar(spark, [(None, H, 0, 179.7)])
    held = spark.createDataFrame([(9, 5, H)], "sar_id long, mmsi long, t long")
    assert [r.n for r in relink.candidates_in_radius(d, t, held).collect()] == [2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 14), st.integers(0, 40)), min_size=1, max_size=70, unique_by=lambda r: r[:2]))
def test_cheapest_links_equal_the_whole_assignment(rows):
    import numpy as np

    d, v, km = (np.array(c) for c in zip(*rows, strict=True))
    km = km.astype(float) / 2
    pick = relink.cheapest(d, v, km, 15.0)
    assert len(set(d[pick])) == len(set(v[pick])) == len(pick)
    cost = np.full((7, 22), 1e7)
    cost[d, v], cost[np.arange(7), 15 + np.arange(7)] = km, 15.0
    best = cost[np.arange(7), relink.assign(cost)].sum()
    assert km[pick].sum() + 15.0 * (7 - len(pick)) == pytest.approx(best)


def test_identity_links_search_no_nearest_row(spark, monkeypatch):
    from veritrack import catalog
    from veritrack.operators import match

    sf = "/root/testdata/sf0.001"
    rows = catalog._classified(spark, sf).where("time_gap_seconds is not null").select("sar_id", "distance_km").collect()
    assert rows

    def searched(*args, **kwargs):
        raise AssertionError("the nearest rows are searched")

    monkeypatch.setattr(match, "nearest_rows", searched)
    assert sorted(map(tuple, catalog._identity(spark, sf).collect())) == sorted(map(tuple, rows))
