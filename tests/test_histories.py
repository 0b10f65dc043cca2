"""Identities, intervals, isolation, watch-list runs and comparisons on hand-made rows."""

import pytest

from veritrack.functions.timeutil import HOUR_US as H
from veritrack.operators import calibrate, cluster, compare, identity, views, watchlist
from veritrack.operators.intervals import stab

REPORTS = "mmsi long, ssvid string, id string, flag string, name string, imo string, t_from long, t_to long, positions long"


def test_current_identity(spark):
    rows = [(1, "1", "a", "PAN", "OLD", "9", 0, 50, 5000), (1, "1", "b", "LBR", "NEW", "9", 60, 90, 10), (1, "1", "c", "USA", None, "9", 95, 99, 9000), (1, "7", "d", "GAB", "OTHER", "9", 95, 200, 9000),
            (2, "3", "e", "PAN", "X", None, 0, 1, 9000), (3, "3", "f", " ", " ", None, 0, 1, 10), (4, "4", "g", "PAN", "A", None, 0, 10, 1), (4, "4", "h", "PAN", "B", None, None, 10, 1)]
    got = {r.mmsi: r for r in identity.current_identity(spark.createDataFrame(rows, REPORTS)).collect()}
    assert (got[1].id, got[1].flag, got[1].n_flags, got[1].n_names, got[1].n_reports) == ("b", "LBR", 4, 3, 4)  # a name goes before a later end
    assert (got[2].available, got[2].id, got[2].n_flags) == (False, None, 1)
    assert (got[3].available, got[3].name, got[3].n_reports) == (True, None, 0)  # a stub: few positions, blank name
    assert got[4].id == "h"  # equal ends and starts: the greater id
    assert identity.current_identity(spark.createDataFrame([], REPORTS)).count() == 0


def test_validity_intervals(spark):
    rows = [(1, "1", "a", "PAN", "X", None, 0, 10, 5000), (1, "1", "b", "PAN", "X", None, 10, 30, 5000), (1, "1", "s", "GAB", None, None, 15, 16, 999), (1, "1", "c", None, "X", None, 40, 50, 5000),
            (1, "1", "d", "PAN", "X", None, 60, 70, 5000), (1, "1", "e", "LBR", "Y", None, 80, 90, 5000), (2, "2", "f", None, None, None, 0, 1, 1)]
    r = identity.validity_intervals(spark.createDataFrame(rows, REPORTS)).orderBy("seq").collect()
    assert [(x.flag, x.t_from, x.t_to, x.valid_to, x.reflagged, x.renamed) for x in r] == [("PAN", 0, 30, 40, False, False), (None, 40, 50, 60, False, False), ("PAN", 60, 70, 80, False, False), ("LBR", 80, 90, None, True, True)]
    c = identity.change_counts(identity.validity_intervals(spark.createDataFrame(rows, REPORTS))).collect()
    assert [(x.mmsi, x.n_reflags, x.n_renames, x.flags) for x in c] == [(1, 1, 1, "PAN>LBR")]


def test_points_in_intervals(spark):
    points = spark.createDataFrame([(1, 5, "a"), (1, 10, "b"), (1, 11, "c"), (2, 5, "d"), (1, 400, "e"), (None, 5, "f")], "k int, t long, n string")
    spans = spark.createDataFrame([(1, 0, 10, "x"), (1, 10, 350, "y"), (3, 0, 99, "z")], "k int, t_start long, t_end long, i string")
    got = sorted((r.n, r.i) for r in stab(points, spans, ("k",), bucket_us=100).select("n", "i").na.fill("-", ["i"]).collect())
    assert got == [("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", "-"), ("e", "-"), ("f", "-")]
    assert stab(points, spans, ("k",), bucket_us=7, how="inner").count() == 4


LABELLED = "vessel long, cluster int, t_start long, t_end long, episode_id string"
SUMMARY = "cluster int, n_episodes long, n_vessels long, coherence string"


def test_isolation_equals_all_pairs(spark):
    import random

    draw = random.Random(4)
    rows = []
    for i in range(120):
        a = draw.randint(0, 400)
        rows.append((draw.randint(1, 9), draw.randint(-1, 5), a * H, (a + draw.randint(0, 6)) * H, f"e{i}"))
    rows += [(50, 9, 0, H, "x1"), (50, 9, 2 * H, 3 * H, "x2")]
    by = {}
    for v, c, *_ in rows:
        by.setdefault(c, set()).add(v)
    kinds = {c: "genuine" if c % 2 else "loose" for c in by}
    summary = [(c, sum(r[1] == c for r in rows), len(by[c]), kinds[c]) for c in by if c >= 0]
    got = {(r.vessel, r.cluster): r for r in cluster.isolation(spark.createDataFrame(rows, LABELLED), spark.createDataFrame(summary, SUMMARY)).collect()}
    assert set(got) == {(r[0], r[1]) for r in rows}
    for (v, c), r in got.items():
        a, b = min(x[2] for x in rows if x[0] == v), max(x[3] for x in rows if x[0] == v)
        gaps = [max(0, a - x[3], x[2] - b) / H for x in rows if x[1] == c and x[0] != v]
        assert r.n_own == sum(x[0] == v and x[1] == c for x in rows)
        if c < 0:
            assert (r.status, r.nearest_gap_h) == ("isolated", None)
        else:
            assert r.nearest_gap_h == (min(gaps) if gaps else None)
            assert r.status == ("alone" if not gaps else "contemporaneous" if kinds[c] == "genuine" else "not_contemporaneous")


def test_pings_take_the_cluster_of_their_episode(spark):
    labelled = spark.createDataFrame([(1, 3, 0, 5, "1-1"), (1, -1, 100, 100, "1-2"), (2, 3, 4, 9, "2-1")], LABELLED)
    summary = spark.createDataFrame([(3, 2, 2, "genuine")], SUMMARY)
    pings = spark.createDataFrame([(1, 0), (1, 5), (1, 100), (1, 50), (2, 6), (3, 6)], "vessel long, t long")
    got = sorted((r.vessel, r.t, r.episode_id or "-", r.cluster, r.coherence) for r in cluster.propagate(pings, labelled, summary).collect())
    assert got == [(1, 0, "1-1", 3, "genuine"), (1, 5, "1-1", 3, "genuine"), (1, 50, "-", -1, "noise"), (1, 100, "1-2", -1, "noise"), (2, 6, "2-1", 3, "genuine"), (3, 6, "-", -1, "noise")]


DAY = watchlist.DAY_US


def _run(spark, log, flags, now, run_id, budget=2, bad=()):
    f = spark.createDataFrame(flags, "mmsi long, thresholds string")
    pulls = spark.createDataFrame([(m, m not in bad, 5) for m in range(1, 10)], "mmsi long, ok boolean, n_events long")
    return watchlist.run_watchlist(f, log, pulls, run_id, now, run_id, budget, artifacts=(9,))


def test_watchlist_is_a_state_machine(spark, tmp_path):
    log = spark.createDataFrame([(3, 0, 0, 1, 0, None, ["w"], "fresh_pull", 2), (4, None, None, 1, 0, None, ["w"], None, None)], watchlist.LOG)
    flags = [(1, "a"), (1, "b;a"), (2, "a"), (3, "a"), (4, "a"), (5, "a"), (9, "a"), (None, "a")]
    first = _run(spark, log, flags, 10 * DAY, "r1", bad=(2,))
    got = {r.mmsi: (r.action, r.reason) for r in first.decisions.collect()}
    assert got == {1: ("FRESH_PULL", "never pulled"), 2: ("FAILED", "never pulled"), 3: ("CACHE_SKIP", "current"), 4: ("DEFERRED", "no timestamp"), 5: ("DEFERRED", "never pulled"), 9: ("SUPPRESSED", "never pulled")}
    kept = watchlist.keep_run(first, spark, str(tmp_path), "r1")
    state = {r.mmsi: r for r in kept.collect()}
    assert set(state) == {1, 3, 4} and (state[1].pull_count, state[1].last_pulled, state[1].last_n_events) == (1, 10 * DAY, 5)
    assert (state[3].reflag_count, state[3].flagged_windows, state[3].last_pulled) == (1, ["w", "r1"], 0)
    again = watchlist.keep_run(_run(spark, kept, flags, 11 * DAY, "r1"), spark, str(tmp_path), "r1")  # the same run once more
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))
    second = _run(spark, kept, [(1, "a"), (2, "a"), (3, "a")], 30 * DAY + 1, "r2")
    assert {r.mmsi: r.action for r in second.decisions.collect()} == {1: "CACHE_SKIP", 2: "FRESH_PULL", 3: "FRESH_PULL"}  # 3 is just stale
    watchlist.keep_run(second, spark, str(tmp_path), "r2")
    audit = spark.read.json(f"{tmp_path}/audit")
    assert {(r.run_id, r.event): r["count"] for r in audit.groupBy("run_id", "event").count().collect()} == {("r1", "fresh_pull"): 1, ("r1", "failed"): 1, ("r1", "cache_skip"): 1, ("r1", "deferred"): 2, ("r1", "suppressed"): 1, ("r1", "run_end"): 1, ("r2", "fresh_pull"): 2, ("r2", "cache_skip"): 1, ("r2", "run_end"): 1}
    none = _run(spark, kept, [], 40 * DAY, "r3")
    assert none.decisions.count() == 0 and sorted(map(str, none.log.collect())) == sorted(map(str, kept.collect()))


def test_reports_are_compared_by_path(spark):
    a = spark.createDataFrame([("n", (1.5, "x", [1, 2]), None), ("s", (2.0, None, None), 7)], "region string, d struct<km: double, t: string, l: array<int>>, gone int")
    b = spark.createDataFrame([("n", (1.5, "y", [1, 2]), 3.0)], "region string, d struct<km: float, t: string, l: array<int>>, new double")
    got = {(r.region, r.path): (r.before, r.after, r.delta, r.status) for r in compare.report_diff(a, b, ("region",)).collect()}
    assert got == {("n", "d.km"): ("1.5", "1.5", 0.0, "same"), ("n", "d.t"): ("x", "y", None, "changed"), ("n", "d.l"): ("[1,2]", "[1,2]", None, "same"), ("n", "new"): (None, "3.0", None, "added"),
                   ("s", "d.km"): ("2.0", None, None, "removed"), ("s", "gone"): ("7", None, None, "removed")}


def test_thresholds_and_their_confidence(spark):
    rows = spark.createDataFrame([(float(i), i % 4 != 0) for i in range(200)], "distance_km double, keep boolean")
    r = calibrate.distance_thresholds(rows).first()
    assert (r.n_pairs, r.n_kept, r.raw_p50, r.confidence, r.exclusion_warning) == (200, 150, 99.5, "low", True) and r.matched_km == pytest.approx(100.0, abs=1)
    none = calibrate.distance_thresholds(rows.where("distance_km < 0")).first()
    assert (none.n_pairs, none.matched_km, none.confidence, none.exclusion_warning) == (0, None, "low", False)


def test_known_cases(spark):
    links = spark.createDataFrame([(1, None, "dark_vessel"), (2, 8, "relinked"), (3, 7, "relinked"), (4, 9, "locked")], "sar_id int, relinked_mmsi long, link_status string")
    cases = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 7), (5, 7)], "sar_id int, bad_mmsi long")
    assert {r.sar_id: (r.passed, r.link_status) for r in views.validate_cases(links, cases).collect()} == {1: (True, "dark_vessel"), 2: (True, "relinked"), 3: (False, "relinked"), 4: (False, "locked"), 5: (False, "not_in_dataset")}


def test_wrapped_text(spark):
    import textwrap

    from pyspark.sql import functions as F

    texts = ["", "  ", "one", "one two  three\nfour", "extraordinarily long words here", "a bb ccc dddd eeeee"]
    got = [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", views.wrap_text(F.col("t"), 9).alias("w")).orderBy("i").collect()]
    assert got == ["\n".join(textwrap.wrap(t, 9, break_long_words=False)) for t in texts]
