import pytest
from pyspark.sql import functions as F

from veritrack.operators import report
from veritrack.operators.trajectory import KNOT_KMH


def test_type_chain(spark):
    rows = spark.createDataFrame([(1, "TUG", "CARGO", None, None), (2, None, "CARGO", "TRAWLERS", None), (3, None, "OTHER", "TRAWLERS", "CARGO"), (4, None, " ", None, "TANKER"),
                                  (5, None, "OTHER", None, None), (6, None, None, "", " "), (7, None, "OTHER", "Other", "TANKER")], "k int, c string, s string, g string, l string")
    got = {r.k: (r.resolved_type, r.type_source) for r in report.resolve_type(rows, "c", "s", "g", "l").collect()}
    assert got == {1: ("TUG", "confirmed"), 2: ("CARGO", "identity"), 3: ("TRAWLERS", "identity"), 4: ("TANKER", "listed"), 5: ("OTHER", "identity"), 6: (None, "unknown"), 7: ("TANKER", "listed")}


def test_structural_verdict(spark):
    reach = 3 * 30 * KNOT_KMH
    rows = spark.createDataFrame([(1, 15.0, 0.0, True, False), (2, 15.1, 9.0, True, False), (3, reach - 1, 1.0, False, False), (4, reach + 1, 1.0, False, False), (5, 1.0, 0.0, False, True), (6, None, None, None, None), (7, 16.0, 0.0, None, None)],
                                 "k int, km double, h double, b boolean, better boolean")
    reached, wrong, verdict = report.structural_verdict(F.col("km"), F.col("h"), F.col("h"), F.col("b"), F.col("better"))
    got = {r.k: (r.v[0], r.w) for r in rows.select("k", verdict.alias("v"), wrong.alias("w")).collect()}
    assert got == {1: ("G", False), 2: ("L", True), 3: ("G", False), 4: ("L", True), 5: ("L", False), 6: ("L", True), 7: ("L", True)}


def test_links_are_assessed_on_own_fixes(spark):
    h = 3_600_000_000
    sar = spark.createDataFrame([(1, 10 * h, 10, 26.0, 56.0, 7), (2, 10 * h, 10, 26.0, 56.0, 8), (3, 10 * h, 10, 26.0, 56.0, 9), (4, 10 * h, 10, 26.0, 56.0, 6)], "sar_id long, t long, hour long, lat double, lon double, mmsi long")
    # 7 is at the place, 8 is elsewhere before and after, 9 was never heard, 6 is 20 km away an hour before
    ais = spark.createDataFrame([(7, 9 * h, 26.01, 56.0), (7, 11 * h, 26.01, 56.0), (8, 9 * h, 27.0, 56.0), (8, 11 * h, 27.0, 56.0), (6, 9 * h, 26.18, 56.0), (9, 30 * h, 26.0, 56.0)], "mmsi long, t long, lat double, lon double")
    links = spark.createDataFrame([(1, 1.1, 3600.0), (2, 111.0, 3600.0), (3, 1.0, 0.0), (4, 20.0, 3600.0)], "sar_id long, distance_km double, time_gap_seconds double")
    got = {r.sar_id: r for r in report.assess_links(links, sar, ais).collect()}
    assert [(got[i].n_track, got[i].struct_wrong, got[i].better_alt) for i in (1, 2, 3, 4)] == [(2, False, False), (2, True, True), (0, True, False), (1, False, True)]
    assert got[1].verdict == "GENUINE_DISPLACEMENT" and {got[i].verdict for i in (2, 3, 4)} == {"LIKELY_MISATTRIBUTION"}
    assert got[2].vertex_km == pytest.approx(111.2, abs=0.1) and got[3].reach_km is None and got[2].best_alt_mmsi == 7


def test_vague_types_are_normalised(spark):
    rows = spark.createDataFrame([(1, None, "N/A", "Other non-fishing", "TANKER"), (2, None, "n a", None, None), (3, None, "Insufficient-Data", "Gear", None)], "k int, c string, s string, g string, l string")
    got = {r.k: (r.resolved_type, r.type_source) for r in report.resolve_type(rows, "c", "s", "g", "l").collect()}
    assert got == {1: ("TANKER", "listed"), 2: ("n a", "identity"), 3: ("Insufficient-Data", "identity")}


def test_every_baseline_reading(spark):
    base = [(m, *([20.0, 30.0, 50.0, 60.0] if m != 2 else [0.0, 1.0, 0.0, 1.0]), ext, stay, cty, gaps, enc) for m, ext, stay, cty, gaps, enc in
            ((1, 5000.0, 10.0, 5, 0, 0), (2, 5000.0, 10.0, 5, 0, 0), (3, 1000.0, 600.0, 1, 4, 1), (4, 2000.0, 10.0, 3, 1, 1), (5, 2000.0, 504.0, 3, 3, 1), (6, 2000.0, None, 3, 1, 0))]
    baseline = spark.createDataFrame(base, "mmsi int, y0 double, y1 double, x0 double, x1 double, extent_km double, longest_stay_h double, n_countries int, n_gaps int, n_encounters int")
    who = spark.createDataFrame([(1, "none", 1, 1, 300.0), (3, "shadow_fleet", 2, 2, 10.0), (4, "none", 2, 1, None), (5, "none", 1, 1, 200.0)], "mmsi int, foc_tier string, n_flags int, n_names int, positions_per_day double")
    flags = spark.createDataFrame([(m, 25.0, 55.0) for m in (1, 2, 3, 4, 5, 9)] + [(1, None, None), (6, None, 55.0), (5, 30.75, 60.75), (4, 0.0, 0.0), (4, 25.0, 55.0)], "mmsi int, lat double, lon double")
    got = {r.mmsi: r for r in report.baseline_reading(flags, baseline, who).collect()}
    assert {m: r.reading for m, r in got.items()} == {1: "ordinary", 2: "outside_baseline", 3: "persistent", 4: "mixed", 5: "mixed", 6: "outside_baseline"}
    assert (got[1].n_flagged, got[1].n_located, got[1].share) == (2, 1, 1.0) and got[6].share is None
    assert got[3].odd == "shadow_fleet;reflagged;renamed;lay_up;confined;reporting_gaps" and got[1].clean == "no_gaps;no_encounters;many_countries;international;stable_identity;dense_positions"


SUMMARY = "n_episodes long, n_vessels long, span_h double, radius_km double, coherence string, strong boolean"


def test_window_stats(spark):
    rows = spark.createDataFrame([(3, 2, 1.0, 2.0, "genuine", False), (5, 5, 3.0, 4.0, "genuine", True), (2, 2, 9.0, 1.0, "loose", False), (1, 1, 0.0, 0.0, "single_vessel_artifact", False)], SUMMARY)
    got = report.window_stats(rows, spark.range(20)).first()
    assert (got.clusters, got.genuine, got.strong, got.loose, got.single, got.ep_in_genuine, got.median_genuine_vessels, got.max_genuine_vessels) == (4, 2, 1, 1, 1, 8, 3, 5)
    assert (got.median_genuine_span, got.median_genuine_radius, got.genuine_per_100ep, got.pct_ep_in_genuine) == (2.0, 3.0, 10.0, 40.0)
    none = report.window_stats(rows.where("n_vessels > 9"), spark.range(0)).first()
    assert (none.clusters, none.ep_in_genuine, none.genuine_per_100ep, none.median_genuine_span, none.max_vessels) == (0, 0, 0.0, None, 0)


def test_counts_with_nulls(spark):
    items = spark.createDataFrame([("a", True), ("a", None), ("b", False)], "collection string, online boolean")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "collection string")
    assert {tuple(r) for r in report.archive_coverage(items, asked).collect()} == {("a", 2, 1, 1), ("b", 1, 0, 1), ("c", 0, 0, 0)}
    assert tuple(report.coverage(spark.createDataFrame([("x", 1), (" ", None), (None, 2)], "a string, b int"), "a", "b").first()) == (3, 1, 2)
    sar = spark.createDataFrame([(1,), (1,), (2,)], "hour int")
    ais = spark.createDataFrame([(1, 7), (1, 7), (1, 8)], "hour int, mmsi int")
    assert tuple(report.overpass_aggregates(sar, ais).first()) == (2, 2, 1.0, 2)
    files = spark.createDataFrame([(1, 2, 9.0), (1, 1, 3.0), (1, 1, 4.0)], "v int, f int, km double")
    assert [tuple(r) for r in report.first_file_maximum(files, "v", "f", "km").collect()] == [(1, 1, 4.0)]
    near = report.near_port_crosstab(spark.createDataFrame([("x", True), ("x", None)], "t string, n boolean"), "t", F.col("n"))
    assert tuple(near.first()) == ("x", 1, 1, 2, pytest.approx(50.0))


def test_history(spark):
    e = spark.createDataFrame([(1, "port_visit", "A", 5, 30.0), (1, "loitering", "B", 2, 25.0), (1, "loitering", None, 9, 24.0), (2, "ais_gap", "A", 1, None)], "mmsi int, event_type string, place string, t long, duration_hrs double")
    got = {r.mmsi: tuple(r)[1:] for r in report.history_summary(e).collect()}
    assert got == {1: (1, 2, 0, "A,B", 2, 9, 25.0, 1), 2: (0, 0, 1, "A", 1, 1, 0.0, 0)}


def test_corrected_pairs(spark):
    track = spark.createDataFrame([(1, 0, 10.0, 20.0), (1, 120_000_000, 11.0, 20.0), (2, 60_000_000, 10.0, 20.1)], "mmsi long, t long, lat double, lon double")
    links = spark.createDataFrame([(5, 60_000_000, 10.0, 20.0, 1, 2), (6, 90_000_000, 10.0, 20.0, 1, 2), (7, 0, 10.0, 20.0, None, 9)], "sar_id long, t long, lat double, lon double, mmsi long, relinked_mmsi long")
    got = {r.sar_id: r for r in report.corrected_pairs(links, track).collect()}
    assert (got[5].named_lat, got[5].named_minutes, got[5].relinked_lon, got[5].relinked_minutes, got[5].tail_outlier) == (10.0, 1.0, 20.1, 0.0, False)
    assert got[6].named_lat == 11.0 and got[6].named_km == pytest.approx(111.2, abs=0.1) and got[6].tail_outlier
    assert (got[7].named_km, got[7].relinked_lat, got[7].tail_outlier) == (None, None, False)
    assert report.corrected_pairs(links.where("sar_id > 9"), track).count() == 0


@pytest.mark.parametrize("name", ["A_37_route_summaries", "P_15_top_semi_join", "R_06_cross_window"])
def test_detections_are_classified_once(spark, monkeypatch, name):
    from veritrack import catalog, catalog_history

    calls, whole = [], catalog._classified(spark, "/root/testdata/sf0.001").limit(50).persist()

    def counted(s, d):
        calls.append(d)
        return whole

    for module in (catalog, catalog_history):
        monkeypatch.setattr(module, "_classified", counted)
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
