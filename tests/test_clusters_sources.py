import json

from pyspark.sql import functions as F

from veritrack.operators import cluster, score
from veritrack.plans.components import connected_components
from veritrack.sources import files, sinks
from veritrack.streaming import twins

H = 3_600_000_000


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (3, 2)], "a long, b long")
    assert {r.node: r.component for r in connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert connected_components(e.where("a > 100")).count() == 0
    chain = spark.range(60).selectExpr("id AS a", "id + 1 AS b")
    assert [tuple(r) for r in connected_components(chain).groupBy("component").count().collect()] == [(0, 61)]


def test_components_of_a_large_graph(spark):
    edges = [(i, i + 1) for i in range(40)] + [(101, 100), (101, 102), (103, 102), (5, 5)]
    e = spark.createDataFrame(edges, "a long, b long")
    got = connected_components(e, large=True).groupBy("component").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 41), (100, 4)]


def pings(spark, rows):
    return spark.createDataFrame([(v, t, float(y), float(x), "likely_spoofed") for v, t, y, x in rows], "vessel long, t long, lat double, lon double, source string")


def test_episode_gap_is_strict(spark):
    p = pings(spark, [(1, 0, 0, 0), (1, 3 * H, 0, 0), (2, 0, 0, 0), (2, 3 * H + 1, 0, 0)])
    assert {(r.vessel, r.n_pings) for r in cluster.episodes(p).collect()} == {(1, 2), (2, 1)}


def test_dbscan_border_and_noise(spark):
    # a border point between two groups takes the earlier cluster
    p = pings(spark, [(1, 0, 0, 0.00), (2, 0, 0, 0.01), (3, 0, 0, 0.02), (4, 0, 0, 0.09), (5, 0, 0, 0.16), (6, 0, 0, 0.17), (7, 0, 0, 0.18), (8, 0, 50, 50)])
    got = {r.vessel: r.cluster for r in cluster.st_dbscan(cluster.episodes(p), 8.0, 2.0, 4).collect()}
    assert got[8] == -1 and set(got.values()) == {-1, 0, 1} or got[4] == 0
    two = {r.vessel: r.cluster for r in cluster.st_dbscan(cluster.episodes(p), 3.0, 2.0, 2).collect()}
    assert two[1] == two[2] == two[3] == 0 and two[5] == two[6] == two[7] == 1 and two[4] == two[8] == -1
    assert cluster.st_dbscan(cluster.episodes(p.where("vessel < 0"))).count() == 0


def test_scores(spark):
    rows = [(1, 0.0, "PAN", "TANKER", 2011), (2, 4.0, "COK", "tug boat", 2010), (3, 9.0, None, None, None)]
    got = {r.vessel: r.reliability_score for r in score.scores(spark.createDataFrame(rows, "vessel long, flag_rate double, flag string, vessel_type string, built_year int")).collect()}
    assert got == {1: 5.0, 2: 15.0 + 20 + 20, 3: 60.0}
    d = spark.createDataFrame([(None,), (30.0,), (30.01,)], "x double").select(score.pull_decision(F.col("x")).alias("d")).collect()
    assert [r.d for r in d] == ["FRESH_PULL", "CACHE_SKIP", "FRESH_PULL"]


def test_payloads(spark):
    report = {"entries": [{"sar": [{"mmsi": "", "entryTimestamp": "2024-01-01T00:00:00Z", "lat": 1.0, "lon": 2.0}, {"mmsi": "7", "entryTimestamp": "bad", "lat": 1.0, "lon": 2.0}]}]}
    rows = files.normalise_sar(files.flatten_report(spark.createDataFrame([(json.dumps(report),)], "json string"))).orderBy("mmsi").collect()
    assert [(r.mmsi, r.ais_matched, r.timestamp is None) for r in rows] == [(None, False, False), (7, True, True)]
    identity = {"entries": [{"registryInfo": [{"flag": None}], "selfReportedInfo": [{"flag": "PAN"}, {"flag": "LBR"}], "combinedSourcesInfo": [{"shiptypes": [{"name": "OTHER"}, {"name": "TANKER"}], "geartypes": None}]}]}
    r = files.flatten_identity(spark.createDataFrame([(1, json.dumps(identity))], "mmsi long, json string")).first()
    assert (r.flag, r.n_flags, r.vessel_type, r.imo) == ("PAN", 2, "TANKER", None)
    events = {"entries": [{"type": "gap", "start": "2024-01-01T00:00:00Z", "regions": {"eez": ["1", "2"]}, "gap": {"durationHours": 5.0}}, {"type": "fishing"}]}
    e = files.flatten_events(spark.createDataFrame([(1, json.dumps(events))], "mmsi long, json string"), eez={"1": "Here"}).collect()
    assert [(x.event_type, x.duration_hrs, x.eez) for x in e] == [("ais_gap", 5.0, "Here;EEZ:2")]


def test_upsert_writes_a_new_version(spark, tmp_path):
    old, new = (spark.createDataFrame(r, "k long, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert {tuple(r) for r in sinks.upsert(old, new, "k", str(tmp_path / "v2")).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_stream_equals_batch(spark):
    d = "/root/testdata/sf0.001"
    stream = {tuple(r) for r in twins.drain(twins.sessions(twins.event_stream(spark, d))).select("user_id", "n").groupBy("user_id").agg(F.sum("n")).collect()}
    batch = {tuple(r) for r in spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").count().collect()}
    assert stream == batch


def plain_dbscan(rows, eps_km, eps_us, least):
    """Clusters by all pairs; rows are ``id, t, lat, lon``."""
    import numpy as np

    from test_nearest import km

    ids, t, y, x = (np.array([r[i] for r in rows]) for i in range(4))
    near = (km(y[:, None], x[:, None], y, x) <= eps_km) & (abs(t[:, None] - t) <= eps_us)
    core = near.sum(1) >= least
    label = np.arange(len(rows))
    while True:
        new = np.array([label[near[i] & core].min() if core[i] else label[i] for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    first = {}
    for i in np.flatnonzero(core):
        first[label[i]] = min(first.get(label[i], (t[i], ids[i])), (t[i], ids[i]))
    number = {part: n for n, part in enumerate(sorted(first, key=first.get))}
    return {ids[i]: number[label[i]] if core[i] else min((number[label[j]] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(rows))}


def test_dbscan_equals_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for y, x, wide, n in ((26.0, 56.0, 0.35, 150), (-0.01, 179.98, 0.06, 30), (65.0, -20.0, 0.5, 60), (26.0, 56.0, 0.02, 60)):
        for i in range(n):
            lon = x + rng.normal() * wide
            rows.append((f"{len(rows)}-1", int(rng.integers(0, 12 * H)), float(y + rng.normal() * wide), float((lon + 180) % 360 - 180)))
    e = spark.createDataFrame(rows, "episode_id string, t long, lat double, lon double")
    for eps_km, eps_h, least in ((8.0, 2.0, 2), (5.0, 1.0, 4)):
        got = {r.episode_id: r.cluster for r in cluster.st_dbscan(e, eps_km, eps_h, least).collect()}
        assert got == plain_dbscan(rows, eps_km, int(eps_h * H), least)


def test_dbscan_writes_no_pairs_of_a_crowd(spark, monkeypatch):
    written, cut = [], cluster.cut
    monkeypatch.setattr(cluster, "cut", lambda df: written.append(cut(df)) or written[-1])
    n = 3000
    e = spark.range(n).selectExpr("concat(id, '-1') AS episode_id", "id * 1000 AS t", "26 + id * 1e-6 AS lat", "56D AS lon")
    assert cluster.st_dbscan(e).where("cluster = 0").count() == n
    assert sum(table.count() for table in written) < 20 * n  # all pairs are 9,000,000


def test_a_history_is_one_file_whatever_the_tasks(spark, tmp_path):
    path = str(tmp_path / "kept")
    rows = spark.range(0, 60, 1, 6).selectExpr("id % 5 AS mmsi", "'port_visit' AS event_type", "'2024-01-01T00:00:00Z' AS start", "CAST(NULL AS STRING) AS end", "1.0D AS lat", "2.0D AS lon", "3.0D AS duration_hrs")
    files.keep_histories(rows, path)
    assert files.bootstrap_from_files(spark, f"{path}/*", r"history_(\d+)").count() == 5
    assert {tuple(r) for r in files.deep_history(spark, path).groupBy("mmsi").count().collect()} == {(k, 12) for k in range(5)}
