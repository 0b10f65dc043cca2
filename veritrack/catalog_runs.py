"""Queries on runs: the watch-list over several windows, comparisons of calibrations, known cases and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrack.catalog import ANOM, ARTIFACTS, BASE, CLS, REPAIR, _ais, _classified, _identity, _recursive, _sar, _triples, hav, query
from veritrack.operators import calibrate, cluster, compare, match, relink, screen, watchlist
from veritrack.plans.lineage import cut, scratch
from veritrack.sources import adapters as src

RUNS, BUDGET, STEP_DAYS = 4, 40, 20
_BASE_US = 1_704_067_200_000_000  # 2024-01-01
DAY = watchlist.DAY_US


def _watch_sql() -> str:
    """The runs one after another, each reading the log that the one before left."""
    sql = BASE + ANOM + f""", pu AS (SELECT o_custkey mmsi, o_custkey%7<>0 ok, count(*) n_events FROM orders GROUP BY 1),
g0 AS (SELECT c_custkey mmsi, CASE WHEN c_custkey%10=3 THEN {_BASE_US - 5 * DAY} END last_pulled, 1::bigint pull_count, 0::bigint reflag_count, ['seed'] fw, NULL::bigint nev FROM customer WHERE c_custkey%10 IN (3,4))"""
    for k in range(RUNS):
        now = _BASE_US + k * STEP_DAYS * DAY
        sql += f""", f{k} AS (SELECT DISTINCT vessel mmsi FROM an WHERE (t//604800000000)%4={k}),
a{k} AS (SELECT f{k}.mmsi, CASE WHEN g.mmsi IS NULL THEN 'never pulled' WHEN g.last_pulled IS NULL THEN 'no timestamp' WHEN ({now}-g.last_pulled)/8.64e10>30 THEN 'stale' ELSE 'current' END reason FROM f{k} LEFT JOIN g{k} g USING (mmsi)),
r{k} AS (SELECT mmsi, row_number() OVER (ORDER BY mmsi)<={BUDGET} granted FROM a{k} WHERE mmsi NOT IN (5,9) AND reason<>'current'),
d{k} AS (SELECT a.mmsi, reason, CASE WHEN a.mmsi IN (5,9) THEN 'SUPPRESSED' WHEN reason='current' THEN 'CACHE_SKIP' WHEN NOT granted THEN 'DEFERRED' WHEN coalesce(ok,false) THEN 'FRESH_PULL' ELSE 'FAILED' END act, n_events FROM a{k} a LEFT JOIN r{k} USING (mmsi) LEFT JOIN pu USING (mmsi)),
g{k + 1} AS (SELECT mmsi, CASE WHEN act='FRESH_PULL' THEN {now} ELSE last_pulled END last_pulled, coalesce(pull_count,0)+coalesce((act='FRESH_PULL')::int,0) pull_count, coalesce(reflag_count,0)+coalesce((act='CACHE_SKIP')::int,0) reflag_count,
 CASE WHEN act IS NOT NULL THEN list_distinct(list_append(coalesce(fw,[]),'w{k}')) ELSE fw END fw, CASE WHEN act='FRESH_PULL' THEN n_events ELSE nev END nev FROM g{k} FULL JOIN (SELECT * FROM d{k} WHERE act IN ('FRESH_PULL','CACHE_SKIP')) USING (mmsi))"""
    return sql


def _watch_runs(s, d):
    """Runs over four windows, twenty days apart; each is stored, and the second is asked for twice."""
    folder, flagged = scratch(s), cut(cluster.anomalies(_classified(s, d), _triples(s, d)).selectExpr("vessel AS mmsi", "source AS thresholds", "(t div 604800000000) % 4 AS k").distinct())
    pulls = src.table(s, d, "orders").groupBy(F.col("o_custkey").alias("mmsi")).agg((F.first("o_custkey") % 7 != 0).alias("ok"), F.count("*").alias("n_events"))
    seed = src.table(s, d, "customer").where("c_custkey % 10 in (3, 4)").selectExpr(
        "c_custkey AS mmsi", "CAST(NULL AS LONG) AS first_pulled", f"CASE WHEN c_custkey % 10 = 3 THEN {_BASE_US - 5 * DAY} END AS last_pulled", "1L AS pull_count", "0L AS reflag_count", "CAST(NULL AS LONG) AS last_reflag", "array('seed') AS flagged_windows", "'seed' AS last_decision", "CAST(NULL AS LONG) AS last_n_events")
    log, decisions = seed, None
    for k in range(RUNS):
        for _ in range(2 if k == 1 else 1):
            run = watchlist.run_watchlist(flagged.where(F.col("k") == k), log, pulls, f"w{k}", _BASE_US + k * STEP_DAYS * DAY, f"run{k}", BUDGET, artifacts=ARTIFACTS)
            kept = watchlist.keep_run(run, s, folder, f"run{k}")
        log, decisions = kept, run.decisions if decisions is None else decisions.unionByName(run.decisions)
    return decisions, log, s.read.schema("window string, event string, mmsi long, detail string, run_id string").json(f"{folder}/audit")


@query(_watch_sql() + " ".join([" SELECT 'run0' run_id, mmsi, act AS action, reason FROM d0", *[f"UNION ALL SELECT 'run{k}', mmsi, act, reason FROM d{k}" for k in range(1, RUNS)]]))
def R_03_watchlist_decisions(s, d):
    return _watch_runs(s, d)[0].select("run_id", "mmsi", "action", "reason")


@query(_watch_sql() + f" SELECT mmsi, last_pulled, pull_count::bigint pull_count, reflag_count::bigint reflag_count, array_to_string(list_sort(fw),';') flagged_windows, nev last_n_events FROM g{RUNS}")
def R_03_watchlist_log(s, d):
    return _watch_runs(s, d)[1].select("mmsi", "last_pulled", "pull_count", "reflag_count", F.array_join(F.array_sort("flagged_windows"), ";").alias("flagged_windows"), "last_n_events")


@query(_watch_sql() + " SELECT run_id, event, count(*) n FROM (" + " UNION ALL ".join(f"SELECT 'run{k}' run_id, lower(act) event FROM d{k} UNION ALL SELECT 'run{k}', 'run_end'" for k in range(RUNS)) + ") GROUP BY 1,2")
def SNK_03_audit_trail(s, d):
    """What the audit holds after runs of which one was repeated: each entry once."""
    return _watch_runs(s, d)[2].groupBy("run_id", "event").agg(F.count("*").alias("n"))


# comparisons

OWN2 = f""", rs AS (SELECT s.sar_id, s.t, s.lat, s.lon, ln.mmsi FROM sar s JOIN ln USING (sar_id)),
b2 AS (SELECT s.sar_id, p.t bt, p.lat bla, p.lon blo FROM rs s ASOF JOIN p2 p ON s.mmsi=p.mmsi AND s.t>=p.t), a2 AS (SELECT s.sar_id, p.t at_, p.lat ala, p.lon alo FROM rs s ASOF JOIN p1 p ON s.mmsi=p.mmsi AND s.t<=p.t),
d2 AS (SELECT s.sar_id, {hav('s.lat', 's.lon', 'CASE WHEN at_=s.t THEN ala ELSE bla+(s.t-bt)/(at_-bt)*(ala-bla) END', 'CASE WHEN at_=s.t THEN alo ELSE blo+(s.t-bt)/(at_-bt)*(alo-blo) END')} km FROM rs s JOIN b2 USING (sar_id) JOIN a2 USING (sar_id))"""


def _thresholds(alias: str, table: str, km: str) -> str:
    return f"{alias} AS (SELECT count(*)::bigint n, quantile_cont({km},0.5) m, quantile_cont({km},0.99) sp FROM {table})"


def _paths(alias: str) -> str:
    return f"SELECT 'distance.matched_km' path, m v FROM {alias} UNION ALL SELECT 'distance.spoofed_km', sp FROM {alias} UNION ALL SELECT 'pairs.n', n::double FROM {alias}"


@query(_recursive(BASE + REPAIR + OWN2 + ", " + _thresholds("t1", "kept WHERE true", "distance_km") + ", " + _thresholds("t2", "d2", "km") + f""", x AS ({_paths("t1")} UNION ALL SELECT 'screen.n_kept', (SELECT count(*) FROM kept WHERE keep)), y AS ({_paths("t2")} UNION ALL SELECT 'relink.n_dark', (SELECT count(*) FROM sar WHERE sar_id NOT IN (SELECT sar_id FROM ln)))
SELECT path, round(x.v,6)::double AS before, round(y.v,6)::double AS after, round(round(y.v,6)-round(x.v,6),6)::double delta, CASE WHEN x.v IS NULL THEN 'added' WHEN y.v IS NULL THEN 'removed' WHEN round(x.v,6)=round(y.v,6) THEN 'same' ELSE 'changed' END status FROM x FULL JOIN y USING (path)"""))
def G_06_R_14_recalibration(s, d):
    """The calibration of the links as given against that of the relinked ones, by path."""
    sar, ais = _sar(s, d), _ais(s, d)
    six = lambda c: F.round(c, 6).alias(c)
    screened = cut(screen.keep_links(_identity(s, d), sar, ais))
    before = calibrate.distance_thresholds(screened)
    links = cut(relink.relink_window(sar, ais, "repair", screened))
    relinked = relink.relinked_detections(sar, links)
    pairs = match.identity_links(relinked, ais).select("distance_km", F.lit(True).alias("keep"))
    after = calibrate.distance_thresholds(pairs).crossJoin(F.broadcast(links.agg(F.count_if(F.col("link_status") == "dark_vessel").alias("n_dark"))))  # one row each
    old = before.select(F.col("raw_p50").alias("matched_km"), F.col("raw_p99").alias("spoofed_km"), F.col("n_pairs").alias("n"), "n_kept").select(F.struct(six("matched_km"), six("spoofed_km")).alias("distance"), F.struct("n").alias("pairs"), F.struct("n_kept").alias("screen"))
    new = after.select(F.struct(six("matched_km"), six("spoofed_km")).alias("distance"), F.struct(F.col("n_pairs").alias("n")).alias("pairs"), F.struct("n_dark").alias("relink"))
    diff = compare.report_diff(old, new)
    return diff.select("path", F.col("before").cast("double").alias("before"), F.col("after").cast("double").alias("after"), F.round("delta", 6).alias("delta"), "status")


@query(BASE + CLS + " SELECT mmsi%3 region, count(*) n, round(quantile_cont(distance_km,0.5),6) matched_km, round(quantile_cont(distance_km,0.99),6) spoofed_km, CASE WHEN count(*)>=200 THEN 'ok' ELSE 'low' END confidence FROM clf WHERE time_gap_seconds IS NOT NULL GROUP BY 1")
def R_12_region_thresholds(s, d):
    """Thresholds of each region side by side; vessels fall into three regions here."""
    rows = match.identity_links(_sar(s, d), _ais(s, d)).select((F.col("mmsi") % 3).alias("region"), "distance_km")
    return calibrate.region_thresholds(rows, "region").select("region", "n", F.round("matched_km", 6).alias("matched_km"), F.round("spoofed_km", 6).alias("spoofed_km"), "confidence")
