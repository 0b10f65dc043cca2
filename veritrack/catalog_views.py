"""Queries that feed views and reports, with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrack.catalog import ANOM, ARTIFACTS, BASE, CLS, DBS, FLG, HOTSPOTS, KEEP, ORACLES, REPAIR, TRIPLE, WINDOWS, K_16_scores, _ais, _classified, _flags, _identity, _recursive, _sar, _triples, hav, query
from veritrack.catalog_history import COH, CUR, EVT, REP, _labelled, _reports
from veritrack.functions.geo import nearest_of
from veritrack.operators import cluster, identity, match, relink, report, score, screen, trajectory, views, window_run
from veritrack.plans.lineage import cut
from veritrack.sources import adapters as src

WEEK = "(t//604800000000)%4"
PINGS = _recursive(BASE + ANOM + DBS + COH + ", pn AS (SELECT ru.vessel, ru.t, ru.lat, ru.lon, ru.source, lab.cluster, coalesce(coherence,'noise') coherence FROM ru JOIN lab ON lab.episode_id=ru.vessel||'-'||ru.run LEFT JOIN cs ON cs.cluster=lab.cluster)")
_WINDOW = "concat('w', (t div 604800000000) % 4)"


def _pings(s, d):
    found, summary = _labelled(s, d)
    return cut(cluster.propagate(cluster.anomalies(_classified(s, d), _triples(s, d)), found, summary)), summary


def _disc(alias: str, rows: str) -> str:
    """Discrete events of flagged rows by vessel and window, and 0 for the others."""
    return f"""{alias}0 AS ({rows}), {alias}1 AS (SELECT *, coalesce(t-lag(t) OVER (PARTITION BY vessel, w ORDER BY t)>10800000000, true) nw FROM {alias}0 WHERE hit),
{alias} AS (SELECT vessel, w, coalesce(n,0) n FROM (SELECT DISTINCT vessel, w FROM {alias}0) LEFT JOIN (SELECT vessel, w, count(*) FILTER (nw) n FROM {alias}1 GROUP BY 1,2) USING (vessel, w))"""


@query(PINGS + ", " + _disc("fa", f"SELECT coalesce(mmsi, matched_mmsi) vessel, 'w'||{WEEK} w, t, coalesce(classification='likely_spoofed' OR distance_km>20, false) hit FROM clf WHERE coalesce(mmsi, matched_mmsi) IS NOT NULL") + ", " + _disc("fb", f"SELECT mmsi vessel, 'w'||{WEEK} w, t, tier='high' hit FROM trc") + f""",
fc AS (SELECT vessel, 'w'||{WEEK} w, count(DISTINCT cluster) FILTER (coherence='genuine') n FROM pn GROUP BY 1,2)
SELECT vessel, w AS "window", source, true observed, n flagged_events, event_type FROM (SELECT *, 'sar' source, 'sar_ais_likely_spoofed' event_type FROM fa UNION ALL SELECT *, 'trajectory', 'trajectory_deviation_high' FROM fb UNION ALL SELECT *, 'clusters', 'genuine_cluster_member' FROM fc)""")
def A_10_flag_events(s, d):
    pings, _ = _pings(s, d)
    return views.flag_events(_classified(s, d), _triples(s, d), pings, F.expr(_WINDOW))


@query(PINGS + """, ms AS (SELECT vessel, cluster, min(t) t, arg_min(lat, (t, lat, lon)) lat, arg_min(lon, (t, lat, lon)) lon FROM pn WHERE coherence='genuine' GROUP BY 1,2)
SELECT vessel, check_name, t, round(lat,6) lat, round(lon,6) lon, metric, round(value,3) AS value FROM (
 SELECT mmsi vessel, 'trajectory_deviation_high' check_name, t, lat, lon, 'deviation_km' metric, deviation_km AS value FROM trc WHERE tier='high'
 UNION ALL SELECT ms.vessel, 'genuine_cluster_member', t, lat, lon, 'cluster_radius_km', radius_km FROM ms JOIN rr USING (cluster)
 UNION ALL SELECT coalesce(mmsi, matched_mmsi), 'sar_ais_likely_spoofed', t, ais_lat, ais_lon, 'sar_ais_distance_km', distance_km FROM clf LEFT JOIN own USING (sar_id) WHERE (classification='likely_spoofed' OR distance_km>20) AND coalesce(mmsi, matched_mmsi) IS NOT NULL)""")
def R_08_incident_flags(s, d):
    pings, summary = _pings(s, d)
    own = match.interpolate(_sar(s, d), _ais(s, d))
    r = views.incident_flags(_triples(s, d), pings, summary, _classified(s, d), own)
    return r.select("vessel", "check_name", "t", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "metric", F.round("value", 3).alias("value"))


@query(_recursive(BASE + REPAIR + " SELECT s.sar_id, s.mmsi bad_mmsi, r.mmsi relinked_mmsi, coalesce(r.st,'dark_vessel') link_status, coalesce(r.st,'dark_vessel')<>'locked' AND coalesce(r.mmsi<>s.mmsi,true) passed FROM sar s JOIN kept USING (sar_id) LEFT JOIN ln r USING (sar_id) WHERE distance_km>10 AND NOT keep"))
def R_04_known_cases(s, d):
    """Links that the screen found bad stand for the known cases: none may be kept."""
    sar, ais = _sar(s, d), _ais(s, d)
    screened = cut(screen.keep_links(_identity(s, d), sar, ais))
    bad = screened.where("not keep and distance_km > 10").select("sar_id")
    cases = sar.join(bad, "sar_id").select("sar_id", F.col("mmsi").alias("bad_mmsi"))
    return views.validate_cases(relink.relink_window(sar, ais, "repair", screened), cases)


@query(BASE + TRIPLE + f""", fl AS (SELECT event_id flag_id, mmsi, t, lat, lon FROM trc WHERE tier='high' AND {hav('lat', 'lon', '26.0', '56.0')}<=40),
mt AS (SELECT flag_id, count(DISTINCT a.mmsi) n_met, min({hav('f.lat', 'f.lon', 'a.lat', 'a.lon')}) nearest_km FROM fl f JOIN ais a ON a.mmsi<>f.mmsi AND abs(a.t-f.t)<=3600000000 AND {hav('f.lat', 'f.lon', 'a.lat', 'a.lon')}<=5 GROUP BY 1),
sl AS (SELECT flag_id, min(k.step_km/k.hours) min_kmh FROM fl f JOIN sp k ON k.mmsi=f.mmsi AND abs(k.t-f.t)<=7200000000 WHERE k.hours>0 GROUP BY 1)
SELECT flag_id, mmsi, coalesce(n_met,0) n_met, round(nearest_km,6) nearest_km, round(min_kmh,6) min_kmh, CASE WHEN min_kmh IS NULL THEN 'unknown' WHEN min_kmh<=2 THEN 'idle' ELSE 'moving' END state FROM fl LEFT JOIN mt USING (flag_id) LEFT JOIN sl USING (flag_id)""")
def R_09_near_port_inspection(s, d):
    near = nearest_of(F.col("lat"), F.col("lon"), HOTSPOTS[:1])["km"] <= 40
    flags = _triples(s, d).where("tier = 'high'").where(near).select(F.col("event_id").alias("flag_id"), "mmsi", "t", "lat", "lon")
    r = views.near_port_inspection(cut(flags), _ais(s, d), trajectory.step_speeds(_ais(s, d)), 5.0)
    return r.select("flag_id", "mmsi", "n_met", F.round("nearest_km", 6).alias("nearest_km"), F.round("min_kmh", 6).alias("min_kmh"), "state")


@query(BASE + CLS + " SELECT classification layer, coalesce(matched_mmsi::varchar,'unknown') label, lon::varchar||'/'||lat::varchar AS place, 'class: '||classification||coalesce(chr(10)||'mmsi: '||matched_mmsi,'') popup FROM clf WHERE classification<>'no_ais_activity'")
def R_10_map_records(s, d):
    v = _classified(s, d).select("lat", "lon", F.col("classification").alias("cls"), F.col("matched_mmsi").alias("mmsi"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("km"))
    r = views.map_records(v).select("record.*")
    return r.select("layer", "label", F.concat_ws("/", F.col("position")[0].cast("string"), F.col("position")[1].cast("string")).alias("place"), "popup")


_REGIONS = {"w0": "north", "w1": "south", "w2": "north", "w3": "south"}


@query(BASE + CLS + f""", x AS (SELECT 'w'||{WEEK} w, CASE {WEEK} WHEN 3 THEN 'relinked' ELSE 'classified' END kind, CASE WHEN {WEEK} IN (0,2) THEN 'north' ELSE 'south' END region, classification c FROM clf), n AS (SELECT w, kind, region, c, count(*) n FROM x GROUP BY ALL), t AS (SELECT w, kind, region, sum(n) t FROM n GROUP BY ALL),
p AS (SELECT a.region, a.w wa, b.w wb, a.kind=b.kind "like", a.t ta, b.t tb FROM t a JOIN t b ON a.region=b.region AND a.w<b.w), pc AS (SELECT p.*, c.c FROM p JOIN (SELECT DISTINCT region, c FROM n) c USING (region))
SELECT pc.region region, wa window_a, wb window_b, "like", pc.c classification, round(100.0*coalesce(na.n,0)/ta,6)::double pct_a, round(100.0*coalesce(nb.n,0)/tb,6)::double pct_b, round(100.0*coalesce(nb.n,0)/tb-100.0*coalesce(na.n,0)/ta,6)::double diff FROM pc LEFT JOIN n na ON na.w=wa AND na.c=pc.c LEFT JOIN n nb ON nb.w=wb AND nb.c=pc.c""")
def R_11_region_comparison(s, d):
    kind = F.when(F.col("window") == "w3", "relinked").otherwise("classified")
    rows = _classified(s, d).withColumn("window", F.expr(_WINDOW)).withColumn("kind", kind)
    r = views.region_comparison(rows, _REGIONS)
    return r.select("region", "window_a", "window_b", "like", "classification", *[F.round(c, 6).alias(c) for c in ("pct_a", "pct_b", "diff")])


@query(BASE + ANOM + FLG + " SELECT vessel, CASE WHEN total_flags=0 THEN 'clean_record' WHEN n_windows<=1 THEN 'single_window_low_confidence' WHEN (flags_w0>0)::int+(flags_w1>0)::int+(flags_w2>0)::int+(flags_w3>0)::int=1 THEN 'isolated_incident' ELSE 'cross_window_pattern' END note FROM con")
def R_07_normalisation_notes(s, d):
    c = score.consolidate(_flags(s, d), ARTIFACTS, WINDOWS)
    seen = reduce(lambda a, b: a + b, [(F.col(f"flags_{w}") > 0).cast("int") for w in WINDOWS])
    return c.select("vessel", views.normalisation_note(F.col("total_flags"), F.col("n_windows"), seen).alias("note"))


@query(f"WITH k AS ({ORACLES['K_16_scores']}), " + REP.removeprefix("WITH ") + CUR + ", " + EVT + f""", ob AS (SELECT mmsi, round({hav('min(lat)', 'min(lon)', 'max(lat)', 'max(lon)')},0) extent_km, count(*) FILTER (event_type='ais_gap') n_gaps FROM ev GROUP BY 1)
SELECT vessel, reliability_score, foc_tier, age_source, idn.n_flags, idn.n_names, extent_km, n_gaps FROM k LEFT JOIN idn ON idn.mmsi=vessel LEFT JOIN ob ON ob.mmsi=vessel WHERE vessel=12""")
def R_13_drill_down(s, d):
    base = report.operating_baseline(src.vessel_events(s, d)).select("mmsi", "extent_km", "n_gaps")
    who = identity.current_identity(_reports(s, d)).select("mmsi", "n_flags", "n_names")
    return views.drill_down(12, K_16_scores(s, d), who, base).select("vessel", "reliability_score", "foc_tier", "age_source", "n_flags", "n_names", "extent_km", "n_gaps")


@query(BASE + TRIPLE + f""", po AS (SELECT event_id, {WEEK} w, tier, {hav('lat', 'lon', '26.0', '56.0')}<=40 near_, row_number() OVER (PARTITION BY {WEEK}, tier ORDER BY md5('42-'||event_id::varchar), event_id) r, count(*) OVER (PARTITION BY {WEEK}, tier) pool FROM trc WHERE tier IN ('notable','high'))
SELECT w window_no, tier, max(pool) pool, count(*) n, count(*) FILTER (near_) n_near, round(100.0*count(*) FILTER (near_)/count(*),6)::double pct FROM po WHERE r<=50 GROUP BY 1,2""")
def A_36_near_port_share(s, d):
    rows = _triples(s, d).where("tier in ('notable', 'high')").withColumn("window_no", F.expr("(t div 604800000000) % 4"))
    near = nearest_of(F.col("lat"), F.col("lon"), HOTSPOTS[:1])["km"] <= 40
    r = report.sampled_near_share(rows.withColumn("near", near), ("window_no", "tier"), "event_id", "near", 50)
    return r.withColumn("pct", F.round("pct", 6))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderdate, o_orderkey DESC) place FROM orders")
def S_01_mixed_order(s, d):
    """Several keys in mixed directions decide the place of each row."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderdate", F.desc("o_orderkey"))
    return src.table(s, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT p_partkey, coalesce(list_reduce(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w<>''), lambda a, w: CASE WHEN length(split_part(a, chr(10), -1))+1+length(w)<=24 THEN a||' '||w ELSE a||chr(10)||w END), '') wrapped FROM (SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type, p_name, p_type) t FROM part)")
def K_31_word_wrap(s, d):
    t = F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_name", "p_type")
    return src.table(s, d, "part").select("p_partkey", views.wrap_text(t, 24).alias("wrapped"))


# runs with SQL of their own


def _sweep(i: int, km: float, h: float, m: int) -> str:
    return f""", nb{i} AS (SELECT a.episode_id a, b.episode_id b FROM ep a JOIN ep b ON abs(a.t-b.t)<={int(h * 3600000000)} AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}<={km}),
co{i} AS (SELECT a FROM nb{i} GROUP BY 1 HAVING count(*)>={m}), ce{i} AS (SELECT n.a, n.b FROM nb{i} n JOIN co{i} x ON x.a=n.a JOIN co{i} y ON y.a=n.b),
rc{i}(a, b) AS (SELECT a, b FROM ce{i} UNION SELECT r.a, c.b FROM rc{i} r JOIN ce{i} c ON r.b=c.a), cl{i} AS (SELECT a, min(b) root FROM rc{i} GROUP BY 1)"""


SWEEPS = [(5.0, 1.0, 2), (5.0, 4.0, 2), (8.0, 1.0, 2), (8.0, 4.0, 2), (8.0, 4.0, 3), (8.0, 4.0, 4)]


@query(_recursive(BASE + ANOM + "".join(_sweep(i, *p) for i, p in enumerate(SWEEPS)) + " " + " UNION ALL ".join(f"SELECT {km}::double eps_km, {h}::double eps_h, {m} min_pts, (SELECT count(DISTINCT root) FROM cl{i}) clusters, (SELECT count(*) FROM ep WHERE episode_id NOT IN (SELECT a FROM cl{i}) AND episode_id NOT IN (SELECT n.a FROM nb{i} n JOIN cl{i} c ON c.a=n.b)) noise" for i, (km, h, m) in enumerate(SWEEPS))))
def G_02_parameter_sweep(s, d):
    """Radii and least sizes of clusters, one setting after another."""
    e = cut(cluster.episodes(cluster.anomalies(_classified(s, d), _triples(s, d))))
    runs = [cluster.st_dbscan(e, km, h, m).agg(F.count_if(F.col("cluster") < 0).alias("noise"), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters")).select(F.lit(km).alias("eps_km"), F.lit(h).alias("eps_h"), F.lit(m).alias("min_pts"), "clusters", "noise") for km, h, m in SWEEPS]
    return reduce(DataFrame.unionByName, runs)


_MERCHANT = BASE + ", aism AS (SELECT * FROM ais WHERE vessel_type IN ('CARGO','OTHER','TANKER') AND NOT (vessel_type='OTHER' AND regexp_matches(ship_name,'(?i)fish|net|buoy')))"


@query(_recursive(_MERCHANT + ANOM.replace("FROM ais WINDOW", "FROM aism WINDOW") + DBS + KEEP + " SELECT 'episodes_clustered_'||(cluster>=0) what, count(*) n FROM lab GROUP BY 1 UNION ALL SELECT classification, count(*) FROM clf GROUP BY 1 UNION ALL SELECT 'kept_'||keep, count(*) FROM kept GROUP BY 1"))
def R_01_window_run(s, d):
    r = window_run.run_window(_sar(s, d), _ais(s, d), types=("CARGO", "OTHER", "TANKER"))
    c = r.clusters.groupBy((F.col("cluster") >= 0).alias("clustered")).agg(F.count("*").alias("n"))
    return c.select(F.concat(F.lit("episodes_clustered_"), F.col("clustered").cast("string")).alias("what"), "n").union(r.classified.groupBy("classification").count()).union(r.kept_links.groupBy(F.concat(F.lit("kept_"), F.col("keep").cast("string"))).count())
