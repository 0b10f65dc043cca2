"""Queries on identities, baselines, cluster membership and runs over several windows, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrack.catalog import ANOM, ARTIFACTS, BASE, CLS, DBS, FLG, _ais, _classified, _episodes, _flags, _recursive, _sar, _top_ranked, _triples, hav, query
from veritrack.operators import cluster, identity, report, routes, score
from veritrack.plans.lineage import cut
from veritrack.sources import adapters as src
from veritrack.sources import files

# identities

REP = """WITH ro AS (SELECT o_orderkey k, o_custkey m, epoch_us(o_orderdate) us FROM orders),
rp AS (SELECT m mmsi, 'r'||k id, (CASE WHEN k%11=0 THEN m+1 ELSE m END)::varchar ssvid, CASE WHEN k%10=0 THEN NULL WHEN k%13=0 THEN 'PAN' ELSE list_extract(['GAB','PAN','USA','CHN','CMR','LBR','IND'], 1+m%7) END flag,
 CASE WHEN k%6=0 THEN NULL WHEN k%17=0 THEN 'RENAMED '||m ELSE 'VESSEL '||m END name_, (m*10)::varchar imo, us t_from, us+(k%40)*86400000000 t_to, k*7919%3000 positions FROM ro),
hi AS (SELECT * FROM rp WHERE positions>=1000 OR name_ IS NOT NULL)"""
CUR = """, cu AS (SELECT mmsi, coalesce(bool_or(ssvid=mmsi::varchar),false) available, arg_max(struct_pack(id:=id, name_:=name_, flag:=flag, imo:=imo, positions:=positions, t_from:=t_from, t_to:=t_to), (name_ IS NOT NULL, t_to, t_from, id)) FILTER (ssvid=mmsi::varchar) c FROM rp GROUP BY 1),
pa AS (SELECT mmsi, count(DISTINCT flag) n_flags, count(DISTINCT name_) n_names, count(*) n_reports FROM hi GROUP BY 1),
idn AS (SELECT cu.mmsi, available, c.id id, c.name_ AS name, c.flag flag, c.imo imo, c.positions positions, c.t_from t_from, c.t_to t_to, coalesce(n_flags,0) n_flags, coalesce(n_names,0) n_names, coalesce(n_reports,0) n_reports FROM cu LEFT JOIN pa USING (mmsi))"""
ITV = """, h1 AS (SELECT *, row_number() OVER w rn, lag(flag) OVER w f0, lag(name_) OVER w n0, last_value(flag IGNORE NULLS) OVER p kf, last_value(name_ IGNORE NULLS) OVER p kn FROM hi WINDOW w AS (PARTITION BY mmsi ORDER BY t_from, t_to, id), p AS (PARTITION BY mmsi ORDER BY t_from, t_to, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h2 AS (SELECT *, sum((rn=1 OR flag IS DISTINCT FROM f0 OR name_ IS DISTINCT FROM n0)::int) OVER (PARTITION BY mmsi ORDER BY rn)::bigint seq FROM h1),
h3 AS (SELECT mmsi, seq, any_value(flag) flag, any_value(name_) AS name, min(t_from) t_from, max(t_to) t_to, bool_or(coalesce(kf<>flag,false)) reflagged, bool_or(coalesce(kn<>name_,false)) renamed FROM h2 GROUP BY 1,2),
iv AS (SELECT *, lead(t_from) OVER (PARTITION BY mmsi ORDER BY seq) valid_to FROM h3)"""


def _reports(s, d):
    return files.identity_reports(src.identity_payloads(s, d))


@query(REP + CUR + " SELECT * FROM idn")
def SRC_09_identity(s, d):
    return identity.current_identity(_reports(s, d))


@query(REP + ITV + " SELECT * FROM iv")
def SRC_09_validity_intervals(s, d):
    return identity.validity_intervals(_reports(s, d))


@query(REP + ITV + " SELECT mmsi, count(*) FILTER (reflagged) n_reflags, count(*) FILTER (renamed) n_renames, coalesce(string_agg(coalesce(flag,'?'),'>' ORDER BY seq) FILTER (seq=1 OR reflagged),'') flags FROM iv GROUP BY 1")
def SRC_09_changes(s, d):
    return identity.change_counts(identity.validity_intervals(_reports(s, d)))


# baselines

EVT = """ev AS (SELECT k event_id, m mmsi, CASE WHEN m%4=1 THEN CASE WHEN k%2=0 THEN 'port_visit' ELSE 'loitering' END WHEN k%6=3 THEN 'loitering' WHEN k%6=4 THEN 'ais_gap' WHEN k%6=5 THEN 'encounter' ELSE 'port_visit' END event_type, us t_start, us+floor(p*7200000)::bigint t_end,
 (CASE WHEN m%3=0 THEN 2500+(k*37)%400 ELSE 500+(k*37)%4500 END)::double/100 lat, (CASE WHEN m%3=0 THEN 5500+(k*91)%500 ELSE 3000+(k*91)%6000 END)::double/100 lon, p/500 duration_hrs, 'C'||(k%(m%5+1)) country FROM (SELECT o_orderkey k, o_custkey m, o_totalprice p, epoch_us(o_orderdate) us FROM orders))"""


def _foc(s, d):
    return src.particulars(s, d).select("mmsi", score.foc_tier(F.col("flag")).alias("foc_tier"))


@query(BASE + CLS + ", " + EVT + ", " + REP.removeprefix("WITH ") + CUR + f""", ob AS (SELECT mmsi, min(lat) y0, max(lat) y1, min(lon) x0, max(lon) x1, round({hav('min(lat)', 'min(lon)', 'max(lat)', 'max(lon)')},0) extent_km, CASE WHEN count(*) FILTER (event_type='port_visit')>=2 THEN max(duration_hrs) FILTER (event_type='port_visit') END stay,
 count(DISTINCT country) FILTER (event_type='port_visit') ncty, count(*) FILTER (event_type='ais_gap') ngap, count(*) FILTER (event_type='encounter') nenc FROM ev GROUP BY 1),
fg AS (SELECT mmsi, CASE WHEN sar_id%7<>0 THEN lat END lat, lon FROM clf WHERE classification='likely_spoofed' AND mmsi IS NOT NULL),
sh AS (SELECT f.mmsi, count(*) n_flagged, count(f.lat) n_located, count(*) FILTER (f.lat BETWEEN y0-0.75 AND y1+0.75 AND f.lon BETWEEN x0-0.75 AND x1+0.75) n_in FROM fg f JOIN ob ON ob.mmsi=f.mmsi GROUP BY 1),
fo AS (SELECT c_custkey mmsi, c_nationkey%7 IN (0,4) shadow FROM customer),
al AS (SELECT sh.*, ob.* EXCLUDE (mmsi), shadow, coalesce(idn.n_flags,1) nf, coalesce(idn.n_names,1) nn, CASE WHEN idn.t_to>idn.t_from THEN round(idn.positions/((idn.t_to-idn.t_from)/8.64e10),0) END ppd FROM sh JOIN ob USING (mmsi) LEFT JOIN idn ON idn.mmsi=sh.mmsi LEFT JOIN fo ON fo.mmsi=sh.mmsi),
li AS (SELECT *, n_in/nullif(n_located,0) share, list_filter([CASE WHEN shadow THEN 'shadow_fleet' END, CASE WHEN nf>=2 THEN 'reflagged' END, CASE WHEN nn>=2 THEN 'renamed' END, CASE WHEN stay>504 THEN 'lay_up' END, CASE WHEN extent_km<1500 AND ncty<=2 THEN 'confined' END, CASE WHEN ngap>=3 THEN 'reporting_gaps' END], lambda x: x IS NOT NULL) odd,
 list_filter([CASE WHEN ngap=0 THEN 'no_gaps' END, CASE WHEN nenc=0 THEN 'no_encounters' END, CASE WHEN ncty>=4 THEN 'many_countries' END, CASE WHEN extent_km>4000 THEN 'international' END, CASE WHEN nf=1 AND nn=1 THEN 'stable_identity' END, CASE WHEN ppd>200 THEN 'dense_positions' END], lambda x: x IS NOT NULL) clean FROM al)
SELECT mmsi, n_flagged, n_located, round(share,6)::double share, array_to_string(odd,';') odd, array_to_string(clean,';') clean, CASE WHEN NOT coalesce(share>=0.6,false) THEN 'outside_baseline' WHEN len(odd)>=2 AND len(odd)>=len(clean) THEN 'persistent' WHEN len(odd)>=1 THEN 'mixed' ELSE 'ordinary' END reading FROM li""")
def A_23_K_13_J_19_baseline_reading(s, d):
    flags = _classified(s, d).where("classification = 'likely_spoofed' and mmsi is not null").select("mmsi", F.when(F.col("sar_id") % 7 != 0, F.col("lat")).alias("lat"), "lon")
    days = (F.col("t_to") - F.col("t_from")) / 8.64e10
    who = identity.current_identity(_reports(s, d)).select("mmsi", "n_flags", "n_names", F.round(F.when(days > 0, F.try_divide(F.col("positions"), days)), 0).alias("positions_per_day"))
    r = report.baseline_reading(flags, report.operating_baseline(src.vessel_events(s, d)), _foc(s, d).join(who, "mmsi", "left"))
    return r.withColumn("share", F.round("share", 6))


# clusters and their pings

COH = f""", cc AS (SELECT cluster, avg(lat) cy, avg(lon) cx, count(*) n_episodes, count(DISTINCT vessel) n_vessels, (max(t_end)-min(t_start))/3.6e9 span_h FROM lab JOIN ep USING (episode_id) WHERE cluster>=0 GROUP BY 1),
rr AS (SELECT cluster, max({hav('cy', 'cx', 'lat', 'lon')}) radius_km FROM lab JOIN ep USING (episode_id) JOIN cc USING (cluster) GROUP BY 1),
cs AS (SELECT cc.*, CASE WHEN n_vessels>=2 AND span_h<=6 AND radius_km<=10 THEN 'genuine' WHEN n_vessels>=2 THEN 'loose' ELSE 'single_vessel_artifact' END coherence FROM cc JOIN rr USING (cluster))"""


def _labelled(s, d):
    found = cut(cluster.st_dbscan(_episodes(s, d)).withColumn("cluster", F.col("cluster").cast("int")))
    return found, cluster.cluster_summary(found)


@query(_recursive(BASE + ANOM + DBS + COH + " SELECT ru.vessel, ru.t, ru.source, lab.episode_id, lab.cluster, coalesce(coherence,'noise') coherence FROM ru JOIN lab ON lab.episode_id=ru.vessel||'-'||ru.run LEFT JOIN cs ON cs.cluster=lab.cluster"))
def R_02_pings_with_clusters(s, d):
    found, summary = _labelled(s, d)
    pings = cluster.propagate(cluster.anomalies(_classified(s, d), _triples(s, d)), found, summary)
    return pings.select("vessel", "t", "source", "episode_id", "cluster", "coherence")


ISO = """, le AS (SELECT ep.*, cluster FROM ep JOIN lab USING (episode_id)), sp0 AS (SELECT vessel, min(t_start) a, max(t_end) b FROM le GROUP BY 1), me AS (SELECT vessel, cluster, count(*) n_own FROM le GROUP BY 1,2),
gp AS (SELECT m.vessel, m.cluster, min(greatest(0, s.a-o.t_end, o.t_start-s.b))/3.6e9 gap FROM me m JOIN sp0 s USING (vessel) JOIN le o ON o.cluster=m.cluster AND o.vessel<>m.vessel WHERE m.cluster>=0 GROUP BY 1,2)"""


@query(_recursive(BASE + ANOM + DBS + COH + ISO + """ SELECT m.vessel, m.cluster, n_own, coalesce(n_vessels-1,0) n_other_vessels, round(gap,6)::double nearest_gap_h, CASE WHEN m.cluster<0 THEN 'isolated' WHEN n_vessels=1 THEN 'alone' WHEN coherence='genuine' THEN 'contemporaneous' ELSE 'not_contemporaneous' END status
 FROM me m LEFT JOIN cs ON cs.cluster=m.cluster LEFT JOIN gp ON gp.vessel=m.vessel AND gp.cluster=m.cluster"""))
def R_05_J_18_isolation(s, d):
    found, summary = _labelled(s, d)
    return cluster.isolation(found, summary).withColumn("nearest_gap_h", F.round("nearest_gap_h", 6))


# routes

CHN = f""", c0 AS (SELECT event_id, mmsi, lat, lon, t_start, event_type, lag(coalesce(t_end,t_start)) OVER w pt, lag(lat) OVER w py, lag(lon) OVER w px, lag(event_type) OVER w pe FROM ev WINDOW w AS (PARTITION BY mmsi ORDER BY t_start, event_id)),
ch AS (SELECT event_id, mmsi, {hav('py', 'px', 'lat', 'lon')} km, (t_start-pt)/3.6e9 AS hours, pe||'->'||event_type prior_tier FROM c0 WHERE pt IS NOT NULL)"""


def _verdict(lim: str) -> str:
    return f"CASE WHEN hours IS NULL THEN 'UNDETERMINED' WHEN hours<=1.0/60 AND km>=5 THEN 'PHYSICALLY_IMPOSSIBLE' WHEN hours<=1.0/60 AND km>=1 THEN 'IMPLAUSIBLE_BUT_POSSIBLE' WHEN hours<=1.0/60 OR km<1 THEN 'PLAUSIBLE' WHEN km/hours/1.852>45 THEN 'PHYSICALLY_IMPOSSIBLE' WHEN km/hours/1.852>{lim} THEN 'IMPLAUSIBLE_BUT_POSSIBLE' ELSE 'PLAUSIBLE' END"


@query("WITH " + EVT + CHN + f" SELECT event_id, mmsi, round(km,6) km, round(hours,6) AS hours, prior_tier, CASE WHEN hours>0 THEN round(km/hours/1.852,6) END required_knots, {_verdict('(CASE WHEN mmsi%6 IN (0,1) THEN 16 ELSE 22 END)')} classification FROM ch")
def W_02_event_chains(s, d):
    r = routes.judged(routes.event_chain(src.vessel_events(s, d)), src.particulars(s, d))
    return r.select("event_id", "mmsi", F.round("km", 6).alias("km"), F.round("hours", 6).alias("hours"), "prior_tier", F.round("required_knots", 6).alias("required_knots"), "classification")


@query(BASE + ANOM + FLG + ", " + EVT + CHN + f""", tn AS (SELECT 'trajectory' source, mmsi, {hav('y0', 'x0', 'lat', 'lon')} km, gap12 AS hours, tier prior_tier, gap12 gap_h FROM trc UNION ALL
 SELECT 'sar_vs_ais', coalesce(mmsi, matched_mmsi), distance_km, time_gap_seconds/3600, classification, time_gap_seconds/3600 FROM clf WHERE distance_km IS NOT NULL UNION ALL SELECT 'event_chain', mmsi, km, hours, prior_tier, NULL FROM ch),
tj AS (SELECT *, {_verdict("(CASE WHEN mmsi%7=0 THEN 16 ELSE 22 END)")} classification FROM tn),
wt AS (SELECT vessel FROM con WHERE NOT is_known_artifact ORDER BY flag_rate DESC, total_flags DESC, vessel LIMIT 14),
pt AS (SELECT 'by_source' part, source item, classification FROM tj UNION ALL SELECT 'by_source', 'TOTAL', classification FROM tj
 UNION ALL SELECT 'discriminator', CASE WHEN coalesce(gap_h,0)>6 THEN 'explained' ELSE 'unexplained' END, classification FROM tj WHERE source='trajectory' AND classification IN ('PHYSICALLY_IMPOSSIBLE','IMPLAUSIBLE_BUT_POSSIBLE')
 UNION ALL SELECT 'retro', 'high', classification FROM tj WHERE source='trajectory' AND prior_tier='high' AND gap_h>10 AND mmsi IN (SELECT vessel FROM wt)
 UNION ALL SELECT 'disagreement', prior_tier, classification FROM tj WHERE prior_tier IN ('high','likely_spoofed'))
SELECT part, item, classification, count(*) n FROM pt GROUP BY 1,2,3""")
def A_37_route_summaries(s, d):
    triples, classified = _triples(s, d), cut(_classified(s, d))
    everything = routes.all_transitions(triples, classified, src.vessel_events(s, d))
    top = _top_ranked(score.consolidate(_flags(s, d, cluster.anomalies(classified, triples)), ARTIFACTS))
    kinds = src.table(s, d, "customer").selectExpr("c_custkey AS mmsi", "CASE WHEN c_custkey%7=0 THEN 'FISHING' WHEN c_custkey%5=0 THEN 'OTHER' WHEN c_custkey%3=0 THEN 'TANKER' ELSE 'CARGO' END AS vessel_type")
    return routes.route_summaries(routes.judged(everything, kinds), top.select("vessel"))
