"""Queries that store the tables in the domain's file layouts and read them again, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrack.catalog import BASE, CLS, _ais, _classified, _sar, query
from veritrack.catalog_history import EVT
from veritrack.plans.lineage import scratch
from veritrack.sources import adapters as src
from veritrack.sources import files, sinks
from veritrack.sources.report_pages import folder_value, read_pages, write_pages

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _iso(us: str):
    return F.date_format(F.timestamp_micros(us), _ISO)


PAGES = BASE + ", pg AS (SELECT *, t//86400000000 AS day, floor(lat)::bigint||'x'||floor(lon)::bigint tile FROM ais)"


def _report_pages(s, d, page: int = 100):
    row = F.struct(F.col("mmsi").cast("string").alias("mmsi"), F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd HH:mm").alias("date"), "lat", "lon", F.col("ship_name").alias("shipName"), F.col("vessel_type").alias("vesselType"))
    rows = _ais(s, d).select("event_id", F.lit("presence").alias("dataset"), F.expr("t div 86400000000").alias("day"), F.concat(F.floor("lat"), F.lit("x"), F.floor("lon")).alias("tile"), row.alias("row"))
    path = scratch(s)
    write_pages(rows, ("dataset", "day", "tile"), "event_id", lambda r: F.array(F.create_map(F.lit("presence"), r)), path, page)
    return read_pages(s, path, 3)


@query(PAGES + " SELECT day, tile, count(*) n, count(DISTINCT mmsi) n_vessels, ((count(*)+99)//100)::bigint n_pages, round(sum(lat),4) s FROM pg GROUP BY 1,2")
def SRC_01_report_pages(s, d):
    """Regional reports by dataset, day and tile, read page after page from what is stored."""
    pages = _report_pages(s, d).select(folder_value("day").cast("long").alias("day"), folder_value("tile").alias("tile"), "page_offset", "json")
    rows = pages.select("day", "tile", "page_offset", F.explode(F.from_json("json", files.REPORT)["entries"]).alias("e")).select("day", "tile", "page_offset", F.explode(F.map_values("e")).alias("rows")).select("day", "tile", "page_offset", F.inline("rows"))
    return rows.groupBy("day", "tile").agg(F.count("*").alias("n"), F.countDistinct("mmsi").alias("n_vessels"), F.countDistinct("page_offset").alias("n_pages"), F.round(F.sum("lat"), 4).alias("s"))


def _event_pages(s, d):
    kind = lambda k, **fields: F.when(F.col("event_type") == k, F.struct(*[v.alias(n) for n, v in fields.items()]))
    hours = F.col("duration_hrs")
    row = F.struct(_iso("t_start").alias("start"), _iso("t_end").alias("end"), F.when(F.col("event_type") == "ais_gap", "gap").otherwise(F.col("event_type")).alias("type"), F.struct("lat", "lon").alias("position"), F.struct(F.array("country").alias("eez")).alias("regions"),
                   kind("port_visit", durationHrs=hours, confidence=F.lit("4")).alias("port_visit"), kind("loitering", totalTimeHours=hours, averageSpeedKnots=F.lit(1.5)).alias("loitering"), kind("ais_gap", durationHours=hours).alias("gap"), kind("encounter", medianSpeedKnots=F.lit(0.5), durationHours=hours).alias("encounter"))
    path = scratch(s)
    # vessels share a folder for each remainder, so that there are few folders at any size
    rows = src.vessel_events(s, d).select((F.col("mmsi") % 16).alias("shard"), "mmsi", "event_id", F.struct("mmsi", row.alias("e")).alias("row"))
    write_pages(rows, ("shard",), "event_id", lambda r: F.transform(r, lambda x: F.struct(x["mmsi"].alias("mmsi"), F.to_json(F.struct(F.array(x["e"]).alias("entries"))).alias("json"))), path, 500)
    stored = read_pages(s, path, 1)
    return stored.select(F.inline(F.from_json("json", "entries array<struct<mmsi: long, json: string>>")["entries"]))


_ZONES = {"C0": "First zone", "C1": "Second zone"}


@query("WITH " + EVT + " SELECT mmsi, event_type, count(*) n, min(t_start) t_first, sum(floor(duration_hrs*1000)::bigint)::bigint millihours, string_agg(DISTINCT CASE country WHEN 'C0' THEN 'First zone' WHEN 'C1' THEN 'Second zone' ELSE 'EEZ:'||country END, ',' ORDER BY CASE country WHEN 'C0' THEN 'First zone' WHEN 'C1' THEN 'Second zone' ELSE 'EEZ:'||country END) zones FROM ev GROUP BY 1,2")
def SRC_10_SRC_12_SRC_13_K_32_event_pages(s, d):
    """Deep events of all vessels from stored pages, kept after the first reading and read from there the second time."""
    path = scratch(s)
    load = lambda: files.flatten_events(_event_pages(s, d), eez=_ZONES)
    files.cache_or_fetch(s, path, load)
    e = files.cache_or_fetch(s, path)
    return e.groupBy("mmsi", "event_type").agg(F.count("*").alias("n"), F.min(F.unix_micros("start")).alias("t_first"), F.sum(F.floor(F.col("duration_hrs") * 1000)).alias("millihours"), F.array_join(F.sort_array(F.collect_set("eez")), ",").alias("zones"))


@query(BASE + " SELECT 'sar' kind, count(*) n, count(mmsi) n_mmsi, round(sum(lat),4) s, min(t) t0 FROM sar UNION ALL SELECT 'ais', count(*), count(mmsi), round(sum(lat),4), min(t) FROM ais UNION ALL SELECT 'slim', count(*), count(mmsi), round(sum(lat),4), min(t) FROM ais")
def SRC_05_SRC_20_SNK_01_window_csv(s, d):
    """A window stored as a pair of CSV files, read whole and by its position columns alone."""
    path, none = scratch(s), F.lit(None).cast("string")
    sar = _sar(s, d).select(F.col("sar_id").cast("string").alias("sar_id"), _iso("t").alias("timestamp"), "lat", "lon", "mmsi", F.col("mmsi").isNotNull().alias("ais_matched"), none.alias("ship_name"), none.alias("flag"), none.alias("vessel_type"))
    ais = _ais(s, d).select("mmsi", _iso("t").alias("timestamp"), "lat", "lon", "ship_name", none.alias("flag"), "vessel_type")
    for name, df in (("sar_detections", sar), ("ais_positions", ais)):
        df.write.mode("overwrite").option("header", True).csv(f"{path}/w_{name}.csv")
    a, b = files.read_window(s, path, "w")
    sums = lambda df, kind: df.agg(F.count("*").alias("n"), F.count("mmsi").alias("n_mmsi"), F.round(F.sum("lat"), 4).alias("s"), F.min(F.unix_micros("timestamp")).alias("t0")).select(F.lit(kind).alias("kind"), "n", "n_mmsi", "s", "t0")
    return sums(a, "sar").union(sums(b, "ais")).union(sums(files.slim_positions(s, f"{path}/w_ais_positions.csv"), "slim"))


@query(BASE + " SELECT count(*) n, count(DISTINCT sar_id) n_ids, count(mmsi) n_mmsi, count(*) FILTER (mmsi IS NOT NULL) n_matched, round(sum(lat),4) s FROM sar")
def SRC_03_sar_payload(s, d):
    """Detections through a report payload and the normaliser: blank vessels become null, keys are made of what a row says."""
    row = F.struct(F.coalesce(F.col("mmsi").cast("string"), F.lit("")).alias("mmsi"), _iso("t").alias("entryTimestamp"), "lat", "lon", F.lit(" ").alias("shipName"))
    payload = _sar(s, d).groupBy(F.expr("hour div 24").alias("day")).agg(F.to_json(F.struct(F.array(F.create_map(F.lit("sar"), F.collect_list(row))).alias("entries"))).alias("json"))
    n = files.normalise_sar(files.flatten_report(payload))
    return n.agg(F.count("*").alias("n"), F.countDistinct("sar_id").alias("n_ids"), F.count("mmsi").alias("n_mmsi"), F.count_if("ais_matched").alias("n_matched"), F.round(F.sum("lat"), 4).alias("s"))


@query("SELECT c_custkey%100 AS shard, count(*) n, sum(1990+c_custkey%35)::bigint built, count(*) FILTER (c_custkey%3<>0) n_owned FROM customer GROUP BY 1")
def SRC_17_caches(s, d):
    """The age cache as JSON objects keyed by vessel, one file for each hundredth of the fleet."""
    path = scratch(s)
    entry = F.struct((1990 + F.col("c_custkey") % 35).alias("built_year"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name_seen"))
    made = src.table(s, d, "customer").groupBy((F.col("c_custkey") % 100).alias("shard")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), entry)))).alias("value"))
    made.write.partitionBy("shard").text(path)
    return files.read_cache(s, path, "built_year: int, name_seen: string").groupBy((F.col("mmsi") % 100).alias("shard")).agg(F.count("*").alias("n"), F.sum("built_year").alias("built"), F.count("name_seen").alias("n_owned"))


@query("WITH " + EVT + " SELECT mmsi, count(*) n, round(sum(lat),3) s, count(t_end) n_ended FROM ev WHERE mmsi%50=7 GROUP BY 1")
def SRC_18_SRC_20_deep_history_files(s, d):
    """Histories of some vessels kept as a file each; who has one is read from the names."""
    path = scratch(s)
    e = src.vessel_events(s, d).where("mmsi % 50 = 7").select("mmsi", "event_type", _iso("t_start").alias("start"), _iso("t_end").alias("end"), "lat", "lon", "duration_hrs")
    files.keep_histories(e, path)
    kept = files.bootstrap_from_files(s, f"{path}/*", r"history_(\d+)").select("mmsi").distinct()
    return files.deep_history(s, path).join(kept, "mmsi", "left_semi").groupBy("mmsi").agg(F.count("*").alias("n"), F.round(F.sum("lat"), 3).alias("s"), F.count("end").alias("n_ended"))


@query(BASE + CLS + " SELECT cls, count(*) n, count(mmsi) n_mmsi, round(sum(km),3) s FROM (SELECT classification cls, coalesce(matched_mmsi, mmsi) mmsi, distance_km km FROM clf UNION ALL SELECT CASE WHEN sar_id%5=0 THEN 'unmatched' WHEN sar_id%5=1 THEN 'matched' WHEN sar_id%5=2 THEN 'discrepant' WHEN sar_id%5=3 THEN 'likely_spoofed' ELSE 'unmatched' END, mmsi, (sar_id%9)::double FROM sar) GROUP BY 1")
def SRC_19_K_29_layouts(s, d):
    """Two window layouts in one view."""
    c = _classified(s, d).select(F.col("lat").alias("sar_lat"), F.col("lon").alias("sar_lon"), "classification", "matched_mmsi", "mmsi", "distance_km")
    state = "CASE sar_id%5 WHEN 0 THEN 'dark_vessel' WHEN 1 THEN 'gfw_locked' WHEN 2 THEN 'relinked' WHEN 3 THEN 'forced_low_confidence' ELSE 'other' END AS link_status"
    r = _sar(s, d).selectExpr("lat AS sar_lat", "lon AS sar_lon", state, "CASE WHEN sar_id%2=0 THEN mmsi END AS relinked_mmsi", "mmsi AS gfw_mmsi", "CAST(sar_id%9 AS DOUBLE) AS relinked_dist_km")
    return files.window_layouts(c, r).groupBy("cls").agg(F.count("*").alias("n"), F.count("mmsi").alias("n_mmsi"), F.round(F.sum("km"), 3).alias("s"))


@query("WITH x AS (SELECT o_custkey mmsi, o_orderkey k, o_totalprice/1000 h FROM orders), e AS (SELECT mmsi, count(*) flagged_events, max('VESSEL '||(k%3)) ship_name FROM x WHERE h>300 AND k%4<>0 GROUP BY 1) SELECT mmsi, 'w' AS \"window\", true observed, flagged_events, 'prolonged_dwell_at_flagged_facility' event_type, ship_name FROM e")
def SRC_22_escalating_dwell(s, d):
    """Escalating dwell episodes of a flags file as flag events with names."""
    path = scratch(s)
    x = src.table(s, d, "orders").selectExpr("o_custkey AS mmsi", "concat('VESSEL ', o_orderkey%3) AS ship_name", "CASE WHEN o_orderkey%4<>0 THEN 1.5 END AS lat", "2.5 AS lon", "o_totalprice/1000 AS duration_h", "o_totalprice/1000 > 300 AS escalate")
    x.write.option("header", True).csv(path)
    return files.dwell_flag_events(files.escalating_dwell(s, path), "w")


@query("SELECT o_orderpriority region, round(avg(o_totalprice)/1e5,6) matched_km, round(max(o_totalprice)/1e4,6) likely_spoofed_km, NULL::double p95_km, count(*) n_confirmed, CASE WHEN count(*)>200 THEN 'ok' ELSE 'low' END confidence, round(min(o_totalprice),3) p10 FROM orders GROUP BY 1")
def SRC_21_SNK_02_calibration_reports(s, d):
    """Calibration reports of several regions written as JSON and read by the fields that views need."""
    path = scratch(s)
    o = src.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("region")).agg((F.avg("o_totalprice") / 1e5).alias("m"), (F.max("o_totalprice") / 1e4).alias("l"), F.count("*").alias("n"), F.min("o_totalprice").alias("low"))
    nested = o.select("region", F.struct(F.round("m", 6).alias("matched_km"), F.round("l", 6).alias("likely_spoofed_km")).alias("derived_thresholds"), F.struct(
        F.create_map(F.lit("p10"), F.round("low", 3)).alias("confirmed_pair_percentiles_km"), F.col("n").alias("n_confirmed_identity_pairs"), F.when(F.col("n") > 200, "ok").otherwise("low").alias("confidence")).alias("sar_ais_distance_calibration"))
    sinks.write_report(nested.repartition(F.col("region")), path)
    return s.read.schema(files.CALIBRATION).json(path).transform(files.calibration_fields).select("region", "matched_km", "likely_spoofed_km", "p95_km", "n_confirmed", "confidence", F.col("percentiles")["p10"].alias("p10"))


@query("SELECT c_custkey mmsi, CASE WHEN c_custkey%3=0 THEN 'new' ELSE 'old' END state FROM customer WHERE c_custkey%2=0 OR c_custkey%3=0")
def SNK_04_upsert(s, d):
    """A cache log with rows replaced and added, as a new version."""
    c = src.table(s, d, "customer").select(F.col("c_custkey").alias("mmsi"))
    return sinks.upsert(c.where("mmsi % 2 = 0").withColumn("state", F.lit("old")), c.where("mmsi % 3 = 0").withColumn("state", F.lit("new")), "mmsi", scratch(s))


@query("SELECT label, label<>'absent' present FROM (SELECT DISTINCT o_orderpriority label FROM orders UNION ALL SELECT 'absent')")
def SRC_23_file_audit(s, d):
    """Which of the expected files are there."""
    path = scratch(s)
    src.table(s, d, "orders").select(F.col("o_orderpriority").alias("p")).distinct().withColumn("v", F.lit(1)).write.partitionBy("p").parquet(path)
    labels = [r.p for r in src.table(s, d, "orders").select(F.col("o_orderpriority").alias("p")).distinct().collect()]
    return files.file_audit(s, [(x, f"{path}/p={x}") for x in [*labels, "absent"]]).select("label", "present")
