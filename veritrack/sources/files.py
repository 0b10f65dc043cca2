"""Readers of the domain's files: CSV windows, report and identity payloads, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrack.operators.trajectory import norm_type
from veritrack.plans.lineage import exists

SAR_CSV = "sar_id string, timestamp string, lat double, lon double, mmsi string, ais_matched boolean, ship_name string, flag string, vessel_type string"
AIS_CSV = "mmsi string, timestamp string, lat double, lon double, ship_name string, flag string, vessel_type string"
REPORT = "entries array<map<string, array<struct<mmsi:string, date:string, lat:double, lon:double, shipName:string, flag:string, vesselType:string, entryTimestamp:string>>>>"
IDENTITY = "entries array<struct<registryInfo:array<struct<flag:string, imo:string, shipname:string, builtYear:int>>, selfReportedInfo:array<struct<flag:string, shipname:string, ssvid:string, transmissionDateTo:string, positionsCounter:long>>, combinedSourcesInfo:array<struct<shiptypes:array<struct<name:string>>, geartypes:array<struct<name:string>>>>>>"
VESSEL_EVENTS = "entries array<struct<start:string, `end`:string, type:string, position:struct<lat:double,lon:double>, regions:struct<eez:array<string>>, port_visit:struct<durationHrs:double,confidence:string>, loitering:struct<totalTimeHours:double,averageSpeedKnots:double>, gap:struct<durationHours:double>, encounter:struct<medianSpeedKnots:double,durationHours:double>>>, nextOffset long"
#: Types that say nothing, as normalised.
VAGUE_TYPES = ("", "other", "unknown", "insufficient_data", "other_non_fishing", "gear", "not_available", "none", "na", "n_a", "null")


def blank_to_null(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def bbox_polygon(min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> dict:
    """The closed ring of a box, as a request wants it."""
    ring = [[min_lon, min_lat], [max_lon, min_lat], [max_lon, max_lat], [min_lon, max_lat], [min_lon, min_lat]]
    return {"type": "Polygon", "coordinates": [ring]}


def flatten_report(payloads: DataFrame, column: str = "json") -> DataFrame:
    """Rows of a report payload: each entry maps a dataset to its rows."""
    e = payloads.select(F.explode(F.from_json(column, REPORT)["entries"]).alias("e"))
    return e.select(F.explode("e").alias("dataset", "rows")).select("dataset", F.explode("rows").alias("r")).select("dataset", "r.*")


def normalise_sar(rows: DataFrame) -> DataFrame:
    """Detections with a stable key from what they say, blank vessels as null, sorted columns; bad times become null."""
    mmsi = F.nullif(F.trim("mmsi"), F.lit(""))
    return rows.select(F.sha2(F.concat_ws("|", F.coalesce("entryTimestamp", F.lit("")), F.col("lat").cast("string"), F.col("lon").cast("string"), F.coalesce("mmsi", F.lit(""))), 256).alias("sar_id"), F.try_to_timestamp("entryTimestamp").alias("timestamp"), "lat", "lon",
                       mmsi.try_cast("long").alias("mmsi"), mmsi.isNotNull().alias("ais_matched"), F.col("shipName").alias("ship_name"), "flag", F.col("vesselType").alias("vessel_type"))


def normalise_ais(rows: DataFrame) -> DataFrame:
    """Presence rows: without blank vessels or unreadable hours."""
    t = F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm"))
    return rows.where(F.length(F.trim("mmsi")) > 0).select(F.col("mmsi").try_cast("long").alias("mmsi"), t.alias("timestamp"), "lat", "lon", F.col("shipName").alias("ship_name"), "flag", F.col("vesselType").alias("vessel_type")).where("timestamp is not null")


def read_window(spark: SparkSession, path: str, label: str) -> tuple[DataFrame, DataFrame]:
    """The detections and presence rows of a window kept as CSV."""
    read = lambda schema, name: spark.read.schema(schema).option("header", True).csv(f"{path}/{label}_{name}.csv")
    sar, ais = read(SAR_CSV, "sar_detections"), read(AIS_CSV, "ais_positions")
    return (sar.withColumn("timestamp", F.try_to_timestamp("timestamp")).withColumn("mmsi", F.col("mmsi").try_cast("double").cast("long")), ais.withColumn("timestamp", F.try_to_timestamp("timestamp")).withColumn("mmsi", F.col("mmsi").try_cast("double").cast("long")).na.drop(subset=["mmsi", "timestamp"]))


def flatten_identity(payloads: DataFrame, key: str = "mmsi", column: str = "json") -> DataFrame:
    """Flag, IMO, built year and the first specific type of each identity payload: registry before self-reports."""
    p = F.from_json(column, IDENTITY)["entries"]
    first = lambda a: F.get(F.filter(a, lambda x: x.isNotNull()), 0)
    part = lambda name, field: F.flatten(F.transform(p, lambda e: F.transform(F.coalesce(e[name], F.array()), lambda x: x[field])))
    kinds = F.flatten(F.transform(p, lambda e: F.flatten(F.transform(F.coalesce(e["combinedSourcesInfo"], F.array()), lambda c: F.concat(F.coalesce(c["shiptypes"], F.array()), F.coalesce(c["geartypes"], F.array()))))))
    specific = F.filter(F.transform(kinds, lambda k: k["name"]), lambda n: ~F.coalesce(norm_type(n).isin(*VAGUE_TYPES), F.lit(True)))
    return payloads.select(key, F.coalesce(first(part("registryInfo", "flag")), first(part("selfReportedInfo", "flag"))).alias("flag"), first(part("registryInfo", "imo")).alias("imo"), first(part("registryInfo", "builtYear")).alias("built_year"),
                           F.size(F.array_distinct(F.filter(part("selfReportedInfo", "flag"), lambda x: x.isNotNull()))).alias("n_flags"), F.get(specific, 0).alias("vessel_type"))


def flatten_events(payloads: DataFrame, key: str = "mmsi", column: str = "json", eez: dict[str, str] | None = None) -> DataFrame:
    """Four kinds of events as one table; zones by name, or ``EEZ:code`` where the name is unknown."""
    e = payloads.select(key, F.explode(F.from_json(column, VESSEL_EVENTS)["entries"]).alias("e"))
    names = F.create_map(*[F.lit(x) for kv in (eez or {}).items() for x in kv]) if eez else F.create_map(F.lit(""), F.lit(""))
    zones = F.array_join(F.transform(F.coalesce(F.col("e.regions.eez"), F.array()), lambda c: F.coalesce(F.try_element_at(names, c), F.concat(F.lit("EEZ:"), c))), ";")
    hours = F.coalesce("e.port_visit.durationHrs", "e.loitering.totalTimeHours", "e.gap.durationHours", "e.encounter.durationHours")
    return e.where(F.col("e.type").isin("port_visit", "loitering", "gap", "encounter")).select(key, F.when(F.col("e.type") == "gap", "ais_gap").otherwise(F.col("e.type")).alias("event_type"), F.try_to_timestamp("e.start").alias("start"), F.try_to_timestamp("e.end").alias("end"), "e.position.lat", "e.position.lon", hours.alias("duration_hrs"), F.col("e.port_visit.confidence").alias("confidence"), zones.alias("eez"), F.col("e.loitering.averageSpeedKnots").alias("avg_speed_kn"))


def read_cache(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object keyed by vessel as rows ``mmsi, <fields>``."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{value}>>").alias("m"))
    return doc.select(F.explode("m").alias("mmsi", "v")).select(F.col("mmsi").try_cast("long").alias("mmsi"), "v.*")


def bootstrap_from_files(spark: SparkSession, path: str, pattern: str = r"history_(\d+)\.csv") -> DataFrame:
    """Vessels with a kept history, by file name, and when it was last written."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path", "modificationTime")
    return files.select(F.regexp_extract("path", pattern, 1).try_cast("long").alias("mmsi"), F.col("modificationTime").alias("last_pulled")).where("mmsi is not null")


#: The class that a link's state stands for.
LINK_CLASSES = {"gfw_locked": "matched", "locked": "matched", "relinked": "discrepant", "forced_low_confidence": "likely_spoofed", "dark_vessel": "unmatched"}


def window_layouts(classified: DataFrame, relinked: DataFrame) -> DataFrame:
    """One view of two layouts: ``lat, lon, cls, mmsi, name, km``; rows without a place are left out.

    An unknown link state counts as unmatched. A relinked row without a vessel
    shows the one that it was given.
    """
    states = F.create_map(*[F.lit(x) for pair in LINK_CLASSES.items() for x in pair])
    has = lambda df, c: F.col(c) if c in df.columns else F.lit(None)
    place = [F.col("sar_lat").cast("double").alias("lat"), F.col("sar_lon").cast("double").alias("lon")]
    a = classified.select(*place, F.col("classification").alias("cls"), F.coalesce(has(classified, "matched_mmsi").cast("long"), has(classified, "mmsi").cast("long")).alias("mmsi"), has(classified, "ship_name").cast("string").alias("name"), F.col("distance_km").cast("double").alias("km"))
    b = relinked.select(*place, F.coalesce(F.try_element_at(states, F.col("link_status")), F.lit("unmatched")).alias("cls"), F.coalesce(F.col("relinked_mmsi").cast("long"), has(relinked, "gfw_mmsi").cast("long")).alias("mmsi"),
                        F.coalesce(has(relinked, "relinked_name").cast("string"), has(relinked, "gfw_ship_name").cast("string")).alias("name"), F.col("relinked_dist_km").cast("double").alias("km"))
    return a.unionByName(b).where("lat is not null and lon is not null")


SELF_REPORTS = "entries array<struct<selfReportedInfo:array<struct<id:string, ssvid:string, flag:string, shipname:string, imo:string, transmissionDateFrom:string, transmissionDateTo:string, positionsCounter:long>>>>"


def identity_reports(payloads: DataFrame, key: str = "mmsi", column: str = "json") -> DataFrame:
    """The self-reports of identity payloads, all entries of a payload together: times in microseconds, unreadable ones null."""
    e = payloads.select(key, F.explode(F.from_json(column, SELF_REPORTS)["entries"]).alias("e")).select(key, F.explode("e.selfReportedInfo").alias("r"))
    us = lambda c: F.unix_micros(F.try_to_timestamp(f"r.{c}"))
    return e.select(F.col(key).alias("mmsi"), "r.ssvid", "r.id", "r.flag", F.col("r.shipname").alias("name"), "r.imo", us("transmissionDateFrom").alias("t_from"), us("transmissionDateTo").alias("t_to"), F.col("r.positionsCounter").alias("positions"))


POSITION_COLUMNS = ("mmsi", "timestamp", "lat", "lon", "ship_name")


def slim_positions(spark: SparkSession, path: str) -> DataFrame:
    """The position columns that a CSV file has, rows without vessel, time or place left out; no other column is parsed."""
    raw = spark.read.option("header", True).csv(path)
    d = raw.select(*[c for c in POSITION_COLUMNS if c in raw.columns])
    d = d.withColumn("mmsi", F.col("mmsi").try_cast("double").cast("long")).withColumn("timestamp", F.try_to_timestamp("timestamp"))
    return d.withColumn("lat", F.col("lat").try_cast("double")).withColumn("lon", F.col("lon").try_cast("double")).na.drop(subset=["mmsi", "timestamp", "lat", "lon"])


def keep_histories(events: DataFrame, path: str) -> None:
    """Stores the events of each vessel ``mmsi`` as one CSV file in a folder of its name; a file for each task and vessel would list many times as many."""
    named = events.withColumn("file", F.concat(F.lit("history_"), "mmsi")).drop("mmsi")
    named.repartition("file").write.option("header", True).partitionBy("file").csv(path)


def deep_history(spark: SparkSession, path: str, pattern: str = r"history_(\d+)") -> DataFrame:
    """Kept event histories, a CSV file or folder for each vessel, the vessel by name of its file; unreadable times are null."""
    d = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    d = d.withColumn("mmsi", F.regexp_extract(F.input_file_name(), pattern, 1).try_cast("long"))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return d.select("mmsi", "event_type", F.try_to_timestamp("start").alias("start"), F.try_to_timestamp("end").alias("end"), number("lat"), number("lon"), number("duration_hrs"))


def escalating_dwell(spark: SparkSession, path: str) -> DataFrame:
    """Dwell episodes of a flags file that escalate and have a place."""
    d = spark.read.option("header", True).csv(path).where(F.col("escalate").try_cast("boolean"))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return d.select(F.col("mmsi").try_cast("long").alias("mmsi"), "ship_name", number("lat"), number("lon"), number("duration_h")).na.drop(subset=["lat", "lon"])


def dwell_flag_events(episodes: DataFrame, window: str) -> DataFrame:
    """Escalating episodes as flag events, one count for each vessel, with a name that it was seen under."""
    return episodes.where("mmsi is not null").groupBy("mmsi").agg(F.count("*").alias("flagged_events"), F.max("ship_name").alias("ship_name")).select(
        "mmsi", F.lit(window).alias("window"), F.lit(True).alias("observed"), "flagged_events", F.lit("prolonged_dwell_at_flagged_facility").alias("event_type"), "ship_name")


CALIBRATION = "region string, derived_thresholds struct<matched_km:double, likely_spoofed_km:double>, sar_ais_distance_calibration struct<confirmed_pair_percentiles_km:map<string,double>, likely_spoofed_tail_check:struct<p95_km:double>, n_confirmed_identity_pairs:long, n_confirmed_identity_pairs_pre_screen:long, confidence:string>"


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """The fields of stored calibration reports, a document a file, that views need."""
    return calibration_fields(spark.read.schema(CALIBRATION).option("multiLine", True).json(path))


def calibration_fields(d: DataFrame) -> DataFrame:
    """The fields of calibration reports that views need; a field that a report lacks is null."""
    c, t = "sar_ais_distance_calibration", "derived_thresholds"
    return d.select("region", f"{t}.matched_km", f"{t}.likely_spoofed_km", f"{c}.likely_spoofed_tail_check.p95_km", F.col(f"{c}.n_confirmed_identity_pairs").alias("n_confirmed"), F.col(f"{c}.n_confirmed_identity_pairs_pre_screen").alias("n_pre_screen"), F.col(f"{c}.confidence").alias("confidence"), F.col(f"{c}.confirmed_pair_percentiles_km").alias("percentiles"))


def cache_or_fetch(spark: SparkSession, path: str, fetch=None) -> DataFrame:
    """What is kept at ``path``; without it what ``fetch`` brings, kept from now on. Without either an error: nothing is fetched unasked."""
    if not exists(spark, f"{path}/_SUCCESS"):
        if fetch is None:
            raise FileNotFoundError(f"nothing is kept at {path} and fetching is not allowed")
        fetch().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def file_audit(spark: SparkSession, expected: list[tuple[str, str]]) -> DataFrame:
    """``label, path, present`` of a list of expected files."""
    return spark.createDataFrame([(label, path, exists(spark, path)) for label, path in expected], "label string, path string, present boolean")
