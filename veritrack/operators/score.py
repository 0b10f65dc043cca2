"""Flag events, their consolidation by vessel, and explainable scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrack.functions.timeutil import HOUR_US, with_runs
from veritrack.operators.trajectory import norm_type

#: Flags of convenience by two lists.
ITF_FLAGS = (
    "ATG", "BHS", "BRB", "BLZ", "BMU", "KHM", "CYM", "COM", "CYP", "GNQ", "FRA", "DEU", "GEO", "GIB", "HND", "JAM",
    "LBN", "LBR", "MLT", "MHL", "MUS", "MDA", "MNG", "MMR", "ANT", "PAN", "PRK", "STP", "VCT", "KNA", "LCA", "LKA",
    "TON", "VUT",
)
SHADOW_FLAGS = (
    "COK", "GAB", "PLW", "CMR", "DJI", "GUY", "SLE", "TZA", "TGO", "BES", "SWZ",
)
#: Small utility craft by type or by keyword.
UTILITY_TYPES = (
    "pilot_vessel", "pilot", "pilot_boat", "tug", "tugboat", "towing_vessel", "pusher_tug", "landing_craft",
    "service_vessel", "service_craft", "utility_vessel", "utility_craft", "patrol_vessel", "patrol_boat", "patrol", "law_enforcement",
    "coast_guard", "port_tender", "tender", "crew_boat", "crew_tender", "workboat", "work_boat", "line_handling_boat",
    "mooring_vessel", "supply_vessel", "offshore_supply_vessel", "platform_supply_vessel", "osv", "dredger", "hopper_dredger", "pilot_patrol",
)
UTILITY_KEYWORDS = "pilot|tug|landing_craft|patrol|tender|workboat|work_boat|supply_vessel|line_handling|mooring|dredg|crew_boat|coast_guard"


def discrete_events(pings: DataFrame, gap_us: int = 3 * HOUR_US) -> DataFrame:
    """Anomalies more than the gap apart count as separate events: ``vessel, flagged_events``."""
    return with_runs(pings, "vessel", gap_us=gap_us, order=("lat", "lon", "source")).groupBy("vessel").agg(F.max("run").alias("flagged_events"))


def consolidate(flags: DataFrame, artifacts: tuple[int, ...] = (), windows: tuple[str, ...] = ()) -> DataFrame:
    """By vessel from ``(vessel, window, ord, event_type, flagged_events, observed)``: windows seen, totals, rate, types, last flagged window.

    A window counts as seen if a row observed the vessel in it. Known artifacts
    stay with their windows, but none of their flags counts. ``windows`` asks
    for a column of flags for each of the named ones.
    """
    per = flags.groupBy("vessel", "window", "ord").agg(F.bool_or("observed").alias("seen"), F.sum("flagged_events").alias("n"), F.collect_set(F.when(F.col("flagged_events") > 0, F.col("event_type"))).alias("types"))
    artifact = F.col("vessel").isin(*artifacts) if artifacts else F.lit(False)
    per = per.withColumn("is_known_artifact", artifact).withColumn("n", F.when(F.col("is_known_artifact"), 0).otherwise(F.col("n"))).withColumn("types", F.when(F.col("is_known_artifact"), F.array().cast("array<string>")).otherwise(F.col("types")))
    out = per.groupBy("vessel", "is_known_artifact").agg(
        F.count_if("seen").alias("n_windows"), F.sum("n").alias("total_flags"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("types")))), ";").alias("event_types"),
        F.max_by("window", F.when(F.col("seen") & (F.col("n") > 0), F.col("ord"))).alias("last_window"), *[F.coalesce(F.sum(F.when(F.col("window") == w, F.col("n"))), F.lit(0)).alias(f"flags_{w}") for w in windows])
    return out.withColumn("flag_rate", F.round(F.coalesce(F.try_divide(F.col("total_flags"), F.col("n_windows")), F.lit(0.0)), 3))


def is_utility(vessel_type: Column) -> Column:
    n = norm_type(vessel_type)
    return F.coalesce(n.isin(*UTILITY_TYPES) | n.rlike(UTILITY_KEYWORDS), F.lit(False))


def foc_tier(flag: Column) -> Column:
    return F.when(flag.isin(*SHADOW_FLAGS), "shadow_fleet").when(flag.isin(*ITF_FLAGS), "itf_foc_only").otherwise("none")


def scores(rows: DataFrame, year: int = 2026, cap: float = 4.0) -> DataFrame:
    """Scores from ``flag_rate, flag, vessel_type, built_year``: behaviour up to 60, flag up to 20, age 20.

    ``cached_built_year``, where it is a column, stands in for an unknown year;
    ``age_source`` says which of the two was known. Rows with a true
    ``is_known_artifact`` score nothing in all.
    """
    known = [F.col(c) for c in ("built_year", "cached_built_year") if c in rows.columns]
    rows = rows.withColumn("age_source", F.when(known[0].isNotNull(), "registry").when(known[-1].isNotNull(), "age_cache").otherwise("unknown")).withColumn("built_year", F.coalesce(*known))
    rows = rows.withColumn("behavioral_score", F.round(60 * F.least(F.lit(1.0), F.col("flag_rate") / cap), 1)).withColumn("foc_tier", foc_tier(F.col("flag")))
    rows = rows.withColumn("foc_score", F.when(F.col("foc_tier") == "shadow_fleet", 20.0).when(F.col("foc_tier") == "itf_foc_only", 5.0).otherwise(0.0))
    rows = rows.withColumn("age_score", F.when(year - F.col("built_year") > 15, 20.0).otherwise(0.0)).withColumn("utility", is_utility(F.col("vessel_type")))
    rows = rows.withColumn("behavioral_adjusted", F.round(F.col("behavioral_score") * F.when(F.col("utility"), 0.25).otherwise(1.0), 1))
    total = F.round(F.col("behavioral_adjusted") + F.col("foc_score") + F.col("age_score"), 1)
    return rows.withColumn("reliability_score", F.when(F.col("is_known_artifact"), 0.0).otherwise(total) if "is_known_artifact" in rows.columns else total)


def first_source(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """For each key the value of the first source that has the key, null values included; within a source the least value."""
    tagged = [s.groupBy(key).agg(F.min(value).alias(value)).withColumn("_p", F.lit(i)) for i, s in enumerate(sources)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy(key).agg(F.min(F.struct("_p", value)).alias("s")).select(key, F.col(f"s.{value}").alias(value))


def pull_decision(last_pull_days: Column, ttl_days: float = 30.0) -> Column:
    """A never pulled or stale vessel is pulled anew."""
    return F.when(last_pull_days.isNull() | (last_pull_days > ttl_days), "FRESH_PULL").otherwise("CACHE_SKIP")
