"""The watch-list run: flagged vessels, a budget of pulls, the cache log as state and an audit trail.

A run is a function of the flags, the log before it and what the pulls brought;
it gives decisions, the log after it and audit rows. ``keep_run`` stores log and
audit of a run under its id and stores a run that is already there no second
time, so a repeated run changes nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrack.plans.lineage import exists

DAY_US = 86_400_000_000
LOG = "mmsi long, first_pulled long, last_pulled long, pull_count long, reflag_count long, last_reflag long, flagged_windows array<string>, last_decision string, last_n_events long"


class WatchRun(NamedTuple):
    decisions: DataFrame
    log: DataFrame
    audit: DataFrame


def run_watchlist(flags: DataFrame, log: DataFrame, pulls: DataFrame, window: str, now_us: int, run_id: str, max_pulls: int = 8, ttl_days: float = 30.0, artifacts: tuple[int, ...] = ()) -> WatchRun:
    """One run over ``flags(mmsi, thresholds)`` of a window.

    A vessel in the log whose last pull is at most ``ttl_days`` old is skipped
    and its counter of repeated flags rises. The others need a pull; the first
    ``max_pulls`` by number get one, the rest are deferred. ``pulls(mmsi, ok,
    n_events)`` says how they went; a pull without a row failed and leaves the
    log as it was. Known artifacts are suppressed. Repeated flags of a vessel
    count once, a null vessel never.
    """
    once = flags.where("mmsi is not null").groupBy("mmsi").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("thresholds", ";"))))).alias("thresholds"))
    artifact = F.col("mmsi").isin(*artifacts) if artifacts else F.lit(False)
    asked = once.join(log, "mmsi", "left").withColumn("age_days", (now_us - F.col("last_pulled")) / DAY_US)
    reason = (F.when(F.col("pull_count").isNull(), "never pulled").when(F.col("last_pulled").isNull(), "no timestamp").when(F.col("age_days") > ttl_days, "stale").otherwise("current"))
    asked = asked.withColumn("reason", reason).withColumn("artifact", artifact)
    # at most max_pulls rows
    granted = asked.where("not artifact and reason <> 'current'").orderBy("mmsi").limit(max_pulls).select("mmsi", F.lit(True).alias("granted"))
    went = F.broadcast(granted).join(pulls.select("mmsi", "ok", "n_events"), "mmsi", "left")
    rows = asked.join(F.broadcast(went), "mmsi", "left")
    action = (F.when(F.col("artifact"), "SUPPRESSED").when(F.col("reason") == "current", "CACHE_SKIP").when(F.col("granted").isNull(), "DEFERRED").when(F.coalesce("ok", F.lit(False)), "FRESH_PULL").otherwise("FAILED"))
    decisions = rows.select(F.lit(run_id).alias("run_id"), F.lit(window).alias("window"), "mmsi", action.alias("action"), "reason", "age_days", F.array_join("thresholds", ";").alias("thresholds"), "n_events")
    changed = decisions.where(F.col("action").isin("FRESH_PULL", "CACHE_SKIP")).select("mmsi", "action", F.col("n_events").alias("_n"))
    fresh, skip = F.col("action") == "FRESH_PULL", F.col("action") == "CACHE_SKIP"
    after = log.join(changed, "mmsi", "full").select(
        "mmsi", F.when(fresh, F.coalesce("first_pulled", F.lit(now_us))).otherwise(F.col("first_pulled")).alias("first_pulled"), F.when(fresh, now_us).otherwise(F.col("last_pulled")).alias("last_pulled"),
        (F.coalesce("pull_count", F.lit(0)) + F.coalesce(fresh, F.lit(False)).cast("int")).cast("long").alias("pull_count"), (F.coalesce("reflag_count", F.lit(0)) + F.coalesce(skip, F.lit(False)).cast("int")).cast("long").alias("reflag_count"),
        F.when(skip, now_us).otherwise(F.col("last_reflag")).alias("last_reflag"), F.when(F.col("action").isNotNull(), F.array_union(F.coalesce("flagged_windows", F.array().cast("array<string>")), F.array(F.lit(window)))).otherwise(F.col("flagged_windows")).alias("flagged_windows"),
        F.when(fresh, "fresh_pull").when(skip, "cache_skip").otherwise(F.col("last_decision")).alias("last_decision"), F.when(fresh, F.col("_n")).otherwise(F.col("last_n_events")).alias("last_n_events"))
    entry = decisions.select("run_id", "window", F.lower("action").alias("event"), "mmsi", F.to_json(F.struct("reason", "thresholds", "n_events")).alias("detail"))
    totals = decisions.groupBy("run_id", "window").agg(F.to_json(F.struct(*[F.count_if(F.col("action") == a).alias(f"n_{a.lower()}") for a in ("FRESH_PULL", "CACHE_SKIP", "DEFERRED", "FAILED", "SUPPRESSED")])).alias("detail"))
    audit = entry.unionByName(totals.select("run_id", "window", F.lit("run_end").alias("event"), F.lit(None).cast("long").alias("mmsi"), "detail"))
    return WatchRun(decisions, after, audit)


def keep_run(run: WatchRun, spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """The log after the run, stored as a version of its own; audit rows go to a part of their own and nothing older is touched.

    The log is written last and whole: a run that broke off is written again, one
    whose log is there is only read.
    """
    version = f"{folder}/log/run_id={run_id}"
    if not exists(spark, f"{version}/_SUCCESS"):
        run.audit.drop("run_id").write.mode("overwrite").json(f"{folder}/audit/run_id={run_id}")
        run.log.write.mode("overwrite").parquet(version)
    return spark.read.schema(LOG).parquet(version)
