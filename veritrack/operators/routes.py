"""Whether the way between two places was possible: chains of events, pairs and steps, and how often methods disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrack.functions.geo import haversine
from veritrack.functions.timeutil import HOUR_US
from veritrack.operators.trajectory import route_verdict, type_class

#: Hours of silence that explain a bad step, and those that make one worth a second look.
GAP_H, RETRO_H = 6.0, 10.0
VERDICTS = ("PHYSICALLY_IMPOSSIBLE", "IMPLAUSIBLE_BUT_POSSIBLE", "PLAUSIBLE", "UNDETERMINED")


def event_chain(events: DataFrame) -> DataFrame:
    """From the end of each event of a vessel to the start of its next one: ``event_id, mmsi, km, hours, prior_tier``.

    Events come by start and id; those without start or place are left out. An
    event without an end ends where it starts. ``hours`` is negative where
    events overlap.
    """
    w = Window.partitionBy("mmsi").orderBy("t_start", "event_id")
    last = F.lag(F.struct(F.coalesce("t_end", "t_start").alias("t"), "lat", "lon", "event_type")).over(w)
    rows = events.where("t_start is not null and lat is not null and lon is not null").withColumn("a", last).where("a is not null")
    return rows.select("event_id", "mmsi", haversine(F.col("a.lat"), F.col("a.lon"), F.col("lat"), F.col("lon")).alias("km"), ((F.col("t_start") - F.col("a.t")) / HOUR_US).alias("hours"), F.concat_ws("->", "a.event_type", "event_type").alias("prior_tier"))


def judged(transitions: DataFrame, kinds: DataFrame) -> DataFrame:
    """``transitions(mmsi, km, hours, ...)`` with type class, knots needed on a straight line and verdict; ``kinds`` has ``mmsi, vessel_type``."""
    rows = transitions.join(kinds.groupBy("mmsi").agg(F.min("vessel_type").alias("vessel_type")), "mmsi", "left").withColumn("kind", type_class(F.col("vessel_type")))
    knots, _, verdict = route_verdict(F.col("km"), F.col("hours"), F.lit(None).cast("double"), F.col("kind"))
    return rows.drop("vessel_type").withColumn("required_knots", knots).withColumn("classification", verdict)


def all_transitions(triples: DataFrame, classified: DataFrame, events: DataFrame) -> DataFrame:
    """Steps of tracks, radar pairs and event chains as one table: ``source, mmsi, km, hours, prior_tier, gap_h``."""
    steps = triples.select(F.lit("trajectory").alias("source"), "mmsi", F.col("step_km").alias("km"), F.col("gap12").alias("hours"), F.col("tier").alias("prior_tier"), F.col("gap12").alias("gap_h"))
    apart = F.col("time_gap_seconds") / 3600
    pairs = classified.where("distance_km is not null").select(F.lit("sar_vs_ais").alias("source"), F.coalesce("mmsi", "matched_mmsi").alias("mmsi"), F.col("distance_km").alias("km"), apart.alias("hours"), F.col("classification").alias("prior_tier"), apart.alias("gap_h"))
    chain = event_chain(events).select(F.lit("event_chain").alias("source"), "mmsi", "km", "hours", "prior_tier", F.lit(None).cast("double").alias("gap_h"))
    return steps.unionByName(pairs).unionByName(chain)


def route_summaries(rows: DataFrame, watched: DataFrame) -> DataFrame:
    """``part, item, classification, n`` from judged transitions.

    ``by_source`` counts verdicts of each source and of all; ``discriminator``
    the bad steps of tracks that a silence explains or doesn't; ``retro`` the
    steps of ``watched(vessel)`` that were rated high over a long silence;
    ``disagreement`` what becomes of transitions that the other method rated
    high or likely spoofed. One pass counts them all.
    """
    bad = (F.col("source") == "trajectory") & F.col("classification").isin(*VERDICTS[:2])
    seen = rows.join(watched.select(F.col("vessel").alias("mmsi"), F.lit(True).alias("watched")).distinct(), "mmsi", "left")
    entry = lambda part, item: F.struct(F.lit(part).alias("part"), item.alias("item"))
    long_gap = F.coalesce(F.col("gap_h"), F.lit(0.0)) > GAP_H
    parts = F.array(
        entry("by_source", F.col("source")), entry("by_source", F.lit("TOTAL")),
        F.when(bad, entry("discriminator", F.when(long_gap, "explained").otherwise("unexplained"))),
        F.when(F.col("watched") & (F.col("source") == "trajectory") & (F.col("prior_tier") == "high") & (F.col("gap_h") > RETRO_H), entry("retro", F.lit("high"))),
        F.when(F.col("prior_tier").isin("high", "likely_spoofed"), entry("disagreement", F.col("prior_tier"))))
    return seen.select(F.explode(F.array_compact(parts)).alias("p"), "classification").groupBy("p.part", "p.item", "classification").agg(F.count("*").alias("n"))
