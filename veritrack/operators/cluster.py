"""Anomaly episodes and their clusters in space and time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrack.functions.geo import RADIUS_KM, haversine
from veritrack.functions.timeutil import HOUR_US, with_runs
from veritrack.operators.intervals import stab
from veritrack.operators.nearest import box_distances, rows_within
from veritrack.plans.components import connected_components
from veritrack.plans.lineage import cut
from veritrack.plans.stages import once

#: Vessels whose tracks are known artifacts.
KNOWN_ARTIFACTS: tuple[int, ...] = (257933000, 636015780)


def anomalies(classified: DataFrame, triples: DataFrame, artifacts: tuple[int, ...] = KNOWN_ARTIFACTS) -> DataFrame:
    """Spoofed detections at the radar point and deviating track rows at the actual one: ``vessel, t, lat, lon, source``."""
    a = classified.where("classification = 'likely_spoofed'").select(F.coalesce("matched_mmsi", "mmsi").alias("vessel"), "t", "lat", "lon", F.lit("likely_spoofed").alias("source"))
    b = triples.where("tier <> 'normal'").select(F.col("mmsi").alias("vessel"), "t", "lat", "lon", F.concat(F.lit("traj_deviation_"), "tier").alias("source"))
    return a.unionByName(b).where("vessel is not null").where(~F.col("vessel").isin(*artifacts) if artifacts else F.lit(True))


def episodes(pings: DataFrame, gap_us: int = 3 * HOUR_US) -> DataFrame:
    """One row for each vessel's run of anomalies: centroid, midpoint, span, pings and sources."""
    runs = with_runs(pings, "vessel", gap_us=gap_us, order=("lat", "lon", "source"))
    e = runs.groupBy("vessel", "run").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n_pings"), F.array_join(F.sort_array(F.collect_set("source")), ";").alias("sources"))
    return e.withColumn("t", F.expr("t_start + (t_end - t_start) div 2")).withColumn("episode_id", F.concat_ws("-", "vessel", "run"))


def neighbours(e: DataFrame, eps_km: float = 8.0, eps_h: float = 2.0) -> DataFrame:
    """Pairs ``(a, b)`` of episodes within both radii, inclusive, each with itself.

    Buckets of time and cells of latitude and longitude are the equi keys, so
    work follows local density and no nested loop is planned.
    """
    near = rows_within(e, e.withColumn("mmsi", F.col("episode_id")), eps_km, int(eps_h * HOUR_US), ("episode_id",))
    return near.select(F.col("episode_id").alias("a"), F.col("other").alias("b"))


def _lon_side(row: Column, side: float) -> Column:
    """Degrees of longitude of the cells in a row of latitudes: at most as wide in km as they are high."""
    least = F.when(row >= 0, row * side).otherwise(F.greatest(-(row + 1) * side, F.lit(0.0)))
    return side / F.greatest(F.cos(F.radians(least)), F.lit(1e-3))


_BOX = {"y0": "lat", "y1": "lat", "x0": "lon", "x1": "lon", "t0": "t", "t1": "t"}


def _box() -> list[Column]:
    return [(F.min if k[1] == "0" else F.max)(c).alias(k) for k, c in _BOX.items()]


def _reach(cells: DataFrame, others: DataFrame, eps_km: float, eps_us: int, side: float) -> DataFrame:
    """Pairs of cells ``c, d`` with their boxes ``o`` and ``p`` that may hold a pair within both radii; a pair may come twice across the date line."""
    pad = math.degrees(eps_km / RADIUS_KM) * (1 + 1e-9) + 1e-9
    wide = F.lit(pad) / F.greatest(F.cos(F.radians(F.greatest(F.abs("o.y0"), F.abs("o.y1")) + pad)), F.lit(1e-3))
    turns = F.filter(F.array(*map(F.lit, (-360.0, 0.0, 360.0))), lambda s: (F.col("o.x0") + s - F.col("wide") <= 180) & (F.col("o.x1") + s + F.col("wide") >= -180))
    spots = cells.select("c", F.struct(*_BOX, *[f for f in ("early", "late") if f in cells.columns]).alias("o"), F.explode(F.sequence(F.col("_b") - 1, F.col("_b") + 1)).alias("_b")).withColumn("wide", wide).withColumn("s", F.explode(turns))
    spots = spots.withColumn("_y", F.explode(F.sequence(F.floor((F.col("o.y0") - pad) / side), F.floor((F.col("o.y1") + pad) / side))))
    at = lambda x: F.floor(x / _lon_side(F.col("_y"), side))
    spots = spots.withColumn("_x", F.explode(F.sequence(at(F.greatest(F.col("o.x0") + F.col("s") - F.col("wide"), F.lit(-180.0))), at(F.least(F.col("o.x1") + F.col("s") + F.col("wide"), F.lit(180.0)))))).select("c", "o", "_b", "_y", "_x")
    found = others.select("_b", "_y", "_x", F.col("c").alias("d"), F.struct(*_BOX, *[f for f in ("early", "late") if f in others.columns]).alias("p"))
    met = spots.join(found.hint("merge"), ["_b", "_y", "_x"]).where((F.col("p.t0") - F.col("o.t1") <= eps_us) & (F.col("o.t0") - F.col("p.t1") <= eps_us))
    return met.select("c", "d", "o", "p")


def _within(eps_km: float, eps_us: int, a: str, b: str) -> Column:
    at = lambda s, c: F.col(f"{s}.{c}")
    return (F.abs(at(a, "t") - at(b, "t")) <= eps_us) & (haversine(at(a, "lat"), at(a, "lon"), at(b, "lat"), at(b, "lon")) <= eps_km)


def st_dbscan(e: DataFrame, eps_km: float = 8.0, eps_h: float = 2.0, min_pts: int = 2) -> DataFrame:
    """``e`` with ``cluster``: core episodes have ``min_pts`` neighbours with themselves; border ones take the least cluster; noise is -1.

    Numbers follow the first member in order of time and id. All episodes of a
    cell of time and place are neighbours, so those of a cell with ``min_pts``
    are core without a pair. Cells, not episodes, are linked: first by two
    episodes of each, the first and the last; only cells near each other that
    this leaves in different parts meet with all their core episodes.
    """
    e, eps_us = cut(e), int(eps_h * HOUR_US)
    side = math.degrees(min(eps_km, 1000.0) / RADIUS_KM) / math.sqrt(2) * 0.99
    placed = e.where("lat is not null and lon is not null and t is not null").select("episode_id", "t", "lat", "lon", F.expr(f"(t - pmod(t, {eps_us})) div {eps_us}").alias("_b"), F.floor(F.col("lat") / side).alias("_y"))
    placed = placed.withColumn("_x", F.floor(F.col("lon") / _lon_side(F.col("_y"), side)))
    cells = cut(placed.groupBy("_b", "_y", "_x").agg(F.count("*").alias("n"), *_box()).withColumn("c", F.monotonically_increasing_id()))
    points = cut(placed.join(cells.select("_b", "_y", "_x", "c", "n").hint("merge"), ["_b", "_y", "_x"]))
    point = F.struct("t", "lat", "lon")
    sparse = cells.where(F.col("n") < min_pts)

    def beside(rows: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs of rows of sparse cells with their neighbours, themselves among them."""
        pairs = _reach(sparse, cells, eps_km, eps_us, side).select("c", "d")
        ends = pairs.join(rows.select("c", "episode_id", point.alias("a")).hint("merge"), "c")
        return ends.join(others.withColumnsRenamed({"c": "d", "episode_id": "other"}).hint("merge"), "d").where(_within(eps_km, eps_us, "a", "b")).distinct()

    few = points.where(F.col("n") < min_pts)
    counted = beside(few, points.select("c", "episode_id", point.alias("b"))).groupBy("episode_id").agg(F.count("*").alias("m")).where(F.col("m") >= min_pts).select("episode_id")
    core = cut(points.where(F.col("n") >= min_pts).unionByName(few.join(counted.hint("merge"), "episode_id", "left_semi")))
    held = cut(core.groupBy("_b", "_y", "_x", "c").agg(F.min(point).alias("early"), F.max(point).alias("late"), *_box()))
    linked = F.greatest(*[_within(eps_km, eps_us, f"o.{a}", f"p.{b}") for a in ("early", "late") for b in ("early", "late")])
    pairs = cut(once(_reach(held, held, eps_km, eps_us, side).where("c < d"), linked=linked).select("c", "d", "linked", F.struct(*[f"p.{k}" for k in _BOX]).alias("p")))
    parts = connected_components(pairs.where("linked"), "c", "d", large=True)
    part = held.select("c").join(parts.withColumnRenamed("node", "c").hint("merge"), "c", "left").select("c", F.coalesce("component", "c").alias("part"))
    part = cut(part)
    apart = pairs.where("not linked").join(part.hint("merge"), "c").join(part.select(F.col("c").alias("d"), F.col("part").alias("to")).hint("merge"), "d").where("part <> to").select("c", "d", "part", "to", "p")
    # of the first cell only what is near the other's box
    near = once(apart.join(core.select("c", point.alias("a")).hint("merge"), "c"), low=box_distances(F.col("a.lat"), F.col("a.lon"), *[F.col(f"p.{k}") for k in ("y0", "y1", "x0", "x1")])[0])
    near = near.where((F.col("low") <= math.sin(min(eps_km / RADIUS_KM, math.pi) / 2) ** 2 * (1 + 1e-9) + 1e-18) & (F.col("p.t0") - F.col("a.t") <= eps_us) & (F.col("a.t") - F.col("p.t1") <= eps_us)).select("d", "part", "to", "a")
    joined = near.join(core.select(F.col("c").alias("d"), point.alias("b")).hint("merge"), "d").where(_within(eps_km, eps_us, "a", "b")).select("part", "to").distinct()
    merged = connected_components(joined, "part", "to", large=True)
    part = part.join(merged.select(F.col("node").alias("part"), "component").hint("merge"), "part", "left").select("c", F.coalesce("component", "part").alias("part"))
    named = cut(core.select("episode_id", "t", "c").join(part.hint("merge"), "c").select("episode_id", "t", "part"))
    first = named.groupBy("part").agg(F.min(F.struct("t", "episode_id")).alias("first"))
    # one row for each cluster: the global order is over clusters, not episodes
    numbers = first.select("part", (F.row_number().over(Window.orderBy("first")) - 1).alias("cluster"))
    named = cut(named.join(numbers, "part").select("episode_id", "cluster"))
    rows = e.join(named.hint("merge"), "episode_id", "left")
    if min_pts > 2:  # an episode that is no core has fewer neighbours than that; with two it has none
        lone = few.join(named.hint("merge"), "episode_id", "left_anti")
        met = beside(lone, points.select("c", "episode_id", point.alias("b"))).join(named.withColumnRenamed("episode_id", "other").hint("merge"), "other")
        rows = rows.join(met.groupBy("episode_id").agg(F.min("cluster").alias("near")).hint("merge"), "episode_id", "left")
        return rows.withColumn("cluster", F.coalesce("cluster", "near", F.lit(-1))).drop("near")
    return rows.withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def cluster_summary(labelled: DataFrame, hours: float = 6.0, km: float = 10.0, strong: int = 4) -> DataFrame:
    """Size, span, radius about the mean centroid and coherence of each cluster."""
    rows = labelled.where("cluster >= 0")
    # a cluster may hold most episodes: its centre is joined, its rows are not brought together
    rows = rows.join(rows.groupBy("cluster").agg(F.avg("lat").alias("cy"), F.avg("lon").alias("cx")), "cluster")
    out = rows.groupBy("cluster").agg(F.count("*").alias("n_episodes"), F.sum("n_pings").alias("n_pings"), F.countDistinct("vessel").alias("n_vessels"), ((F.max("t_end") - F.min("t_start")) / HOUR_US).alias("span_h"),
                                      F.max(haversine(F.col("cy"), F.col("cx"), F.col("lat"), F.col("lon"))).alias("radius_km"), F.array_join(F.sort_array(F.collect_set("vessel")), ",").alias("vessels"))
    genuine = (F.col("n_vessels") >= 2) & (F.col("span_h") <= hours) & (F.col("radius_km") <= km)
    return out.withColumn("coherence", F.when(genuine, "genuine").when(F.col("n_vessels") >= 2, "loose").otherwise("single_vessel_artifact")).withColumn("strong", genuine & (F.col("n_vessels") >= strong))


def propagate(pings: DataFrame, labelled: DataFrame, summary: DataFrame) -> DataFrame:
    """Each ping ``(vessel, t, ...)`` with the episode that holds it, that episode's cluster and the cluster's coherence.

    Episodes of a vessel don't overlap, so a ping has one; a ping outside all
    episodes has cluster -1, as has one in an episode that is noise.
    """
    spans = labelled.select("vessel", "t_start", "t_end", "episode_id", "cluster")
    rows = stab(pings, spans, ("vessel",)).drop("t_start", "t_end").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    return rows.join(summary.select("cluster", "coherence"), "cluster", "left").withColumn("coherence", F.coalesce("coherence", F.lit("noise")))


def isolation(labelled: DataFrame, summary: DataFrame) -> DataFrame:
    """``vessel, cluster, n_own, n_other_vessels, nearest_gap_h, status`` for each vessel in each cluster.

    The gap is from the span of all the vessel's episodes to the nearest episode
    of another vessel in the cluster, 0 if one overlaps. Own episodes lie inside
    the own span, so episodes that end before it or begin after it are others':
    one ordered pass over each cluster counts them and keeps the nearest.
    Episodes that are noise stand under cluster -1 as ``isolated``.
    """
    spans = labelled.groupBy("vessel").agg(F.min("t_start").alias("a"), F.max("t_end").alias("b"))
    members = labelled.groupBy("vessel", "cluster").agg(F.count("*").alias("n_own")).join(spans, "vessel")
    inside = members.where("cluster >= 0")
    none = F.lit(None).cast("long")

    def beside(edge: str, mine: str, sign: int) -> DataFrame:
        """How many episodes of the cluster lie wholly on one side of a vessel's span, and the nearest of them."""
        rows = labelled.where("cluster >= 0").select("cluster", F.lit(None).cast(labelled.schema["vessel"].dataType).alias("vessel"), (sign * F.col(edge)).alias("x"), F.col(edge).alias("e"))
        asked = inside.select("cluster", "vessel", (sign * F.col(mine)).alias("x"), none.alias("e"))
        w = Window.partitionBy("cluster").orderBy("x").rangeBetween(Window.unboundedPreceding, -1)
        seen = rows.union(asked).withColumn("n", F.count("e").over(w)).withColumn("near", F.max(sign * F.col("e")).over(w))
        return seen.where("vessel is not null").select("cluster", "vessel", F.col("n").alias(f"n_{edge}"), (F.col("x") - F.col("near")).alias(f"gap_{edge}"))

    sizes = summary.select("cluster", "n_episodes", "n_vessels", "coherence")
    rows = inside.join(beside("t_end", "a", 1), ["cluster", "vessel"]).join(beside("t_start", "b", -1), ["cluster", "vessel"]).join(sizes, "cluster")
    overlaps = F.col("n_episodes") - F.col("n_own") > F.col("n_t_end") + F.col("n_t_start")
    gap = F.when(F.col("n_vessels") > 1, F.when(overlaps, 0).otherwise(F.least("gap_t_end", "gap_t_start"))) / HOUR_US
    status = F.when(F.col("n_vessels") == 1, "alone").when(F.col("coherence") == "genuine", "contemporaneous").otherwise("not_contemporaneous")
    found = rows.select("vessel", "cluster", "n_own", (F.col("n_vessels") - 1).alias("n_other_vessels"), gap.alias("nearest_gap_h"), status.alias("status"))
    noise = members.where("cluster < 0").select("vessel", "cluster", "n_own", F.lit(0).cast("long").alias("n_other_vessels"), F.lit(None).cast("double").alias("nearest_gap_h"), F.lit("isolated").alias("status"))
    return found.unionByName(noise)
