"""Summaries and verdicts for reports: coverage, history, clusters, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrack.functions.geo import haversine
from veritrack.functions.timeutil import HOUR_US
from veritrack.operators.match import nearest_in_time
from veritrack.operators.screen import alternatives, own_window
from veritrack.operators.trajectory import KNOT_KMH, norm_type
from veritrack.sources.files import VAGUE_TYPES

#: Fixed values of the structural verdict: knots a vessel can hold, how many
#: times its reach and how many kilometres at least a wrong link is away.
REACH_KN, REACH_FACTOR, WRONG_KM = 30.0, 3.0, 15.0
#: Fixed value: the far-out fence of distances, in kilometres.
TAIL_FENCE_KM = 27.48


def near_port_crosstab(rows: DataFrame, by: str, near: Column) -> DataFrame:
    """Counts of ``by`` near a port and not, in all and the share near in percent; a null ``near`` counts as not near."""
    near = F.coalesce(near, F.lit(False))
    out = rows.groupBy(by).agg(F.count_if(near).alias("near"), F.count_if(~near).alias("far"), F.count("*").alias("total"))
    return out.withColumn("pct", 100.0 * F.col("near") / F.col("total"))


def sampled_near_share(rows: DataFrame, by: tuple[str, ...], key: str, near: str, size: int, seed: int = 42) -> DataFrame:
    """Of each group the pool, a seeded sample of at most ``size`` rows, and how many of the sample are near; the sample is the feature."""
    w = Window.partitionBy(*by)
    order = w.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), key)
    pool = rows.groupBy(*by).agg(F.count("*").alias("pool"))
    some = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size)
    out = some.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(near).alias("n_near"))
    return pool.join(out, list(by)).withColumn("pct", 100.0 * F.col("n_near") / F.col("n"))


def window_stats(summary: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row on the clusters of a window: counts by coherence, rates for 100 episodes, medians and maxima of the genuine ones.

    Without episodes the rates are 0; without genuine clusters their medians
    of span and radius are null and those of vessels 0.
    """
    genuine = F.col("coherence") == "genuine"
    of = lambda c: F.when(genuine, F.col(c))
    share = lambda c: F.coalesce(F.try_divide(100.0 * F.col(c), F.col("n_episodes")), F.lit(0.0))
    row = summary.agg(
        F.count("*").alias("clusters"), F.count_if(genuine).alias("genuine"), F.count_if(F.col("strong")).alias("strong"),
        F.count_if(F.col("coherence") == "loose").alias("loose"), F.count_if(F.col("coherence") == "single_vessel_artifact").alias("single"),
        F.coalesce(F.sum(of("n_episodes")), F.lit(0)).alias("ep_in_genuine"),
        F.coalesce(F.floor(F.percentile(of("n_vessels"), F.lit(0.5))), F.lit(0)).cast("long").alias("median_genuine_vessels"),
        F.coalesce(F.max(of("n_vessels")), F.lit(0)).alias("max_genuine_vessels"), F.percentile(of("span_h"), F.lit(0.5)).alias("median_genuine_span"),
        F.percentile(of("radius_km"), F.lit(0.5)).alias("median_genuine_radius"), F.coalesce(F.max("n_vessels"), F.lit(0)).alias("max_vessels"))
    both = row.crossJoin(F.broadcast(episodes.agg(F.count("*").alias("n_episodes"))))  # one row each
    return (both.withColumn("genuine_per_100ep", share("genuine")).withColumn("strong_per_100ep", share("strong"))
            .withColumn("pct_ep_in_genuine", share("ep_in_genuine")))


def history_summary(events: DataFrame, key: str = "mmsi") -> DataFrame:
    """Per vessel the events by kind, places, span, longest loitering and that of over a day.

    ``events`` has ``event_type`` (port_visit, loitering, ais_gap), ``place``,
    ``t`` and ``duration_hrs``. A vessel that never loiters has a longest of 0.
    """
    kind = lambda k: F.col("event_type") == k
    return events.groupBy(key).agg(
        F.count_if(kind("port_visit")).alias("port_calls"), F.count_if(kind("loitering")).alias("loitering"), F.count_if(kind("ais_gap")).alias("gaps"),
        F.array_join(F.sort_array(F.collect_set("place")), ",").alias("places"), F.min("t").alias("t_first"), F.max("t").alias("t_last"),
        F.coalesce(F.max(F.when(kind("loitering"), F.col("duration_hrs"))), F.lit(0.0)).alias("longest_loiter"),
        F.count_if(kind("loitering") & (F.col("duration_hrs") > 24)).alias("long_loiters"))


def first_file_maximum(rows: DataFrame, key: str, file: str, value: str) -> DataFrame:
    """The largest ``value`` of each key in the first file, in the order of ``file``, that has the key."""
    best = rows.groupBy(key, file).agg(F.max(value).alias(value))
    return best.groupBy(key).agg(F.min(file).alias(file), F.min_by(value, file).alias(value))


def overpass_aggregates(detections: DataFrame, positions: DataFrame, key: str = "hour") -> DataFrame:
    """One row: overpasses, the largest, and the median and most vessels in sight; both tables are counted before they meet."""
    size = detections.groupBy(key).agg(F.count("*").alias("n"))
    seen = positions.groupBy(key).agg(F.countDistinct("mmsi").alias("vessels"))
    both = size.join(seen, key, "left").withColumn("vessels", F.coalesce("vessels", F.lit(0)))
    return both.agg(F.count("*").alias("overpasses"), F.max("n").alias("largest"), F.percentile("vessels", F.lit(0.5)).alias("median_vessels"), F.max("vessels").alias("max_vessels"))


def coverage(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: how many rows there are and how many have a value, not null and not blank, in each column."""
    known = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return rows.agg(F.count("*").alias("n"), *[F.count_if(known(c)).alias(f"with_{c}") for c in columns])


def archive_coverage(items: DataFrame, collections: DataFrame) -> DataFrame:
    """Items of each collection, those online and those offline; a collection that the archive does not know has none."""
    online = F.coalesce(F.col("online"), F.lit(False))
    found = items.groupBy("collection").agg(F.count("*").alias("items"), F.count_if(online).alias("online"))
    out = collections.select("collection").distinct().join(found, "collection", "left").na.fill(0, ["items", "online"])
    return out.withColumn("offline", F.col("items") - F.col("online"))


def _told(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) != "", F.lit(False))


def _vague(c: str) -> Column:
    return norm_type(F.col(c)).isin(*VAGUE_TYPES)


def resolve_type(rows: DataFrame, confirmed: str, ship: str, gear: str, listed: str) -> DataFrame:
    """``rows`` with ``resolved_type`` and ``type_source``.

    A confirmed type comes first, then the first of the identity's ship and
    gear type and the listed type that is not vague, then a vague one in the
    same order; blank counts as missing, and without any the source is unknown.
    """
    order = ((ship, "identity"), (gear, "identity"), (listed, "listed"))
    resolved, source = F.when(_told(confirmed), F.col(confirmed)), F.when(_told(confirmed), "confirmed")
    for sure in (True, False):
        for c, name in order:
            test = _told(c) & ~_vague(c) if sure else _told(c)
            resolved, source = resolved.when(test, F.col(c)), source.when(test, name)
    return rows.withColumn("resolved_type", resolved).withColumn("type_source", source.otherwise("unknown"))


def structural_verdict(vertex_km: Column, dt_h: Column, gap_h: Column, brackets: Column, better: Column) -> tuple[Column, Column, Column]:
    """``(reach in km, structurally wrong, verdict)`` of a link of a detection with a vessel.

    ``vertex_km`` and ``dt_h`` tell how far and how long the nearest of the
    vessel's own fixes is. A link is wrong if there is no such fix, if it is
    beyond the vessel's reach, or if fixes on both sides of the pass are all far
    away; it is also misattributed if another vessel fits better.
    """
    reach = REACH_KN * KNOT_KMH * F.greatest(dt_h, gap_h, F.lit(1e-6))
    far = vertex_km > WRONG_KM
    wrong = vertex_km.isNull() | F.coalesce(far & ((vertex_km > REACH_FACTOR * reach) | F.coalesce(brackets, F.lit(False))), F.lit(False))
    return reach, wrong, F.when(wrong | F.coalesce(better, F.lit(False)), "LIKELY_MISATTRIBUTION").otherwise("GENUINE_DISPLACEMENT")


def assess_links(links: DataFrame, sar: DataFrame, ais: DataFrame, alt_km: float = 5.0, alt_share: float = 0.5) -> DataFrame:
    """The structural verdict of links ``(sar_id, distance_km, time_gap_seconds)``, with what it rests on.

    The nearest own fix is among those within two hours of the pass, the earlier
    at a tie; the better vessel is the nearest other one within an hour.
    """
    asked = sar.join(links.select("sar_id"), "sar_id", "left_semi")
    dt = F.abs(F.col("rt") - F.col("t")) / HOUR_US
    own = own_window(asked, ais).withColumn("dt", dt).groupBy("sar_id").agg(
        F.count("*").alias("n_track"), F.min(F.struct("km", "rt", "dt")).alias("v"), (F.bool_or(F.col("rt") < F.col("t")) & F.bool_or(F.col("rt") > F.col("t"))).alias("brackets"))
    rows = links.join(own, "sar_id", "left").join(alternatives(asked, ais), "sar_id", "left")
    better = F.coalesce((F.col("best_alt_km") <= alt_km) & (F.col("best_alt_km") <= alt_share * F.col("distance_km")), F.lit(False))
    rows = rows.select("sar_id", "distance_km", F.coalesce("n_track", F.lit(0)).alias("n_track"), F.col("v.km").alias("vertex_km"), F.col("v.dt").alias("dt_h"), F.coalesce("brackets", F.lit(False)).alias("brackets"),
                       (F.col("time_gap_seconds") / 3600).alias("gap_h"), "best_alt_mmsi", "best_alt_km", better.alias("better_alt"))
    reach, wrong, verdict = structural_verdict(*[F.col(c) for c in ("vertex_km", "dt_h", "gap_h", "brackets", "better_alt")])
    return rows.select("*", F.when(F.col("vertex_km").isNotNull(), reach).alias("reach_km"), wrong.alias("struct_wrong"), verdict.alias("verdict"))


#: Fixed values of the baseline reading: share of flags inside the baseline area, hours of a lay-up, kilometres of a
#: confined and of an international area, port countries of either, reporting gaps, positions a day.
INSIDE_SHARE, LAYUP_H, CONFINED_KM, INTERNATIONAL_KM, FEW_COUNTRIES, MANY_COUNTRIES, MANY_GAPS, DENSE_A_DAY = 0.6, 504.0, 1500.0, 4000.0, 2, 4, 3, 200.0


def operating_baseline(events: DataFrame, key: str = "mmsi") -> DataFrame:
    """Per vessel the area, extent and habits over ``events(key, event_type, lat, lon, duration_hrs, country)``; two port calls at least make a longest stay."""
    kind = lambda k: F.col("event_type") == k
    extent = F.round(haversine(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")), 0)
    return events.groupBy(key).agg(
        F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.coalesce(extent, F.lit(0.0)).alias("extent_km"),
        F.when(F.count_if(kind("port_visit")) >= 2, F.max(F.when(kind("port_visit"), F.col("duration_hrs")))).alias("longest_stay_h"),
        F.countDistinct(F.when(kind("port_visit"), F.col("country"))).alias("n_countries"), F.count_if(kind("ais_gap")).alias("n_gaps"), F.count_if(kind("encounter")).alias("n_encounters"))


def baseline_reading(flags: DataFrame, baseline: DataFrame, identity: DataFrame, pad: float = 0.75) -> DataFrame:
    """Which reading of a vessel's flags its own baseline supports.

    ``flags`` has ``mmsi, lat, lon`` (a null place can't be located), ``baseline``
    is that of ``operating_baseline``, ``identity`` has ``mmsi, foc_tier, n_flags,
    n_names, positions_per_day``. Below a share of flags inside the padded area,
    or without located flags, the flags are outside the baseline. Else the
    counts of odd and of clean indicators choose between persistent, mixed and
    ordinary. A vessel without a baseline gives no row.
    """
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    inside = F.col("lat").between(F.col("y0") - pad, F.col("y1") + pad) & F.col("lon").between(F.col("x0") - pad, F.col("x1") + pad)
    # flags are counted by vessel before anything else meets them
    share = flags.join(baseline.select("mmsi", "y0", "y1", "x0", "x1"), "mmsi").groupBy("mmsi").agg(F.count("*").alias("n_flagged"), F.count_if(located).alias("n_located"), F.count_if(located & inside).alias("n_inside"))
    rows = share.join(baseline, "mmsi").join(identity, "mmsi", "left").withColumn("n_flags", F.coalesce("n_flags", F.lit(1))).withColumn("n_names", F.coalesce("n_names", F.lit(1)))
    c = F.col
    odd = {"shadow_fleet": c("foc_tier") == "shadow_fleet", "reflagged": c("n_flags") >= 2, "renamed": c("n_names") >= 2, "lay_up": c("longest_stay_h") > LAYUP_H,
           "confined": (c("extent_km") < CONFINED_KM) & (c("n_countries") <= FEW_COUNTRIES), "reporting_gaps": c("n_gaps") >= MANY_GAPS}
    clean = {"no_gaps": c("n_gaps") == 0, "no_encounters": c("n_encounters") == 0, "many_countries": c("n_countries") >= MANY_COUNTRIES, "international": c("extent_km") > INTERNATIONAL_KM,
             "stable_identity": (c("n_flags") == 1) & (c("n_names") == 1), "dense_positions": c("positions_per_day") > DENSE_A_DAY}
    named = lambda tests: F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))
    rows = rows.withColumn("share", F.try_divide(c("n_inside"), c("n_located"))).withColumn("odd", named(odd)).withColumn("clean", named(clean))
    n_odd, n_clean = F.size("odd"), F.size("clean")
    reading = (F.when(~F.coalesce(c("share") >= INSIDE_SHARE, F.lit(False)), "outside_baseline").when((n_odd >= 2) & (n_odd >= n_clean), "persistent").when(n_odd >= 1, "mixed").otherwise("ordinary"))
    return rows.select("mmsi", "n_flagged", "n_located", "share", F.array_join("odd", ";").alias("odd"), F.array_join("clean", ";").alias("clean"), reading.alias("reading"))


def corrected_pairs(corrected: DataFrame, ais: DataFrame, fence_km: float = TAIL_FENCE_KM) -> DataFrame:
    """Where both vessels of a corrected link ``(sar_id, t, lat, lon, mmsi, relinked_mmsi)`` were at the time nearest to it.

    One pass over the tracks serves both vessels. A vessel that is null or has
    no track gives nulls; ``tail_outlier`` tells whether the first vessel was
    beyond the fence, and is false without a position.
    """
    probe = F.struct("sar_id", "t")
    sides = corrected.select(F.explode(F.array(*[F.struct(F.col(c).alias("mmsi"), F.lit(n).alias("side"), probe.alias("p")) for n, c in enumerate(("mmsi", "relinked_mmsi"))])).alias("x"))
    asked = sides.select("x.mmsi", F.col("x.p.t").alias("t"), (F.col("x.p.sar_id") * 2 + F.col("x.side")).alias("probe"))
    seen = nearest_in_time(asked, ais, "probe").withColumn("sar_id", F.shiftright("probe", 1)).withColumn("side", F.pmod("probe", F.lit(2)))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    both = seen.groupBy("sar_id").agg(*[of(n, c).alias(f"{name}_{short}") for n, name in enumerate(("named", "relinked")) for c, short in (("ais_lat", "lat"), ("ais_lon", "lon"), ("minutes", "minutes"))])
    rows = corrected.select("sar_id", "lat", "lon", "mmsi", "relinked_mmsi").join(both, "sar_id", "left")
    rows = rows.withColumn("named_km", haversine(F.col("lat"), F.col("lon"), F.col("named_lat"), F.col("named_lon")))
    return rows.withColumn("tail_outlier", F.coalesce(F.col("named_km") > fence_km, F.lit(False)))
