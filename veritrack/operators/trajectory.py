"""Tracks against their own motion, step speeds and route plausibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrack.functions.geo import bearing, destination, haversine
from veritrack.functions.timeutil import HOUR_US
from veritrack.plans.stages import once

KNOT_KMH = 1.852


def deviation_tier(km: Column, hours: Column, normal: float = 5.0, notable: float = 25.0) -> Column:
    return F.when(km <= normal * F.sqrt(hours), "normal").when(km <= notable * F.sqrt(hours), "notable").otherwise("high")


def predict_triples(ais: DataFrame) -> DataFrame:
    """Constant-velocity prediction of each track row from the two before it.

    Rows are ordered by time and position and not de-duplicated; a triple with
    a zero gap is left out. A vessel that did not move is predicted in place.
    """
    w = Window.partitionBy("mmsi").orderBy("t", "lat", "lon", "event_id")
    p = F.struct("t", "lat", "lon")
    rows = ais.withColumn("p0", F.lag(p, 2).over(w)).withColumn("p1", F.lag(p, 1).over(w)).where("p0 is not null")
    rows = rows.withColumn("gap01", (F.col("p1.t") - F.col("p0.t")) / HOUR_US).withColumn("gap12", (F.col("t") - F.col("p1.t")) / HOUR_US).where("gap01 > 0 and gap12 > 0")
    p0, p1 = ("p0.lat", "p0.lon"), ("p1.lat", "p1.lon")
    here = [F.col(c) for c in (*p0, *p1)]
    moved = haversine(*here)
    # the optimiser may evaluate this before the guard above
    rows = once(rows, speed_kmh=F.try_divide(moved, F.col("gap01")), heading=bearing(*here))
    y, x = destination(F.col("p1.lat"), F.col("p1.lon"), F.col("heading"), F.col("speed_kmh") * F.col("gap12"))
    still = F.col("speed_kmh") == 0
    rows = once(rows, predicted_lat=F.when(still, F.col("p1.lat")).otherwise(y), predicted_lon=F.when(still, F.col("p1.lon")).otherwise(x))
    rows = once(rows, deviation_km=haversine(F.col("predicted_lat"), F.col("predicted_lon"), F.col("lat"), F.col("lon")))
    step = haversine(F.col("p1.lat"), F.col("p1.lon"), F.col("lat"), F.col("lon"))
    return rows.select("event_id", "mmsi", "t", "lat", "lon", "gap01", "gap12", step.alias("step_km"), "speed_kmh", "predicted_lat", "predicted_lon", "deviation_km", deviation_tier(F.col("deviation_km"), F.col("gap12")).alias("tier"))


def step_speeds(ais: DataFrame) -> DataFrame:
    """Speed from the row before, null where no time passed."""
    w = Window.partitionBy("mmsi").orderBy("t", "lat", "lon", "event_id")
    rows = ais.withColumn("q", F.lag(F.struct("t", "lat", "lon")).over(w))
    km, hours = haversine(F.col("q.lat"), F.col("q.lon"), F.col("lat"), F.col("lon")), (F.col("t") - F.col("q.t")) / HOUR_US
    kmh = F.when(hours > 0, F.try_divide(km, hours))
    return rows.select("event_id", "mmsi", "t", "lat", "lon", km.alias("step_km"), hours.alias("hours"), kmh.alias("kmh"), (kmh / KNOT_KMH).alias("knots"), F.col("q.lat").alias("lat0"), F.col("q.lon").alias("lon0"))


#: Knots that a class reaches normally, and the keywords that name a class, by precedence.
ENVELOPES = {"commercial_slow": 22.0, "commercial_fast": 28.0, "passenger": 34.0, "fishing": 16.0, "utility": 16.0, "unknown": 24.0}
TYPE_KEYWORDS = (
    ("commercial_slow", "tanker|lng|lpg|gas|crude|product|bulk|cargo|ore|chemical"),
    ("commercial_fast", "container|reefer|ro_ro|roro|vehicle|car_carrier"),
    ("passenger", "passenger|ferry|cruise|ropax|hsc|high_speed"),
    ("fishing", "fishing|trawler|seiner|gear|fish"),
    ("utility", "tug|pilot|patrol|supply|landing_craft|workboat|service|dredg|sar|tender|mooring"),
)


def norm_type(vessel_type: Column) -> Column:
    """Lower-case with underscores; null for blank."""
    return F.nullif(F.lower(F.translate(F.trim(vessel_type), " -/", "___")), F.lit(""))


def type_class(vessel_type: Column) -> Column:
    """The first class with a keyword in the type; a container ship is never slow, a bare ``other`` is."""
    t = F.coalesce(norm_type(vessel_type), F.lit(""))
    out = F.when(t.rlike(TYPE_KEYWORDS[0][1]) & ~t.contains("container"), TYPE_KEYWORDS[0][0])
    for name, words in TYPE_KEYWORDS[1:]:
        out = out.when(t.rlike(words), name)
    return out.when(t == "other", "commercial_slow").otherwise("unknown")


def needs_route(km: Column, hours: Column, flagged: Column) -> Column:
    return (km >= 1) & (flagged | (km >= 20) | (km / F.greatest(hours, F.lit(1e-6)) / KNOT_KMH >= 12) | (hours >= 6))


def route_verdict(km: Column, hours: Column, sea_km: Column, kind: Column, ceiling: float = 45.0, trusted_km: float = 120.0, meaningful_km: float = 40.0) -> tuple[Column, Column, Column]:
    """``(required knots, method, verdict)`` of a transition.

    The sea distance may be null; it counts where the hop is long enough and
    the detour believable. Two fixes within a minute are judged by separation.
    """
    trust = (km >= meaningful_km) & ~((km < 100) & (sea_km > 2.5 * km + 15))
    used = F.when(sea_km.isNotNull() & trust, F.greatest(sea_km, km)).otherwise(km)
    knots = F.when(hours > 0, used / F.nullif(hours, F.lit(0.0)) / KNOT_KMH)
    straight = F.when(hours > 0, km / F.nullif(hours, F.lit(0.0)) / KNOT_KMH)
    limit = F.element_at(F.create_map(*[F.lit(v) for pair in ENVELOPES.items() for v in pair]), kind)
    instant = hours <= 1 / 60
    moving = F.when((straight > ceiling) | ((knots > ceiling) & (km >= trusted_km)), "PHYSICALLY_IMPOSSIBLE").when((knots > limit) | (straight > limit), "IMPLAUSIBLE_BUT_POSSIBLE").otherwise("PLAUSIBLE")
    verdict = (F.when(hours.isNull(), "UNDETERMINED").when(instant & (km >= 5), "PHYSICALLY_IMPOSSIBLE").when(instant & (km >= 1), "IMPLAUSIBLE_BUT_POSSIBLE").when(instant | (km < 1), "PLAUSIBLE").otherwise(moving))
    method = F.when(hours.isNull(), "none").when(instant, "separation_only").when(km < 1, "stationary").when(sea_km.isNull(), "straight_line").when(trust, "sea_route").otherwise("sea_route_not_used")
    return F.when(instant | (km < 1), straight).otherwise(knots), method, verdict


def transitions(ais: DataFrame) -> DataFrame:
    """Consecutive fixes of each vessel with the plausibility of the step on a straight line."""
    kinds = ais.groupBy("mmsi").agg(F.min("vessel_type").alias("vessel_type"))
    rows = step_speeds(ais).where("hours is not null").join(kinds, "mmsi").withColumn("kind", type_class(F.col("vessel_type")))
    knots, method, verdict = route_verdict(F.col("step_km"), F.col("hours"), F.lit(None).cast("double"), F.col("kind"))
    return rows.select("event_id", "mmsi", "kind", "step_km", "hours", knots.alias("required_knots"), method.alias("route_method"), verdict.alias("classification"))
