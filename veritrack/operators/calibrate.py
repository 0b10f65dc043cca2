"""Thresholds from what a quiet region shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrack.functions.timeutil import HOUR_US
from veritrack.operators.nearest import nearest_rows
from veritrack.operators.quantiles import quantiles
from veritrack.plans.lineage import cut

GRID = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def hour_neighbours(ais: DataFrame) -> DataFrame:
    """Each row's distance to the nearest other vessel of its hour; rows alone in their hour give none."""
    return nearest_rows(ais, ais, "event_id", others=True).select("event_id", "km")


def percentile_grid(rows: DataFrame, value: str) -> DataFrame:
    """Exact percentiles with linear interpolation, in one row, with count, mean and maximum."""
    return quantiles(cut(rows.select(value)), value, {f"p{q * 100:g}".replace(".", "_"): q for q in GRID}).drop("std")


#: Pairs for thresholds to be trusted, and the share of excluded pairs beyond which the screen itself is doubtful.
LEAST_PAIRS, MOST_EXCLUDED = 200, 0.2


def distance_thresholds(screened: DataFrame, matched: float = 0.5, spoofed: float = 0.99) -> DataFrame:
    """One row from identity pairs ``(distance_km, keep)``: both percentiles before and after the screen, and how far to trust them.

    Without a kept pair the thresholds are null and the confidence is low.
    """
    held = cut(screened.select("distance_km", "keep"))
    shares = {"matched_km": matched, "spoofed_km": spoofed}
    raw = quantiles(held, "distance_km", shares).select(F.col("n").alias("n_pairs"), F.col("matched_km").alias("raw_p50"), F.col("spoofed_km").alias("raw_p99"))
    kept = quantiles(held.where("keep"), "distance_km", shares).select(F.col("n").alias("n_kept"), *shares)
    row = raw.crossJoin(F.broadcast(kept))  # one row each
    excluded = F.coalesce(F.try_divide(F.col("n_pairs") - F.col("n_kept"), F.col("n_pairs")), F.lit(0.0))
    return row.withColumn("confidence", F.when(F.col("n_kept") >= LEAST_PAIRS, "ok").otherwise("low")).withColumn("exclusion_warning", excluded > MOST_EXCLUDED)


def spatial_eps(rows: DataFrame, value: str, floor_km: float = 3.0) -> DataFrame:
    """The knee of nearest distances, its floor, and the other candidates for the radius: p75, p90, mean + one deviation of the population."""
    held = cut(rows.select(value))
    q = quantiles(held, value, {"p75": 0.75, "p90": 0.9})
    deviation = F.col("std") * F.sqrt(F.try_divide(F.col("n") - 1, F.col("n")))
    row = knee(held, value).crossJoin(F.broadcast(q))  # one row each
    return row.select("knee", F.greatest("knee", F.lit(floor_km)).alias("eps_km"), "p75", "p90", (F.col("mean") + F.coalesce(deviation, F.lit(0.0))).alias("mean_plus_1std"))


def bin_gaps(ais: DataFrame) -> DataFrame:
    """Positive gaps in hours between a vessel's successive bins."""
    w = Window.partitionBy("mmsi").orderBy("t")
    return ais.select("mmsi", ((F.col("t") - F.lag("t").over(w)) / HOUR_US).alias("gap_h")).where("gap_h > 0")


def tail(rows: DataFrame, value: str) -> DataFrame:
    """Tukey's far-out fence, what lies beyond it, and whether the tail is heavy."""
    held = cut(rows.select(value))
    q = quantiles(held, value, {"q1": 0.25, "q3": 0.75, "p95": 0.95, "p99": 0.99}).withColumn("fence", F.col("q3") + 3 * (F.col("q3") - F.col("q1")))
    n = held.crossJoin(F.broadcast(q)).agg(F.count_if(F.col(value) > F.col("fence")).alias("n_beyond"))  # q is one row
    return q.crossJoin(n).select("q1", "q3", "p95", "p99", "fence", "n_beyond", ((F.col("p99") > 2 * F.col("p95")) & (F.col("n_beyond") > 0)).alias("heavy_tail"))


def knee(rows: DataFrame, value: str, buckets: int = 64) -> DataFrame:
    """The value farthest from the chord of the sorted curve, the first of equals.

    Ranks are made without one global sort: counts of equal values are summed
    within ranges of about equal numbers of rows first and then over the few
    ranges. The chord distance only grows within equal values towards an end, so
    the first and last rank of each value are enough. A constant curve gives its
    last value, as do fewer than three rows.
    """
    counts = cut(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")))
    r = counts.agg(F.percentile_approx("v", [k / buckets for k in range(1, buckets)], 1000).alias("edges")).first()
    ends = counts.agg(F.min("v").alias("y0"), F.max("v").alias("y1"), F.sum("c").alias("n"))
    edges = F.array(*map(F.lit, sorted(set(r.edges or [])))).cast("array<double>")
    part = counts.crossJoin(F.broadcast(ends)).withColumn("part", F.size(F.filter(edges, lambda e: e <= F.col("v"))))
    before = part.groupBy("part").agg(F.sum("c").alias("s")).select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.sum("c").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = part.withColumn("upto", inner).join(F.broadcast(before), "part").withColumn("last", F.col("before") + F.col("upto") - 1).withColumn("first", F.col("last") - F.col("c") + 1)
    points = ranked.select("v", "y0", "y1", "n", F.explode(F.array("first", "last")).alias("x"))
    chord = F.sqrt(F.pow(F.col("n") - 1, F.lit(2)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2)))
    d = F.try_divide(F.abs((F.col("y1") - F.col("y0")) * F.col("x") - (F.col("n") - 1) * (F.col("v") - F.col("y0"))), chord)
    best = points.agg(F.max_by("v", F.struct(F.round(d, 9), -F.col("x"))).alias("k"), F.max("n").alias("n"), F.max("y1").alias("y1"), F.min("y0").alias("y0"))
    return best.select(F.when((F.col("n") < 3) | (F.col("y0") == F.col("y1")), F.col("y1")).otherwise(F.col("k")).alias("knee"))


def region_thresholds(rows: DataFrame, region: str, matched: float = 0.5, spoofed: float = 0.99) -> DataFrame:
    """Thresholds of each of a few regions from ``(region, distance_km)``: ``region, n, matched_km, spoofed_km, confidence``."""
    q = quantiles(cut(rows.select(region, "distance_km")), "distance_km", {"matched_km": matched, "spoofed_km": spoofed}, region)
    return q.select(region, "n", "matched_km", "spoofed_km", F.when(F.col("n") >= LEAST_PAIRS, "ok").otherwise("low").alias("confidence"))
