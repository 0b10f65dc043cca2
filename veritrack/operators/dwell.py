"""Vessels that stay in place."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrack.functions.timeutil import HOUR_US, with_runs

_R = 6371.0088


def stays(t: np.ndarray, y: np.ndarray, x: np.ndarray, radius_km: float) -> list[tuple[int, int, float, float]]:
    """``(first, end, mean lat, mean lon)`` of runs whose members all stay within ``radius_km`` of each new mean.

    Running sums give the mean. While the box of the members lies within the
    radius nothing else is looked at, so a moored vessel takes one step a row;
    otherwise the distinct places of the stay are.
    """
    out, start, n = [], 0, len(t)
    sy = sx = 0.0
    box, places = [0.0] * 4, {}
    for i in range(n + 1):
        if i < n:
            a, b = float(y[i]), float(x[i])
            if i > start:
                cy, cx = (sy + a) / (i - start + 1), (sx + b) / (i - start + 1)
                wide = [min(box[0], a), max(box[1], a), min(box[2], b), max(box[3], b)]
                if not _box_within(wide, cy, cx, radius_km):
                    p = np.array([*places, (a, b)])
                    if _km(p[:, 0], p[:, 1], cy, cx).max() > radius_km:
                        out.append((start, i, sy / (i - start), sx / (i - start)))
                        start, sy, sx, places = i, 0.0, 0.0, {}
                        wide = [a, a, b, b]
                box = wide
            else:
                box = [a, a, b, b]
            sy, sx = sy + a, sx + b
            places[a, b] = None
        elif n:
            out.append((start, n, sy / (n - start), sx / (n - start)))
    return out


def _box_within(box: list[float], cy: float, cx: float, radius_km: float) -> bool:
    """Whether a bound of the distance to the farthest place of a box is within the radius."""
    dy, dx = max(cy - box[0], box[1] - cy), max(cx - box[2], box[3] - cx)
    widest = 1.0 if box[0] <= 0 <= box[1] else max(math.cos(math.radians(box[0])), math.cos(math.radians(box[1])))
    far = math.sin(math.radians(dy) / 2) ** 2 + math.cos(math.radians(cy)) * widest * math.sin(math.radians(min(dx, 180.0)) / 2) ** 2
    return 2 * _R * math.asin(min(1.0, math.sqrt(far))) <= radius_km * (1 - 1e-9)


def dwell_episodes(ais: DataFrame, radius_km: float = 5.0, gap_h: float = 6.0, least_h: float = 6.0) -> DataFrame:
    """Runs of a vessel within ``radius_km`` of their running centroid, of ``least_h`` at least.

    Tracks are cut at gaps over ``gap_h`` first, so a group is a stretch of a
    vessel without a gap and not its whole track; within it the walk depends on
    order. Rows with a null are left out.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["run", "t", "lat", "lon"])
        run, t, y, x = (rows[c].to_numpy() for c in ("run", "t", "lat", "lon"))
        edges, out = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(t)], []
        for begin, stop in zip(edges, edges[1:], strict=False):
            for first, end, cy, cx in stays(t[begin:stop], y[begin:stop], x[begin:stop], radius_km):
                first, end = first + begin, end + begin
                hours = (t[end - 1] - t[first]) / HOUR_US
                if hours >= least_h:
                    out.append((int(rows["mmsi"].iloc[0]), int(t[first]), int(t[end - 1]), hours, end - first, (end - first) / (hours + 1), cy, cx, float(_km(y[first:end], x[first:end], cy, cx).max())))
        return pd.DataFrame(out, columns=["mmsi", "t_start", "t_end", "duration_h", "n_bins", "continuity", "lat", "lon", "radius_km"])

    runs = with_runs(ais.select("mmsi", "t", "lat", "lon").na.drop(), "mmsi", gap_us=round(gap_h * HOUR_US), order=("lat", "lon"))
    # a few stretches share a group, as a group has a cost of its own
    some = runs.withColumn("part", F.expr("run div 64"))
    return some.groupBy("mmsi", "part").applyInPandas(walk, "mmsi long, t_start long, t_end long, duration_h double, n_bins long, continuity double, lat double, lon double, radius_km double")


def _km(y, x, cy, cx):
    a = np.sin(np.radians(y - cy) / 2) ** 2 + np.cos(np.radians(cy)) * np.cos(np.radians(y)) * np.sin(np.radians(x - cx) / 2) ** 2
    return 2 * _R * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def duration_tier(hours: Column) -> Column:
    return F.when(hours <= 48, "ordinary").when(hours <= 168, "extended").otherwise("prolonged")


def dwell_scores(rows: DataFrame, span_h: float, flagged_km: float = 25.0, anchorage_km: float = 20.0, resident: float = 0.95) -> DataFrame:
    """Adds tier, location class, score and trigger to episodes that have ``facility_km``, ``anchorage_km`` and ``domestic``."""
    rows = rows.withColumn("dwell_tier", duration_tier(F.col("duration_h")))
    rows = rows.withColumn("location_class", F.when(F.col("facility_km") <= flagged_km, "flagged_facility").when(F.col("anchorage_km") <= anchorage_km, "ordinary_anchorage").otherwise("open_water"))
    rows = rows.withColumn("resident", F.col("duration_h") >= resident * span_h)
    at, away = F.col("location_class") == "flagged_facility", ~F.col("resident")
    foreign = at & ~F.coalesce("domestic", F.lit(False))
    score = F.when(F.col("dwell_tier") == "ordinary", 0).when(F.col("dwell_tier") == "extended", 1).otherwise(2) + F.when(at, 2).when(F.col("location_class") == "open_water", 1).otherwise(0) + away.cast("int") + foreign.cast("int")
    prolonged = (F.col("dwell_tier") == "prolonged") & away
    rows = rows.withColumn("dwell_score", score)
    rows = rows.withColumn("trigger_category", F.when(prolonged & foreign, "prolonged_dwell_at_flagged_facility").when(prolonged & (F.col("location_class") == "open_water"), "prolonged_dwell_open_water").otherwise(""))
    return rows.withColumn("escalate", F.col("trigger_category") == "prolonged_dwell_at_flagged_facility")
