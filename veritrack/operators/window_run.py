"""The chain of one detection window."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrack.operators import cluster, match, relink, screen, trajectory
from veritrack.plans.lineage import cut


class WindowResult(NamedTuple):
    relinked: DataFrame
    classified: DataFrame
    deviations: DataFrame
    clusters: DataFrame
    kept_links: DataFrame


def merchant(ais: DataFrame, types: tuple[str, ...] | None) -> DataFrame:
    """Rows of the wanted types; of type OTHER none whose name is that of fishing gear. None passes all."""
    if types is None:
        return ais
    gear = (F.col("vessel_type") == "OTHER") & F.coalesce(F.col("ship_name").rlike("(?i)fish|net|buoy"), F.lit(False))
    return ais.where(F.col("vessel_type").isin(*types) & ~gear)


def run_window(sar: DataFrame, ais: DataFrame, matched_km: float = 1.5, spoofed_km: float = 20.0, eps_km: float = 8.0, eps_h: float = 2.0, types: tuple[str, ...] | None = None) -> WindowResult:
    """Relink, classify, predict and cluster; the radii given here are those that the clustering uses."""
    classified = cut(match.match_and_classify(sar, ais, matched_km, spoofed_km))
    deviations = cut(trajectory.predict_triples(merchant(ais, types)))
    found = cluster.st_dbscan(cluster.episodes(cluster.anomalies(classified, deviations)), eps_km, eps_h)
    kept = cut(screen.keep_links(classified.where("time_gap_seconds is not null").select("sar_id", "distance_km"), sar, ais))
    return WindowResult(relink.relink_window(sar, ais, "repair", kept), classified, deviations, found, kept)
