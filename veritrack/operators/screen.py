"""Screening of identity links: own-track bracket, better alternatives, keep rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrack.functions.geo import haversine
from veritrack.functions.timeutil import HOUR_US
from veritrack.operators.match import range_join
from veritrack.operators.nearest import nearest_rows
from veritrack.plans.lineage import cut


def _track(ais: DataFrame, mmsi: str) -> DataFrame:
    return ais.select(F.col("mmsi").alias(mmsi), F.col("t").alias("rt"), F.col("lat").alias("y"), F.col("lon").alias("x"))


def own_window(sar: DataFrame, ais: DataFrame, hours: int = 2) -> DataFrame:
    """Own-track rows within ``hours`` of a detection, with their distance."""
    pairs = range_join(sar.where("mmsi is not null").select("sar_id", "mmsi", "t", "lat", "lon"), _track(ais, "mmsi"), hours * HOUR_US, ("mmsi",))
    return pairs.withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")))


def bracket(sar: DataFrame, ais: DataFrame, hours: int = 2, far_km: float = 15.0) -> DataFrame:
    """``unsupported`` without own rows, ``elsewhere`` if rows strictly on both sides are all far, else ``consistent``."""
    own = own_window(sar, ais, hours).groupBy("sar_id").agg(F.count("*").alias("n_own"), F.min("km").alias("own_km"), F.bool_or(F.col("rt") < F.col("t")).alias("before"), F.bool_or(F.col("rt") > F.col("t")).alias("after"))
    rows = sar.where("mmsi is not null").select("sar_id").join(own, "sar_id", "left")
    status = F.when(F.col("n_own").isNull(), "unsupported").when(F.col("before") & F.col("after") & (F.col("own_km") > far_km), "elsewhere").otherwise("consistent")
    return rows.select("sar_id", F.coalesce("n_own", F.lit(0)).alias("n_own"), "own_km", F.coalesce(F.col("before") & F.col("after"), F.lit(False)).alias("brackets"), status.alias("bracket_status"))


def alternatives(sar: DataFrame, ais: DataFrame, hours: int = 1) -> DataFrame:
    """The nearest row of another vessel within ``hours``: ``(sar_id, best_alt_mmsi, best_alt_km)``."""
    near = nearest_rows(sar, ais, "sar_id", hours * HOUR_US, others=True)
    return near.select("sar_id", F.col("mmsi").alias("best_alt_mmsi"), F.col("km").alias("best_alt_km"))


def keep_links(identity: DataFrame, sar: DataFrame, ais: DataFrame, least_km: float = 10.0, alone_km: float = 25.0, alt_km: float = 5.0, alt_share: float = 0.5) -> DataFrame:
    """The keep rule for identity pairs ``(sar_id, distance_km)``; only pairs beyond ``least_km`` are screened."""
    identity = cut(identity.select("sar_id", "distance_km"))
    far = sar.join(identity.where(F.col("distance_km") > least_km).select("sar_id"), "sar_id", "left_semi")
    rows = identity.join(bracket(far, ais), "sar_id", "left").join(alternatives(far, ais), "sar_id", "left")
    better = F.coalesce((F.col("best_alt_km") <= alt_km) & (F.col("best_alt_km") <= alt_share * F.col("distance_km")), F.lit(False))
    status = F.coalesce("bracket_status", F.lit("not_screened"))
    drop = (status == "elsewhere") | ((status != "not_screened") & better) | ((status == "unsupported") & (F.col("distance_km") > alone_km))
    return rows.select("sar_id", "distance_km", status.alias("bracket_status"), better.alias("better_alt_exists"), (~drop).alias("keep"))
