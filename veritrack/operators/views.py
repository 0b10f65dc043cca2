"""Feeds of views and reports: incidents, inspections, comparisons, map records, drill-down rows, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrack.functions.timeutil import HOUR_US
from veritrack.operators.match import range_join
from veritrack.operators.nearest import rows_within


def _discrete(rows: DataFrame, flagged: Column, gap_us: int = 3 * HOUR_US) -> DataFrame:
    """``vessel, window, n``: flagged rows more than a gap apart, 0 where none is flagged."""
    w = Window.partitionBy("vessel", "window").orderBy("t")
    hit = rows.where(flagged).withColumn("new", F.coalesce(F.col("t") - F.lag("t").over(w) > gap_us, F.lit(True)))
    n = hit.groupBy("vessel", "window").agg(F.count_if("new").alias("n"))
    return rows.select("vessel", "window").distinct().join(n, ["vessel", "window"], "left").na.fill(0, ["n"])


def flag_events(classified: DataFrame, triples: DataFrame, pings: DataFrame, window: Column, spoofed_km: float = 20.0) -> DataFrame:
    """``vessel, window, source, observed, flagged_events, event_type`` from radar links, track deviations and clusters.

    Radar rows that are likely spoofed or farther than ``spoofed_km`` and steps
    of the high tier count as discrete events, cluster membership as genuine
    clusters; a vessel that a source saw without a flag has a row of 0.
    """
    at = lambda df: df.where("vessel is not null").withColumn("window", window)
    sar = at(classified.withColumn("vessel", F.coalesce("mmsi", "matched_mmsi")))
    a = _discrete(sar, F.coalesce((F.col("classification") == "likely_spoofed") | (F.col("distance_km") > spoofed_km), F.lit(False)))
    b = _discrete(at(triples.withColumnRenamed("mmsi", "vessel")), F.col("tier") == "high")
    c = at(pings).groupBy("vessel", "window").agg(F.countDistinct(F.when(F.col("coherence") == "genuine", F.col("cluster"))).alias("n"))
    named = ((a, "sar", "sar_ais_likely_spoofed"), (b, "trajectory", "trajectory_deviation_high"), (c, "clusters", "genuine_cluster_member"))
    parts = [df.select("vessel", "window", F.lit(s).alias("source"), F.lit(True).alias("observed"), F.col("n").alias("flagged_events"), F.lit(e).alias("event_type")) for df, s, e in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def incident_flags(triples: DataFrame, pings: DataFrame, summary: DataFrame, classified: DataFrame, own: DataFrame, spoofed_km: float = 20.0) -> DataFrame:
    """``vessel, check_name, t, lat, lon, metric, value, context``: every flag of a vessel as an incident.

    A high deviation stands at the actual place, a genuine cluster counts once
    with its first ping, a spoofed radar link at the interpolated place of the
    vessel itself, null where it has none.
    """
    a = triples.where("tier = 'high'").select(F.col("mmsi").alias("vessel"), F.lit("trajectory_deviation_high").alias("check_name"), "t", "lat", "lon", F.lit("deviation_km").alias("metric"), F.col("deviation_km").alias("value"), F.concat(F.lit("gap "), F.round("gap12", 1).cast("string"), F.lit(" h")).alias("context"))
    first = pings.where("coherence = 'genuine'").groupBy("vessel", "cluster").agg(F.min(F.struct("t", "lat", "lon")).alias("p"))
    b = first.join(summary.select("cluster", "radius_km", "n_vessels"), "cluster").select("vessel", F.lit("genuine_cluster_member").alias("check_name"), "p.t", "p.lat", "p.lon", F.lit("cluster_radius_km").alias("metric"), F.col("radius_km").alias("value"), F.concat(F.col("n_vessels").cast("string"), F.lit(" vessels")).alias("context"))
    bad = classified.where((F.col("classification") == "likely_spoofed") | (F.col("distance_km") > spoofed_km)).select("sar_id", F.coalesce("mmsi", "matched_mmsi").alias("vessel"), "t", "distance_km", "classification").where("vessel is not null")
    c = bad.join(own.select("sar_id", "ais_lat", "ais_lon"), "sar_id", "left").select("vessel", F.lit("sar_ais_likely_spoofed").alias("check_name"), "t", F.col("ais_lat").alias("lat"), F.col("ais_lon").alias("lon"), F.lit("sar_ais_distance_km").alias("metric"), F.col("distance_km").alias("value"), F.col("classification").alias("context"))
    return a.unionByName(b).unionByName(c)


def validate_cases(links: DataFrame, cases: DataFrame) -> DataFrame:
    """Known bad links ``(sar_id, bad_mmsi)`` against ``links``: passed if the vessel is another one or the detection is dark; absent detections don't pass."""
    rows = cases.join(links.select("sar_id", "relinked_mmsi", "link_status"), "sar_id", "left")
    ok = F.col("link_status").isin("dark_vessel", "relinked") & ~F.coalesce(F.col("relinked_mmsi") == F.col("bad_mmsi"), F.lit(False))
    return rows.select("sar_id", "bad_mmsi", "relinked_mmsi", F.coalesce("link_status", F.lit("not_in_dataset")).alias("link_status"), F.coalesce(ok, F.lit(False)).alias("passed"))


def near_port_inspection(flags: DataFrame, ais: DataFrame, speeds: DataFrame, near_km: float = 2.0, hours: int = 2, idle_kmh: float = 2.0) -> DataFrame:
    """Flags ``(flag_id, mmsi, t, lat, lon)`` with the other vessels met within an hour and whether the vessel slowed.

    ``speeds`` has ``mmsi, t, kmh`` of steps. The state is ``unknown`` without a
    step within ``hours``, ``idle`` if the slowest of them is at most
    ``idle_kmh``, else ``moving``.
    """
    met = rows_within(flags, ais, near_km, HOUR_US, ("flag_id", "mmsi")).where("other <> mmsi").groupBy("flag_id").agg(F.countDistinct("other").alias("n_met"), F.min("km").alias("nearest_km"))
    slow = range_join(flags.select("flag_id", "mmsi", "t"), speeds.select("mmsi", F.col("t").alias("rt"), "kmh").where("kmh is not null"), hours * HOUR_US, ("mmsi",)).groupBy("flag_id").agg(F.min("kmh").alias("min_kmh"))
    rows = flags.select("flag_id", "mmsi").join(met, "flag_id", "left").join(slow, "flag_id", "left")
    state = F.when(F.col("min_kmh").isNull(), "unknown").when(F.col("min_kmh") <= idle_kmh, "idle").otherwise("moving")
    return rows.select("flag_id", "mmsi", F.coalesce("n_met", F.lit(0)).alias("n_met"), "nearest_km", "min_kmh", state.alias("state"))


def region_comparison(rows: DataFrame, regions: dict[str, str]) -> DataFrame:
    """Shares of classes of two windows side by side, for pairs of windows of one region only.

    ``rows`` has ``window, kind, classification``; windows are few. ``like`` is
    false where the two windows are layers of different kinds.
    """
    region = F.create_map(*[F.lit(x) for pair in regions.items() for x in pair])
    n = rows.groupBy("window", "kind", "classification").agg(F.count("*").alias("n")).withColumn("region", F.try_element_at(region, F.col("window"))).where("region is not null")
    total = n.groupBy("window", "kind", "region").agg(F.sum("n").alias("total"))
    a, b = total.alias("a"), total.alias("b")
    pairs = a.join(b, (F.col("a.region") == F.col("b.region")) & (F.col("a.window") < F.col("b.window"))).select(F.col("a.region").alias("region"), F.col("a.window").alias("window_a"), F.col("b.window").alias("window_b"), (F.col("a.kind") == F.col("b.kind")).alias("like"), F.col("a.total").alias("ta"), F.col("b.total").alias("tb"))
    side = lambda w, c: n.select(F.col("window").alias(w), "classification", F.col("n").alias(c))
    classes = pairs.join(n.select("region", "classification").distinct(), "region")
    both = classes.join(side("window_a", "na"), ["window_a", "classification"], "left").join(side("window_b", "nb"), ["window_b", "classification"], "left").na.fill(0, ["na", "nb"])
    pct = lambda k, t: 100.0 * F.col(k) / F.col(t)
    return both.select("region", "window_a", "window_b", "like", "classification", pct("na", "ta").alias("pct_a"), pct("nb", "tb").alias("pct_b"), (pct("nb", "tb") - pct("na", "ta")).alias("diff"))


def map_records(view: DataFrame, hidden: tuple[str, ...] = ("no_ais_activity",)) -> DataFrame:
    """Records of a map layer from ``lat, lon, cls, mmsi, name, km``: position, label, popup lines; hidden classes are left out."""
    label = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("mmsi").cast("string"), F.lit("unknown"))
    lines = F.array_compact(F.array(F.concat(F.lit("class: "), F.col("cls")), F.concat(F.lit("mmsi: "), F.col("mmsi").cast("string")), F.concat(F.lit("km: "), F.format_number("km", 3))))
    return view.where(~F.col("cls").isin(*hidden)).select(F.struct(F.array("lon", "lat").alias("position"), F.col("cls").alias("layer"), label.alias("label"), F.array_join(lines, "\n").alias("popup")).alias("record"))


def normalisation_note(total: Column, windows: Column, flagged_windows: Column) -> Column:
    """What a vessel's flags say once they are put against the windows that saw it."""
    return (F.when(total == 0, "clean_record").when(windows <= 1, "single_window_low_confidence").when(flagged_windows == 1, "isolated_incident").otherwise("cross_window_pattern"))


def drill_down(vessel: int, scored: DataFrame, identity: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row on a vessel from its scores, identity and baseline; parts that are missing are null, an unknown vessel gives no row."""
    own = lambda df, key: df.where(F.col(key) == vessel)
    row = own(scored, "vessel").join(own(identity, "mmsi").withColumnRenamed("mmsi", "_i"), F.col("vessel") == F.col("_i"), "left").join(own(baseline, "mmsi").withColumnRenamed("mmsi", "_b"), F.col("vessel") == F.col("_b"), "left")
    return row.drop("_i", "_b")


def wrap_text(text: Column, width: int) -> Column:
    """Words of ``text`` in lines of at most ``width`` characters; a longer word has a line of its own, white space collapses."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def put(done: Column, word: Column) -> Column:
        last = F.element_at(F.split(done, "\n"), -1)
        return F.when(done == "", word).when(F.length(last) + 1 + F.length(word) <= width, F.concat(done, F.lit(" "), word)).otherwise(F.concat(done, F.lit("\n"), word))

    return F.aggregate(words, F.lit(""), put)
