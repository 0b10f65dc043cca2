"""Who a vessel says it is over time: the current identity and validity intervals of flags and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a report of fewer positions and without a name is a stub.
LEAST_POSITIONS = 1000

REPORT = ("mmsi", "ssvid", "id", "flag", "name", "imo", "t_from", "t_to", "positions")


def _history(reports: DataFrame) -> DataFrame:
    """Reports that count, blank flags and names as null: stubs are dropped."""
    rows = reports.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) if c in ("flag", "name") else F.col(c) for c in REPORT])
    return rows.where((F.coalesce("positions", F.lit(0)) >= LEAST_POSITIONS) | F.col("name").isNotNull())


def current_identity(reports: DataFrame) -> DataFrame:
    """One row for each ``mmsi``: the latest report under its own number, and how many flags and names the hull has had.

    ``reports`` has ``mmsi`` (asked for), ``ssvid`` (reported), ``id, flag, name,
    imo, t_from, t_to, positions``. A report with a name goes before one
    without, then the later end, then the later start and the greater id. A
    vessel that never reported its own number has ``available`` false and nulls.
    """
    rows = reports.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) if c in ("flag", "name") else F.col(c) for c in REPORT])
    own = F.col("ssvid") == F.col("mmsi").cast("string")
    key = F.struct(F.col("name").isNotNull(), F.coalesce("t_to", F.lit(0)), F.coalesce("t_from", F.lit(0)), F.coalesce("id", F.lit("")))
    last = F.max_by(F.struct("id", "name", "flag", "imo", "positions", "t_from", "t_to"), F.when(own, key))
    now = rows.groupBy("mmsi").agg(F.coalesce(F.bool_or(own), F.lit(False)).alias("available"), last.alias("c"))
    past = _history(reports).groupBy("mmsi").agg(F.countDistinct("flag").alias("n_flags"), F.countDistinct("name").alias("n_names"), F.count("*").alias("n_reports"))
    out = now.join(past, "mmsi", "left").na.fill(0, ["n_flags", "n_names", "n_reports"])
    return out.select("mmsi", "available", *[F.when(F.col("available"), F.col(f"c.{c}")).alias(c) for c in ("id", "name", "flag", "imo", "positions", "t_from", "t_to")], "n_flags", "n_names", "n_reports")


def validity_intervals(reports: DataFrame) -> DataFrame:
    """``mmsi, seq, flag, name, t_from, t_to, valid_to, reflagged, renamed``: stretches of reports that agree on flag and name.

    Reports come by start, end and id. A new stretch begins where flag or name
    changes, a null counting as a value; it holds until the next one begins.
    ``reflagged`` and ``renamed`` tell whether the last known flag or name before
    the stretch is another one.
    """
    w = Window.partitionBy("mmsi").orderBy("t_from", "t_to", "id")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = _history(reports).withColumn("_n", F.row_number().over(w))
    changed = (F.col("_n") == 1) | ~F.col("flag").eqNullSafe(F.lag("flag").over(w)) | ~F.col("name").eqNullSafe(F.lag("name").over(w))
    other = lambda c: F.coalesce(F.last(c, True).over(past) != F.col(c), F.lit(False))
    rows = rows.withColumn("_new", changed.cast("int")).withColumn("_flag", other("flag")).withColumn("_name", other("name"))
    rows = rows.withColumn("seq", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("mmsi", "seq").agg(F.first("flag").alias("flag"), F.first("name").alias("name"), F.min("t_from").alias("t_from"), F.max("t_to").alias("t_to"),
                                           F.bool_or("_flag").alias("reflagged"), F.bool_or("_name").alias("renamed"))
    return runs.withColumn("valid_to", F.lead("t_from").over(Window.partitionBy("mmsi").orderBy("seq")))


def change_counts(intervals: DataFrame) -> DataFrame:
    """How often each vessel changed its flag and its name, and the order of its flags."""
    return intervals.groupBy("mmsi").agg(
        F.count_if("reflagged").alias("n_reflags"), F.count_if("renamed").alias("n_renames"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("seq") == 1) | F.col("reflagged"), F.struct("seq", "flag")))), lambda x: F.coalesce(x["flag"], F.lit("?"))), ">").alias("flags"))
