"""Time as microseconds since 1970, and runs of rows by gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def with_runs(df: DataFrame, key: str, t: str = "t", gap_us: int = 3 * HOUR_US, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``run``: a new one begins where the gap to the row before is over ``gap_us``; an equal gap stays."""
    w = Window.partitionBy(key).orderBy(t, *order)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap_us).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
