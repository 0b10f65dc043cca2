"""Points in intervals, by equi keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def stab(points: DataFrame, intervals: DataFrame, keys: tuple[str, ...], t: str = "t", start: str = "t_start", end: str = "t_end", bucket_us: int = DAY_US, how: str = "left") -> DataFrame:
    """``points`` with the columns of the intervals ``[start, end]`` of equal keys that hold their ``t``.

    An interval goes to each bucket of time that it touches, a point has one
    bucket; key and bucket are the equi keys, so one busy key falls apart by
    time. A point in several intervals comes once for each, with ``how`` left a
    point in none once with nulls.
    """
    held = intervals.withColumn("_b", F.explode(F.sequence(F.expr(f"{start} div {bucket_us}"), F.expr(f"{end} div {bucket_us}"))))
    held = held.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    probe = points.withColumn("_p", F.expr(f"{t} div {bucket_us}"))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_p") == F.col("_b"), F.col(t) >= F.col(start), F.col(t) <= F.col(end)]
    return probe.join(held, on, how).drop("_p", "_b", *[f"_k{i}" for i in range(len(keys))])
