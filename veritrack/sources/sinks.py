"""Writers: stage tables, the audit log and the pull cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, by: str = "window") -> None:
    """A stage's output, replaced, in a folder for each window where there is one."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by in df.columns else w).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Nested rows as JSON documents."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Decisions added to a JSON-lines log with the time of logging."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str, path: str) -> DataFrame:
    """The old rows with the new in place of equal keys, written as a new version; nothing is changed in place."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    kept.unionByName(new, allowMissingColumns=True).write.mode("errorifexists").parquet(path)
    return old.sparkSession.read.parquet(path)
