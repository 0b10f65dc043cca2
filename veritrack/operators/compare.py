"""What changed between two runs: nested reports by path, and thresholds side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StructType


def leaf_paths(kind: DataType, path: str = "") -> list[tuple[str, bool]]:
    """Paths of the leaves of a nested type and whether they are numbers; arrays and maps are leaves."""
    if isinstance(kind, StructType):
        return [leaf for f in kind.fields for leaf in leaf_paths(f.dataType, f"{path}.{f.name}" if path else f.name)]
    return [(path, isinstance(kind, NumericType))]


def by_path(report: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, path, value, number`` of nested rows: a row for each leaf that is not null; arrays and maps as JSON."""
    inner = StructType([f for f in report.schema.fields if f.name not in keys])

    def text(path: str):
        kind: DataType = inner
        for name in path.split("."):
            kind = kind[name].dataType
        return F.to_json(F.col(path)) if isinstance(kind, (ArrayType, MapType)) else F.col(path).cast("string")

    leaves = [F.struct(F.lit(p).alias("path"), text(p).alias("value"), (F.col(p).cast("double") if number else F.lit(None).cast("double")).alias("number")) for p, number in leaf_paths(inner)]
    return report.select(*keys, F.inline(F.array(*leaves))).where("value is not null")


def report_diff(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, path, before, after, delta, status`` for every path of either report.

    ``status`` is same, changed, added or removed; ``delta`` is the difference of
    numbers on both sides. The reports may differ in shape; a null leaf counts as
    absent. Reports are matched by ``keys``, so one row each without.
    """
    on = [*keys, "path"]
    a = by_path(before, keys).withColumnsRenamed({"value": "before", "number": "_a"})
    b = by_path(after, keys).withColumnsRenamed({"value": "after", "number": "_b"})
    same = F.coalesce(F.col("_a") == F.col("_b"), F.col("before") == F.col("after"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(same, "same").otherwise("changed")
    return a.join(b, on, "full").select(*on, "before", "after", (F.col("_b") - F.col("_a")).alias("delta"), status.alias("status"))
