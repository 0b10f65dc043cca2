"""Columns that are computed once, whatever is made of them later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, which later expressions and filters read and never repeat.

    A chain of projections is merged by the optimiser, and each use of a column
    then repeats its expression, until a stage's code is too long to compile.
    Rows from a generator are not merged with what follows.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
