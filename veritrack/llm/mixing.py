"""Mixing sources to target weights by iterative proportional fitting (operator 8).

DataFrame operations only. Token counts and topics are columns that the caller
names; without them words count as tokens and the length class is the topic.
Documents fall into cells of source, language and topic; a value that has no target is in the cell of
``other``, so the number of cells is bounded by the targets alone. The cells'
token weights are raked until each of the three margins has its target shares,
inside one row of arrays that the targets bound, until every margin is within
``TOLERANCE`` of its target or ``ROUNDS`` rounds are over. A document's chance is its
cell's raked weight over its present weight, scaled so that the greatest is 1,
and a hash of its id decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER = "other"
DIMENSIONS = ("source", "lang", "topic")
ROUNDS, TOLERANCE = 200, 1e-6
#: Shares by value; they are scaled to the values that occur. Values not named share the one of ``other``.
TARGETS: dict[str, dict[str, float]] = {
    "source": {"src0": 0.1, **{f"src{i}": 0.047 for i in range(1, 20)}, OTHER: 0.047},
    "lang": {"en": 0.6, "de": 0.155, "fr": 0.145, "es": 0.1, OTHER: 0.02},
    "topic": {"short": 0.025, "medium": 0.6, "long": 0.375},
}


def n_words(text: Column) -> Column:
    """Runs outside space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def topic(words: Column) -> Column:
    """The default topic: what the length says of the kind of text."""
    return F.when(words < 100, "short").when(words < 1000, "medium").otherwise("long")


def keyword_topic(text: Column, keywords: dict[str, tuple[str, ...]], least: int = 1) -> Column:
    """The topic with the most whole-word matches of its keywords, the first by name of equals; ``other`` below ``least`` matches or for null."""
    low = F.lower(text)
    counts = [F.struct(F.coalesce(F.regexp_count(low, F.lit(r"\b(?:" + "|".join(words) + r")\b")), F.lit(0)).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words) in enumerate(sorted(keywords.items()))]
    best = F.greatest(*counts) if len(counts) > 1 else counts[0]
    return F.when(best["n"] >= least, best["name"]).otherwise(OTHER)


def unit_hash(doc_id: Column) -> Column:
    """A number in [0, 1) from the MD5 of the id's decimal text."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _with_targets(one: DataFrame, d: str, targets: dict[str, float]) -> DataFrame:
    """Adds a dimension's values in the cells, their shares, and each cell's place among the values."""
    one = one.withColumn(f"{d}_names", F.array_sort(F.array_distinct(F.col("cells")[d])))
    one = one.withColumn("wants", F.transform(f"{d}_names", lambda v: F.coalesce(F.element_at(_map(targets), v), F.lit(0.0))))
    total = F.aggregate("wants", F.lit(0.0), lambda a, x: a + x)
    at = F.transform(F.col("cells")[d], lambda v: F.array_position(F.col(f"{d}_names"), v).cast("int"))
    return one.withColumns({f"{d}_wants": F.transform("wants", lambda x: F.try_divide(x, total)), f"{d}_at": at}).drop("wants")


def cell_weights(rows: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``source, lang, topic, tokens, weight, rounds, margin_error`` for each cell of ``rows(source, lang, topic, n_tokens)`` that has tokens.

    ``weight`` is the raked number of tokens, with the same total. ``rounds``
    and ``margin_error`` tell after how many rounds raking ended, and how far
    the share of a value was from its target when the last of them began; cells
    that are empty can keep margins from ever being met.
    """
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens")).where("tokens > 0")
    one = cells.groupBy().agg(F.sort_array(F.collect_list(F.struct(*DIMENSIONS, "tokens"))).alias("cells"))
    for d in DIMENSIONS:
        one = _with_targets(one, d, targets[d])

    def rake(state: Column, d: str) -> Column:
        """Scales ``state(w, error)`` to one dimension's targets; the error grows to the largest miss before it."""
        margin = F.transform(F.sequence(F.lit(1), F.size(f"{d}_names")), lambda k: F.aggregate(F.zip_with(state["w"], F.col(f"{d}_at"), lambda w, at: F.when(at == k, w).otherwise(0.0)), F.lit(0.0), lambda a, w: a + w))
        factor = F.zip_with(F.col(f"{d}_wants"), margin, lambda want, have: F.coalesce(F.try_divide(want, have), F.lit(0.0)))
        miss = F.aggregate(F.zip_with(F.col(f"{d}_wants"), margin, lambda want, have: F.abs(want - have)), F.lit(0.0), lambda a, x: F.greatest(a, x))
        return F.aggregate(F.array(F.struct(state.alias("s"), factor.alias("f"), miss.alias("miss"))), _state(F.array().cast("array<double>"), F.lit(0.0), F.lit(0)),
                           lambda _, x: _state(F.zip_with(x["s"]["w"], F.col(f"{d}_at"), lambda w, at: w * F.element_at(x["f"], at)), F.greatest(x["s"]["error"], x["miss"]), x["s"]["rounds"]))

    def turn(state: Column) -> Column:
        return reduce(rake, DIMENSIONS, _state(state["w"], F.lit(0.0), state["rounds"] + 1))

    start = _state(F.transform(F.col("cells")["tokens"], lambda t: t), F.lit(float("inf")), F.lit(0))
    raked = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda state, _: F.when(state["error"] < tolerance, state).otherwise(turn(state)))
    total = F.aggregate(F.col("cells")["tokens"], F.lit(0.0), lambda a, x: a + x)
    out = one.where(F.size("cells") > 0).select("cells", total.alias("total"), raked.alias("raked"))
    out = out.select(F.explode(F.arrays_zip("cells", F.col("raked.w").alias("w"))).alias("c"), "total", "raked.rounds", F.col("raked.error").alias("margin_error"))
    return out.select("c.cells.*", (F.col("c.w") * F.col("total")).alias("weight"), "rounds", "margin_error")


def _state(w: Column, error: Column, rounds: Column) -> Column:
    return F.struct(w.alias("w"), error.alias("error"), rounds.alias("rounds"))


def mix_sources(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, rounds: int = ROUNDS, tolerance: float = TOLERANCE, tokens: Column | None = None, topics: Column | None = None) -> DataFrame:
    """All columns of ``docs`` with ``n_tokens``, ``topic``, ``chance`` and ``sampled`` added.

    ``tokens`` and ``topics`` say where counts and topics come from, such as
    columns that a tokenizer or ``keyword_topic`` has filled; a null count is
    0, and without them words are counted and the length class is the topic.

    A null source or lang, or one without a target, counts as ``other``. Texts
    without words, null ones too, carry no tokens and have the chance of their
    cell, or 0 if the cell has no tokens at all. A null id is never sampled.
    Repeated rows share their fate. Columns of ``docs`` that clash with the
    added names are replaced. An empty table gives no rows.
    """
    name = lambda d: F.when(F.col(d).isin(*targets[d]), F.col(d)).otherwise(OTHER)
    keys = [f"_{d}_cell" for d in DIMENSIONS]
    given = F.coalesce(tokens.cast("long"), F.lit(0)) if tokens is not None else n_words(F.col("text").cast("string"))
    rows = docs.withColumns({"n_tokens": given, **({"topic": topics} if topics is not None else {})})
    rows = (rows if topics is not None else rows.withColumn("topic", topic(F.col("n_tokens")))).withColumns({k: name(d) for k, d in zip(keys, DIMENSIONS, strict=True)})
    cells = cell_weights(rows.select(*[F.col(k).alias(d) for k, d in zip(keys, DIMENSIONS, strict=True)], "n_tokens"), targets, rounds, tolerance)
    ratio = cells.select(*[F.col(d).alias(k) for k, d in zip(keys, DIMENSIONS, strict=True)], F.try_divide("weight", "tokens").alias("_ratio"))
    # the cells are few: their greatest ratio is a window over all of them
    ratio = ratio.select(*keys, F.round(F.coalesce(F.try_divide(F.col("_ratio"), F.max("_ratio").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)), 9).alias("chance"))
    rows = rows.drop("chance", "sampled").join(F.broadcast(ratio), keys, "left").drop(*keys)
    return rows.withColumn("chance", F.coalesce("chance", F.lit(0.0))).withColumn("sampled", F.coalesce(unit_hash(F.col("doc_id")) < F.col("chance"), F.lit(False)))
