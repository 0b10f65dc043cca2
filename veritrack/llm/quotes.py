"""Quotation linking: conversations in reply order, without quotes (operator 4).

DataFrame operations only. A line's quote level is the number of ``>`` marks
at its start, with spaces between them allowed. Consecutive lines of a level
form a passage; its text is normalised (marks cut, A-Z lower-cased, runs of
white space made one space) and hashed, together with its single lines. A
message's own passages and lines, at level 0, are what others quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrack.plans.lineage import cut

MARKS = r"^[ \t]*(>[ \t>]*)?"
#: Turns or positions that are ranked or collected together.
PAGE = 1000
_BLANK = r"[ \t\r\f\x0B\n]+"


def quote_level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">")))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _BLANK, " "))


def _bound(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once for each row, however often later expressions and their lambdas name it."""
    return rows.withColumn(name, F.explode(F.array(value)))


def with_passages(rows: DataFrame, quoting: Column) -> DataFrame:
    """Adds ``spans``: the runs of lines of one level in order, as an array of ``(level, body)``.

    Lines of a body keep their line feeds. A text without quoted lines is one
    span. Work is linear in the lines of a text: the lines and the places where
    runs begin are bound before they are looked up.
    """
    level = lambda x: F.struct(quote_level(x).alias("level"), x.alias("line"))
    line = lambda x: F.struct(x["level"].alias("level"), F.when(x["level"] > 0, F.regexp_replace(x["line"], MARKS, "")).otherwise(x["line"]).alias("body"))
    text = F.coalesce("text", F.lit(""))
    rows = _bound(rows, "_levels", F.transform(F.when(quoting, F.split(text, "\n")).otherwise(F.array().cast("array<string>")), level))
    rows = _bound(rows, "_lines", F.transform("_levels", line))
    begins = lambda x, i: F.when((i == 0) | (x["level"] != F.get("_lines", F.greatest(i - 1, F.lit(0)))["level"]), i)
    rows = _bound(rows, "_starts", F.array_compact(F.transform("_lines", begins)))
    end = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_lines"))
    body = lambda i, k: F.array_join(F.transform(F.slice("_lines", i + 1, end(k) - i), lambda x: x["body"]), "\n")
    runs = F.transform("_starts", lambda i, k: F.struct(F.get("_lines", i)["level"].alias("level"), body(i, k).alias("body")))
    plain = F.array(F.struct(F.lit(0).alias("level"), text.alias("body")))
    return _bound(rows, "spans", F.when(quoting, runs).otherwise(plain)).drop("_levels", "_lines", "_starts")


def _hashes(spans: Column) -> Column:
    """Hashes of the non-empty normalised forms of passages and of their lines."""
    whole = F.transform(spans, lambda p: normalised(p["body"]))
    lines = F.flatten(F.transform(spans, lambda p: F.transform(F.split(p["body"], "\n"), normalised)))
    return F.transform(F.array_distinct(F.filter(F.concat(whole, lines), lambda x: x != "")), lambda x: F.sha2(x, 256))


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row for each message: ``conv_id, turn, role, own_text, n_quoted, n_linked, reply_to, depth, root_turn, position``.

    ``own_text`` is the text without quoted lines. Each quoted passage is
    linked to the first message of the conversation with that passage or line
    of its own, if that comes before the quoting message; ``n_quoted`` counts
    distinct quoted passages and ``n_linked`` those with a link. A passage that
    is nowhere as a whole is linked by its lines. ``reply_to`` is the latest
    message that a passage of the lowest quote level present links to, null for
    none, and ``root_turn`` the first message of the reply chain, ``depth`` its
    length. ``position`` counts the messages of the same ``root_turn`` in reply
    order, from 0, repeated keys one after another; ``conversations`` makes
    rows of them.

    A null text has no lines. Rows with a null ``conv_id`` or ``turn`` link
    with nothing and are their own roots. Rows that repeat a key keep a row
    each and share links. Other columns are ignored; an empty table gives none.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    quoting = F.coalesce(F.col("text").rlike(r"(?:^|\n)[ \t]*>"), F.lit(False))
    rows = with_passages(rows, quoting)
    own = F.filter("spans", lambda p: p["level"] == 0)
    rows = rows.withColumn("own_text", F.when(F.col("text").isNotNull(), F.array_join(F.transform(own, lambda p: p["body"]), "\n")))
    quoters = cut(rows.where(quoting & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", "spans"))
    quoted = (quoters.select("conv_id", "turn", F.explode(F.filter("spans", lambda p: p["level"] > 0)).alias("p"))
              .select("conv_id", "turn", F.col("p.level").alias("level"), F.sha2(normalised(F.col("p.body")), 256).alias("passage"), _hashes(F.array("p")).alias("keys"))
              .where(F.size("keys") > 0).distinct())
    wanted = quoted.select("conv_id", F.explode("keys").alias("key")).distinct()
    originals = (rows.join(quoters.select("conv_id").distinct(), "conv_id", "left_semi")
                 .select("conv_id", "turn", F.explode(_hashes(own)).alias("key")).where("turn is not null")
                 .groupBy("conv_id", "key").agg(F.min("turn").alias("origin")))
    found = wanted.join(originals, ["conv_id", "key"])
    links = (quoted.withColumn("key", F.explode("keys")).join(found, ["conv_id", "key"]).where("origin < turn")
             .groupBy("conv_id", "turn", "level", "passage")
             .agg(F.max(F.when(F.col("key") == F.col("passage"), F.col("origin"))).alias("whole"), F.max("origin").alias("by_line"))
             .select("conv_id", "turn", "level", "passage", F.coalesce("whole", "by_line").alias("origin")))
    counts = quoted.groupBy("conv_id", "turn").agg(F.countDistinct("passage").alias("n_quoted"))
    parents = cut(links.groupBy("conv_id", "turn").agg(F.countDistinct("passage").alias("n_linked"), F.min(F.struct("level", (-F.col("origin")).alias("o"))).alias("m"))
                  .select("conv_id", "turn", "n_linked", (-F.col("m.o")).alias("reply_to")))
    chains = _roots(parents)
    linked = (rows.join(counts, ["conv_id", "turn"], "left").join(chains, ["conv_id", "turn"], "left")
            .select("conv_id", "turn", "role", "own_text", F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
                    "reply_to", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("root_turn", "turn").alias("root_turn")))
    return _positioned(linked)


def _positioned(linked: DataFrame) -> DataFrame:
    """Adds ``position``: ranks within a page of turns, after the counts of the pages before, so that no task sorts a long thread."""
    thread, page = ["conv_id", "root_turn"], (F.col("turn") / PAGE).cast("long")
    rows = linked.withColumn("_page", page)
    before = Window.partitionBy(*thread).orderBy("_page").rowsBetween(Window.unboundedPreceding, -1)
    pages = rows.groupBy(*thread, "_page").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    same = lambda c: F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}"))
    rows = rows.alias("r").join(pages.alias("p"), same("conv_id") & same("root_turn") & same("_page")).select("r.*", "p._before")
    within = Window.partitionBy(*thread, "_page").orderBy("turn", "role", F.xxhash64("own_text"))
    return rows.withColumn("position", F.col("_before") + F.row_number().over(within) - 1).drop("_page", "_before")


def conversations(linked: DataFrame) -> DataFrame:
    """Threads of ``link_quotes`` as rows ``conv_id, root_turn, page, messages``: own texts in reply order.

    ``messages`` holds structs of ``position, turn, role, own_text, reply_to``;
    a thread continues on a new page after ``PAGE`` positions, so a row's size
    is bounded. Messages with a null ``conv_id`` make no conversation.
    """
    page = (F.col("position") / PAGE).cast("long").alias("page")
    message = F.struct("position", "turn", "role", "own_text", "reply_to")
    return linked.where("conv_id is not null").groupBy("conv_id", "root_turn", page).agg(F.sort_array(F.collect_list(message)).alias("messages"))


def _roots(parents: DataFrame) -> DataFrame:
    """Adds ``root_turn`` and ``depth`` by following each reply chain with doubling steps."""
    chains = parents.select("*", F.col("reply_to").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = chains.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("up"), F.col("depth").alias("more"))
        step = chains.join(up, ["conv_id", "root_turn"], "left")
        chains, moved = None, cut(step)
        chains = moved.select("conv_id", "turn", "n_linked", "reply_to", F.coalesce("up", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if moved.where("up is not null").isEmpty():
            return chains
