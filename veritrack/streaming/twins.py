"""Streams of presence rows and detections: windows, sessions, joins, de-duplication, stateful holds.

The functions take streaming or batch DataFrames with an event time ``ts``
(TIMESTAMP) and declare a watermark where state must end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veritrack.plans.lineage import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: How late a row may be; state older than that is closed and dropped.
LATE = "2 days"
#: A row of this type ends a replay: it comes long after the others and closes what they opened.
END, END_DAYS = "_end", 60
#: Rows of a part of a replay that make a file.
FILE_ROWS = 500_000


def staged(spark: SparkSession, sf_dir: str, parts: int = 6, file_rows: int = FILE_ROWS) -> str:
    """The events table as files in the order of time, in the shared folder, for a replay: ``parts`` of equal span and an end row.

    Every part has the same number of files, which ends the path's name, so that
    a trigger takes a part whole: the next part would move the watermark past
    rows that were left behind, and each trigger looks at all state once.
    """
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    low, high, n = events.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    files = max(1, -(-n // (parts * file_rows)))
    path = f"{scratch(spark)}-{files}"
    if low is None:
        events.write.parquet(path)
        return path
    step, none, held = (high - low) / parts, spark.createDataFrame([], EVENTS), 0
    for k in range(parts):
        begin, end = F.lit(low + k * step), F.lit(low + (k + 1) * step)
        events.where((F.col("ts") >= begin) & ((F.col("ts") < end) if k < parts - 1 else F.lit(True))).repartition(files).write.mode("append").parquet(path)
        before, held = held, _count_files(spark, path)
        if held - before > files:
            raise ValueError(f"{held - before} files of a part that should have {files}")
        for _ in range(files - held + before):  # few rows leave some files out
            none.write.mode("append").parquet(path)
        held = before + files
    events.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(high + timedelta(days=END_DAYS)).cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit(END).alias("event_type"), F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props")).coalesce(1).write.mode("append").parquet(path)
    return path


def _count_files(spark: SparkSession, path: str) -> int:
    return len(spark.read.schema(EVENTS).parquet(path).inputFiles())


def event_stream(spark: SparkSession, sf_dir: str, path: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """The events as a stream of files in the order of time, by default a part of ``staged`` a trigger; zone-less times are read as UTC."""
    path = path or staged(spark, sf_dir)
    named = re.search(r"-(\d+)/*$", path)
    files = files_per_trigger or (int(named[1]) if named else 1)
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return raw.withColumn("us", us).withColumn("ts", F.timestamp_micros("us"))


def epoch_hour(column: str) -> Column:
    return F.floor(F.unix_micros(column) / 3_600_000_000)


def hourly_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by type in tumbling windows, or in sliding ones."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", LATE).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(epoch_hour("w.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "3 hours") -> DataFrame:
    """Episodes of each vessel: a gap over ``gap`` ends one, an equal gap does not."""
    s = events.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("us").alias("t_start"), F.max("us").alias("t_end"))
    return s.select("user_id", "t_start", "t_end", "n")


def deduplicated(events: DataFrame) -> DataFrame:
    """One row for each vessel and hour, with state bounded by the watermark."""
    hours = events.withColumn("hour", epoch_hour("ts"))
    return hours.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["user_id", "hour"]).where(F.col("event_type") != END).select("user_id", "hour")


def interval_join(sar: DataFrame, ais: DataFrame, hours: int = 1) -> DataFrame:
    """Detections with their vessel's presence rows within ``hours``: a stream-stream join whose state the watermarks bound."""
    s = sar.select(F.col("event_id").alias("sar_id"), F.col("user_id").alias("mmsi"), F.col("ts").alias("s_ts")).withWatermark("s_ts", LATE)
    a = ais.select("event_id", F.col("user_id").alias("a_mmsi"), F.col("ts").alias("a_ts")).withWatermark("a_ts", LATE)
    near = (F.col("a_ts") >= F.col("s_ts") - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("a_ts") <= F.col("s_ts") + F.expr(f"INTERVAL {hours} HOURS"))
    return s.join(a, (F.col("mmsi") == F.col("a_mmsi")) & near).select("sar_id", "event_id")


def pull_state(events: DataFrame, ttl_days: float = 30.0, shards: int = 512) -> DataFrame:
    """The cache rule with state by vessel: a row for each event, FRESH_PULL if none was within the TTL before it.

    Vessels share ``shards`` groups, as a call for each vessel costs more than
    its rows. A vessel's state is dropped once the watermark is past its TTL, by
    the next call of its group or by the group's timer: a later event finds none
    and is a fresh pull, as it would be with the old state.
    """
    ttl_us = ttl_days * 8.64e10

    def decide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        user, event, us = (rows[c].to_numpy() for c in ("user_id", "event_id", "us"))
        order = np.lexsort((event, us, user))
        last = dict(zip(*state.get, strict=True)) if state.exists else {}
        fresh = np.zeros(len(order), bool)
        for k, (u, t) in enumerate(zip(user[order].tolist(), us[order].tolist(), strict=True)):
            if u not in last or t - last[u] > ttl_us:
                last[u], fresh[k] = t, True
        now = state.getCurrentWatermarkMs()
        last = {u: t for u, t in last.items() if t + ttl_us >= now * 1000}
        if last:
            state.update((list(last), list(last.values())))
            state.setTimeoutTimestamp(max(int(max(last.values()) + ttl_us) // 1000, now) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event_id": event[order], "decision": np.where(fresh, "FRESH_PULL", "CACHE_SKIP")})

    # the end row of a replay moves the watermark, so it is left out only afterwards
    rows = events.withWatermark("ts", LATE).select(F.pmod(F.xxhash64("user_id"), F.lit(shards)).alias("shard"), "user_id", "event_id", "us", "ts")
    return rows.groupBy("shard").applyInPandasWithState(decide, "event_id long, decision string", "users array<long>, lasts array<long>", "append", GroupStateTimeout.EventTimeTimeout).where("event_id >= 0")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it wrote, as a table in the shared folder."""
    spark = stream.sparkSession
    out, state = scratch(spark), scratch(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
