"""Stays, replayed streams whose state ends, and stored pages."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrack.operators.dwell import _km, stays
from veritrack.sources.report_pages import Folder, PageReader, folder_value, read_pages, write_pages
from veritrack.streaming import twins

SF = "/root/testdata/sf0.001"


def plain_stays(y, x, radius):
    out, start = [], 0
    for i in range(1, len(y) + 1):
        if i == len(y) or _km(y[start : i + 1], x[start : i + 1], sum(y[start : i + 1]) / (i + 1 - start), sum(x[start : i + 1]) / (i + 1 - start)).max() > radius:
            out.append((start, i))
            start = i
    return out


@pytest.mark.parametrize("spread", [0.0, 0.01, 0.03, 0.2])
def test_stays_equal_the_definition(spread):
    rng = np.random.default_rng(7)
    y, x = 26 + np.cumsum(rng.standard_normal(400)) * spread, 56 + np.cumsum(rng.standard_normal(400)) * spread
    got = stays(np.arange(400), y, x, 5.0)
    assert [g[:2] for g in got] == plain_stays(y, x, 5.0)
    assert all(abs(cy - y[a:b].mean()) < 1e-9 for a, b, cy, _ in got)
    assert stays(np.arange(0), y[:0], x[:0], 5.0) == []


def test_a_moored_vessel_is_linear():
    import time

    rng = np.random.default_rng(1)
    n = 200_000
    y, x = 26 + rng.integers(-2, 3, n) * 0.005, 56 + rng.integers(-2, 3, n) * 0.005
    began = time.process_time()
    assert [g[:2] for g in stays(np.arange(n), y, x, 5.0)] == [(0, n)]
    assert time.process_time() - began < 20


def states(stream, tmp_path, name):
    """Rows of state that are left when a replay ends, and the most there were."""
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    return rows[-1], max(rows)


def test_state_ends(spark, tmp_path):
    path = twins.staged(spark, SF)
    stream = lambda: twins.event_stream(spark, SF, path)
    left, most = states(twins.hourly_counts(stream()), tmp_path, "hours")
    assert left <= 1 and most < 800  # the end row's window, and a fraction of all windows
    left, _ = states(twins.sessions(stream()), tmp_path, "sessions")
    assert left <= 1
    left, most = states(twins.pull_state(stream(), ttl_days=3.0), tmp_path, "pulls")
    assert left <= 1 and most > 5


def test_late_rows_of_a_replay_are_whole(spark):
    got = twins.drain(twins.hourly_counts(twins.event_stream(spark, SF))).agg(F.sum("n")).first()[0]
    assert got == spark.read.parquet(f"{SF}/events.parquet").count()


def test_a_trigger_takes_a_part_of_a_replay_whole(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    path = twins.staged(spark, str(tmp_path), file_rows=60)
    stream = twins.event_stream(spark, str(tmp_path), path)
    q = twins.pull_state(stream, 3.0).writeStream.outputMode("append").format("memory").queryName("parts").option("checkpointLocation", str(tmp_path / "parts")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == 7  # six parts and the end row
    got, last = {}, {}
    for u, e, us in sorted(events.selectExpr("user_id", "event_id", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS us").collect(), key=lambda r: (r.us, r.event_id)):
        fresh = u not in last or us - last[u] > 3 * 86_400_000_000
        got[e] = "FRESH_PULL" if fresh else "CACHE_SKIP"
        if fresh:
            last[u] = us
    assert {tuple(r) for r in spark.table("parts").collect()} == set(got.items())


def test_few_rows_still_fill_the_files_of_a_part(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(9).write.parquet(str(tmp_path / "events.parquet"))
    path = twins.staged(spark, str(tmp_path), parts=3, file_rows=1)
    assert len(spark.read.schema(twins.EVENTS).parquet(path).inputFiles()) == 3 * 3 + 1
    assert twins.drain(twins.pull_state(twins.event_stream(spark, str(tmp_path), path))).count() == 9


def test_pages_are_followed_by_a_task_a_folder(spark, tmp_path):
    rows = spark.range(25).select((F.col("id") % 3).alias("day"), F.lit("a=b/c").alias("tile"), "id", F.struct("id").alias("row"))
    path = str(tmp_path / "pages")
    write_pages(rows, ("day", "tile"), "id", lambda r: r, path, 4)
    got = read_pages(spark, path, 2)
    assert got.rdd.getNumPartitions() == 3
    pages = got.select(folder_value("day").alias("day"), "page_offset", F.from_json("json", "entries array<struct<id: long>>, nextOffset long, total long").alias("j")).collect()
    assert sorted((p.day, p.page_offset) for p in pages) == [("0", 0), ("0", 4), ("0", 8), ("1", 0), ("1", 4), ("2", 0), ("2", 4)]
    assert sorted(e.id for p in pages for e in p.j.entries) == list(range(25))
    assert {(p.day, p.page_offset): p.j.nextOffset for p in pages}["0", 8] is None


def test_pages_are_handed_over_by_size(tmp_path, monkeypatch):
    monkeypatch.setattr("veritrack.sources.report_pages.BATCH_CHARS", 250)
    for offset in range(7):
        folder = tmp_path / "day=1" / f"offset={offset}"
        folder.mkdir(parents=True)
        (folder / "page.json").write_text(json.dumps({"entries": "x" * 70, "nextOffset": offset + 1 if offset < 6 else None}))
    got = list(PageReader({"path": str(tmp_path), "levels": "1"}).read(Folder(str(tmp_path), "day=1")))
    assert [b.num_rows for b in got] == [3, 3, 1]
    assert [o for b in got for o in b.column("page_offset").to_pylist()] == list(range(7))


def test_broken_chains_fail(spark, tmp_path):
    for name, pages in (("circle", {0: 4, 4: 0}), ("missing", {0: 4})):
        for offset, following in pages.items():
            folder = tmp_path / name / "day=1" / f"offset={offset}"
            folder.mkdir(parents=True)
            (folder / "page.json").write_text(json.dumps({"entries": [], "nextOffset": following}))
        with pytest.raises(Exception, match="circle|does not exist|No such file|Cannot list|not found|FileNotFound"):
            read_pages(spark, str(tmp_path / name), 1).collect()
    (tmp_path / "empty").mkdir()
    assert read_pages(spark, str(tmp_path / "empty"), 1).count() == 0
