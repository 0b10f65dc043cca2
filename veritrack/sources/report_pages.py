"""Stored payload pages as a Spark data source: a task follows the pages of one folder.

A folder has a page for each offset, ``offset=<n>/`` with a JSON document whose
``nextOffset`` names the next page or is null. Folders lie below the path by the
columns that a request is made for, ``dataset=<d>/day=<d>/tile=<t>`` or
``mmsi=<m>``; each is a partition. Parsing is left to Spark's JSON functions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "folder string, page_offset long, json string"
#: Characters of pages from which on they are handed over; Spark itself would hold 10,000 pages of any size.
BATCH_CHARS = 4_000_000


class Folder(InputPartition):
    """A chain of pages."""

    def __init__(self, path: str, name: str) -> None:
        super().__init__(name)
        self.path, self.name = path, name


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def _children(system, path: str) -> list[str]:
    from pyarrow import fs

    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(path)) if f.base_name[0] not in "._")


class PageReader(DataSourceReader):
    """Lists the folders on the driver; pages are opened by the tasks alone."""

    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("report_pages needs a path")
        self.path, self.levels = options["path"].rstrip("/"), int(options.get("levels", "3"))

    def partitions(self) -> list[InputPartition]:
        system, root = _open(self.path)
        names = [""]
        for _ in range(self.levels):
            names = [f"{n}/{c}".lstrip("/") for n in names for c in _children(system, f"{root}/{n}".rstrip("/"))]
        return [Folder(self.path, n) for n in names]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks for one partition where there is no folder
            return
        system, root = _open(partition.path)
        offset, seen, held, chars = 0, set(), [], 0
        while offset is not None:
            if offset in seen:
                raise ValueError(f"the pages of {partition.name} go in a circle at offset {offset}")
            seen.add(offset)
            folder = f"{root}/{partition.name}/offset={offset}"
            text = "".join(system.open_input_stream(f"{folder}/{c}").readall().decode() for c in _children(system, folder))
            held.append((offset, text.strip()))
            chars += len(text)
            offset = json.loads(text).get("nextOffset")
            if offset is None or chars >= BATCH_CHARS:
                offsets, texts = zip(*held, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * len(held), pa.string()), pa.array(offsets, pa.int64()), pa.array(texts, pa.string())], ["folder", "page_offset", "json"])
                held, chars = [], 0


class ReportPages(DataSource):
    """``spark.read.format("report_pages").option("levels", 3).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "report_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def read_pages(spark: SparkSession, path: str, levels: int) -> DataFrame:
    """``folder, page_offset, json`` of all pages below ``path``, each chain in its order; a missing page fails the task."""
    spark.dataSource.register(ReportPages)
    return spark.read.format("report_pages").option("levels", levels).load(path)


def folder_value(name: str):
    """The value of a level of ``folder``."""
    return F.regexp_extract("folder", rf"(?:^|/){name}=([^/]*)", 1)


def write_pages(rows: DataFrame, keys: tuple[str, ...], order: str, entries, path: str, page: int = 100) -> None:
    """Stores ``rows`` as payload pages of ``page`` rows for each value of ``keys``.

    ``entries`` makes a page's entries from the array of its rows' ``row``
    columns; the last page of a chain has no ``nextOffset``.
    """
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("_n", F.row_number().over(w.orderBy(order)) - 1).withColumn("_all", F.count("*").over(w)).withColumn("offset", (F.floor(F.col("_n") / page) * page).cast("long"))
    pages = placed.groupBy(*keys, "offset").agg(F.first("_all").alias("_all"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "row"))), lambda x: x["row"]).alias("_rows"))
    following = F.when(F.col("offset") + page < F.col("_all"), F.col("offset") + page)
    pages.select(*keys, "offset", F.to_json(F.struct(entries(F.col("_rows")).alias("entries"), following.alias("nextOffset"), F.col("_all").alias("total"))).alias("value")).write.partitionBy(*keys, "offset").text(path)
