"""Cutting the lineage of iterative jobs in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where the tables are that ``cut`` made.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return that table.

    The folder is the one that the session names in ``spark.checkpoint.dir``,
    below it one for each application; only a session without that setting, as
    in tests, and that runs on this machine alone gets a temporary folder. A
    lost executor loses nothing, and the table brings its true size, where a
    plan that joins its own earlier result again and again would only multiply
    estimates. ``release`` removes a table that later ones supersede; remove
    the application's folder when its results are no longer read.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` made; nothing may read them, or what is derived from them, any more."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session.sessionState().newHadoopConf()).delete(where, True)


def scratch(spark: SparkSession) -> str:
    """A new path in the application's part of the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _local(spark)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


_made: list[str] = []


def _local(spark: SparkSession) -> str:
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="lineage-"))
    return _made[0]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
