"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Digests and numbers make up most of a held table, which this codec packs in about half of the default's room.
_PACKED = {"compression": "zstd"}

# Spark's own switch for deleting a query's shuffle files when the query ends.
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_roots: dict[str, str] = {}
# Catalog entries of bucketed tables by the name of their folder.
_bucketed: dict[str, str] = {}
# Where hold() notes what it wrote, inside of intermediates().
_notes: ContextVar[list[str] | None] = ContextVar("held", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.conf.get("spark.app.id")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tillroll-")
    return _local_roots[app]


def new_path(spark: SparkSession, name: str) -> str:
    """An unused address in the shared folder, below the application id."""
    return f"{scratch_root(spark)}/{spark.conf.get('spark.app.id')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of a query that starts inside the block as soon as it ends.

    Else they stay until the driver's garbage collector finds the query gone, beside the table it wrote.
    """
    before = spark.conf.get(_REMOVE_SHUFFLES, "false")
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVE_SHUFFLES, before)


def hold(df: DataFrame, name: str, folders: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of it; with ``folders``, a folder for each value of that column.

    Cuts the lineage like a checkpoint, but keeps the data columnar: later reads prune columns, folders and
    row groups. Each call uses a new folder, so nothing is ever overwritten under a reader. What was shuffled
    for it is deleted.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(folders) if folders else df.write
    with shuffles_removed(spark):
        writer.parquet(path, **_PACKED)
    notes = _notes.get()
    if notes is not None:
        notes.append(path)
    return spark.read.schema(df.schema).parquet(path)


def hold_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """:func:`hold` with the rows dealt into ``buckets`` by ``key`` and sorted by it within.

    Spark remembers the buckets in the session's catalog, so grouping by ``key``, or joining two such tables
    of equally many buckets on it, happens where the rows lie. :func:`release` removes the entry too.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    folder = path.rsplit("/", 1)[-1]
    entry = f"`{spark.catalog.currentDatabase()}`.`{folder.replace('-', '_')}`"
    writer = df.write.format("parquet").bucketBy(buckets, key).sortBy(key).options(**_PACKED).option("path", path)
    with shuffles_removed(spark):
        writer.saveAsTable(entry)
    _bucketed[folder] = entry
    notes = _notes.get()
    if notes is not None:
        notes.append(path)
    return spark.table(entry)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes what :func:`hold` wrote inside the block at its end; a path taken out of the list stays.

    For a result that is written itself, so that nothing reads the tables that led to it any more.
    """
    paths: list[str] = []
    token = _notes.set(paths)
    try:
        yield paths
    finally:
        _notes.reset(token)
        for path in paths:
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, and the catalog entry of a bucketed table."""
    entry = _bucketed.pop(path.rstrip("/").rsplit("/", 1)[-1], None)
    if entry:
        spark.sql(f"DROP TABLE IF EXISTS {entry}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(table: DataFrame) -> None:
    """Delete the folder of a table that :func:`hold` returned; it must not be read any more."""
    spark = table.sparkSession
    root = f"{scratch_root(spark)}/{spark.conf.get('spark.app.id')}/"
    below = root.split(":", 1)[-1].strip("/") + "/"
    # Only what is below this application's folder was written by hold(); its first folder there is the table.
    tables = set()
    for file in table.inputFiles():
        before, found, within = file.partition(below)
        if found:
            tables.add(before + found + within.split("/", 1)[0])
    for folder in tables:
        drop(spark, folder)
