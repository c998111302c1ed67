"""Writing tables and metric documents; every write replaces what was there, all or nothing.

A table is a folder of versions and a pointer. A write makes a new version beside the old one, checks it
and moves the pointer, which is one rename; a reader that began before keeps the files it began with, and
a write that fails leaves the table as it was.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F
from pyspark.sql.types import StructType

from tillroll.schemas import CLUSTER_BY, CONTRACTS, PARTITION_DAY, RAW_DAY, ContractError, conform, contract_problems
from tillroll.sources.observed import Figures, counted
from tillroll.sources.scratch import drop

VERSIONS, POINTER = "_versions", "_current"
# The current version and the one before it, which readers may still be in, are kept.
VERSIONS_KEPT = 2


def write_parquet(df: DataFrame, path: str) -> None:
    """The plain columnar artifact."""
    df.write.mode("overwrite").parquet(path)


def _laid_out(df: DataFrame, name: str) -> DataFrame:
    """Contract-typed rows arranged for writing: days together, clustered by the table's keys.

    ``rebalance`` lets adaptive execution split a day that is too big for one task and join days
    that are small, so a hot day becomes several files instead of one huge task. Needs adaptive
    execution (Spark's default).
    """
    typed = conform(df, name)
    if name == "raw":
        typed = typed.withColumn(RAW_DAY, F.col("invoice_date").cast("date"))
    day = [PARTITION_DAY[name]] if name in PARTITION_DAY else []
    order = day + CLUSTER_BY.get(name, [])
    spread = typed.hint("rebalance", *day)
    return spread.sortWithinPartitions(*order) if order else spread


def _writer(arranged: DataFrame, name: str) -> DataFrameWriter:
    writer = arranged.write.format("parquet")
    return writer.partitionBy(PARTITION_DAY[name]) if name in PARTITION_DAY else writer


def _stored_schema(name: str) -> StructType:
    schema = StructType(list(CONTRACTS[name].fields))
    return schema.add(RAW_DAY, "date") if name == "raw" else schema


def write_table_files(df: DataFrame, name: str, path: str) -> Figures:
    """A new version of the table at ``path``, contract-typed, dated tables with one folder per day.

    The version becomes current once its files have been read back with as many rows as were written.
    Returns the counts that were taken while writing.
    """
    spark = df.sparkSession
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path}/{VERSIONS}/{version}"

    def write(arranged: DataFrame, label: str) -> DataFrame:
        _writer(arranged, label).save(folder)
        return spark.read.schema(_stored_schema(label)).parquet(folder)

    try:
        written, figures = counted(_laid_out(df, name), name, write)
        _require_complete(written, name, figures)
        _point(spark, path, version)
    except BaseException:
        drop(spark, folder)
        raise
    for old in _versions(spark, path)[:-VERSIONS_KEPT]:
        if old < version:
            drop(spark, f"{path}/{VERSIONS}/{old}")
    return figures


def _require_complete(written: DataFrame, name: str, figures: Figures) -> None:
    """The version on disk has the contract's columns and every row; row counts are in the files' footers."""
    problems = contract_problems(written.select(*CONTRACTS[name].names).schema, CONTRACTS[name])
    rows = written.count()
    if rows != figures.rows:
        problems.append(f"{rows} rows on disk, {figures.rows} written")
    if problems:
        raise ContractError(f"{name}: " + "; ".join(problems))


def current_path(spark: SparkSession, path: str) -> str:
    """The folder of the current version of a table that :func:`write_table_files` wrote."""
    pointer = _hadoop_path(spark, f"{path}/{POINTER}")
    stream = pointer.getFileSystem(spark._jsc.hadoopConfiguration()).open(pointer)
    try:
        return f"{path}/{VERSIONS}/{spark._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def read_table_files(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The table written by :func:`write_table_files` as it is now, in contract column order."""
    return spark.read.schema(_stored_schema(name)).parquet(current_path(spark, path)).select(*CONTRACTS[name].names)


def save_table(df: DataFrame, name: str, database: str) -> Figures:
    """Contract-typed catalog table ``database.name``, replaced as a whole.

    The rows are an external table of their own version; ``database.name`` is a view of it, and replacing
    the view is the one step that readers see.
    """
    spark = df.sparkSession
    path = f"{spark.catalog.getDatabase(database).locationUri}/{name}"
    figures = write_table_files(df, name, path)
    folder = current_path(spark, path)
    version = f"{name}__{folder.rsplit('/', 1)[1].replace('-', '_')}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _stored_schema(name).fields)
    parts = f"PARTITIONED BY ({PARTITION_DAY[name]})" if name in PARTITION_DAY else ""
    spark.sql(f"CREATE TABLE `{database}`.`{version}` ({columns}) USING parquet {parts} LOCATION '{folder}'")
    if parts:
        spark.catalog.recoverPartitions(f"`{database}`.`{version}`")
    names = ", ".join(f"`{c}`" for c in CONTRACTS[name].names)
    tables = {t.name: t.tableType for t in spark.catalog.listTables(database) if not t.isTemporary}
    if tables.get(name, "VIEW") != "VIEW":
        spark.sql(f"DROP TABLE `{database}`.`{name}`")
    spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{name}` AS SELECT {names} FROM `{database}`.`{version}`")
    for old in sorted(t for t in tables if t.startswith(f"{name}__v"))[:-VERSIONS_KEPT]:
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{old}`")
    return figures


def write_metrics(metrics: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per named metric frame; NULL metrics are written as null."""
    for name, df in metrics.items():
        df.write.mode("overwrite").json(f"{path}/{name}", ignoreNullFields=False)


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Make ``version`` the current one: the pointer is written aside and renamed over the old one."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    pointer, aside = _hadoop_path(spark, f"{path}/{POINTER}"), _hadoop_path(spark, f"{path}/{POINTER}.{version}")
    system = pointer.getFileSystem(conf)
    out = system.create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    overwrite[0] = getattr(fs, "Options$Rename").OVERWRITE
    fs.FileContext.getFileContext(system.getUri(), conf).rename(
        aside.makeQualified(system.getUri(), system.getWorkingDirectory()),
        pointer.makeQualified(system.getUri(), system.getWorkingDirectory()),
        overwrite,
    )


def _versions(spark: SparkSession, path: str) -> list[str]:
    folder = _hadoop_path(spark, f"{path}/{VERSIONS}")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(status.getPath().getName() for status in found)

