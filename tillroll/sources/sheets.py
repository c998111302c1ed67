"""Source sheets and their landing as the raw table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from tillroll.functions.columns import clean_customer_id, line_hash
from tillroll.schemas import SHEET_COLUMNS, ContractError, conform, sheet_problems
from tillroll.sources.scratch import hold

ROW_COLUMN = "SourceRow"
FILE_COLUMN = "SourceFile"

# The first data row of a sheet is row 2: rows count from 1 and the header takes one.
FIRST_DATA_ROW = 2


@dataclass(frozen=True)
class Sheet:
    """One source sheet: its name and a frame with the sheet's headings, a row and a file column."""

    name: str
    frame: DataFrame


def _require_sheet(schema: StructType, path: str) -> None:
    problems = sheet_problems(schema)
    if problems:
        raise ContractError(f"{path}: " + "; ".join(problems))


def read_parquet_sheet(spark: SparkSession, path: str, name: str) -> Sheet:
    """A sheet stored as Parquet. Parquet scans know each row's index within its file.

    The schemas of all files are merged and checked: an added, missing or re-typed column fails.
    """
    frame = spark.read.parquet(path, mergeSchema=True)
    _require_sheet(frame.schema, path)
    return Sheet(
        name,
        frame.select(
            *[F.col(c) for c in SHEET_COLUMNS],
            (F.col("_metadata.row_index") + FIRST_DATA_ROW).alias(ROW_COLUMN),
            F.col("_metadata.file_name").alias(FILE_COLUMN),
        ),
    )


_FIELDS = "fields"
_CSV_OPTIONS = {"mode": "FAILFAST", "escape": '"'}


def read_csv_sheet(spark: SparkSession, path: str, name: str, multiline: bool = False) -> Sheet:
    """A sheet stored as CSV with a header line; every field is read as text and typed on landing.

    A record with too many or too few fields, an open quote or other headings fails the load. An empty field
    is NULL, quoted or not. Blank lines hold no row but are counted, so that a row's number is its line.
    With ``multiline`` fields may hold line breaks; then rows are counted instead, and blank lines are not.

    Writes when called: a text scan does not know line numbers, so lines are written once with the file
    block they came from and their order inside it; a running total over blocks (not lines) gives each
    block its first number. No file is read by one task.
    """
    text_schema = ", ".join(f"`{c}` STRING" for c in SHEET_COLUMNS)
    numbered = _records(spark, path, text_schema) if multiline else _lines(spark, path, text_schema)
    heading = F.array(*[F.col(_FIELDS)[c] for c in SHEET_COLUMNS])
    wrong = F.coalesce(heading != F.array(*[F.lit(c) for c in SHEET_COLUMNS]), F.lit(True))
    other = numbered.filter((F.col(ROW_COLUMN) == 1) & wrong).select(FILE_COLUMN, heading.alias("found")).first()
    if other:
        raise ContractError(f"{other[FILE_COLUMN]}: the headings are {other['found']}")
    rows = numbered.filter((F.col(ROW_COLUMN) >= FIRST_DATA_ROW) & F.col(_FIELDS).isNotNull())
    return Sheet(name, rows.select(f"{_FIELDS}.*", ROW_COLUMN, FILE_COLUMN))


_BLOCK = ["_path", "_block"]


def _place() -> list[Column]:
    """Where in which file a scanned line stands."""
    return [
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias(FILE_COLUMN),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_order"),
    ]


def _before(total: str) -> Column:
    """Sum of ``total`` over the blocks of a file that come earlier; one row per block."""
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(earlier), F.lit(0))


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"')))


def _lines(spark: SparkSession, path: str, text_schema: str) -> DataFrame:
    """Fields and line number of every line; a record is a line."""
    line = F.col("value")
    refused = F.raise_error(F.concat(F.lit("open quote in line: "), line)).cast(f"struct<{_struct(text_schema)}>")
    fields = (
        F.when(F.trim(line) == "", None)
        .when(_quotes(line) % 2 == 1, refused)
        .otherwise(F.from_csv(line, text_schema, _CSV_OPTIONS))
    )
    lines = hold(spark.read.text(path).select(fields.alias(_FIELDS), *_place()), "csv-sheet")
    blocks = (
        lines.groupBy(*_BLOCK)
        .agg(F.count("*").alias("_n"), F.min("_order").alias("_first"))
        .withColumn("_start", _before("_n"))
        .drop("_n")
    )
    return lines.join(F.broadcast(blocks), _BLOCK).withColumn(ROW_COLUMN, F.col("_start") + F.col("_order") - F.col("_first") + 1)


def _records(spark: SparkSession, path: str, text_schema: str) -> DataFrame:
    """Fields and number of every record, where quoted fields may hold line breaks.

    A line goes on with the record before it if an odd number of quotes came earlier in the file. That is
    known from the parity of each block, summed over the blocks before it, and of the lines before it in
    its block; the same way records are numbered. Blocks are worked on side by side, and only the lines of
    records that span several are brought together.
    """
    line = F.col("value")
    lines = hold(
        spark.read.text(path, lineSep="\n").select("value", (_quotes(line) % 2).alias("_odd"), *_place()), "csv-lines"
    )
    parity = lines.groupBy(*_BLOCK).agg((F.sum("_odd") % 2).alias("_parity"))
    never = parity.groupBy("_path").agg(F.sum("_parity").alias("_all")).filter("_all % 2 = 1").first()
    if never:
        raise ContractError(f"{never['_path']}: an open quote at its end")
    in_block = Window.partitionBy(*_BLOCK).orderBy("_order")
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    odd_before = F.col("_start") + F.coalesce(F.sum("_odd").over(earlier), F.lit(0))
    placed = (
        lines.join(F.broadcast(parity.select(*_BLOCK, _before("_parity").alias("_start"))), _BLOCK)
        .withColumn("_inside", odd_before % 2 == 1)
        .withColumn("_begins", ~F.col("_inside") & (F.trim(F.rtrim(line, F.lit("\r"))) != ""))
        .withColumn("_nth", F.sum(F.col("_begins").cast("bigint")).over(in_block))
        .drop("_start")
    )
    placed = hold(placed, "csv-records")
    starts = placed.groupBy(*_BLOCK).agg(F.max("_nth").alias("_n")).select(*_BLOCK, _before("_n").alias("_start"))
    # A line that goes on counts as the record that began last.
    numbered = placed.join(F.broadcast(starts), _BLOCK).withColumn(ROW_COLUMN, F.col("_start") + F.col("_nth"))
    alone = F.col("_begins") & (F.col("_odd") == 0)
    whole = numbered.filter(alone).select("value", FILE_COLUMN, ROW_COLUMN)
    parts = numbered.filter(F.col("_inside") | (F.col("_begins") & ~alone))
    order = F.struct("_block", "_order", "value")
    spanning = (
        parts.groupBy("_path", FILE_COLUMN, ROW_COLUMN)
        .agg(F.array_sort(F.collect_list(order)).alias("_parts"))
        .select(F.array_join(F.col("_parts.value"), "\n").alias("value"), FILE_COLUMN, ROW_COLUMN)
    )
    fields = F.from_csv(F.rtrim(line, F.lit("\r")), text_schema, {**_CSV_OPTIONS, "multiLine": "true"})
    return whole.unionAll(spanning).select(fields.alias(_FIELDS), FILE_COLUMN, ROW_COLUMN)


def _struct(columns: str) -> str:
    """Column definitions as the fields of a struct type."""
    return columns.replace("` STRING", "`: STRING")


def _typed(sheet: Sheet, loaded_at: Column) -> DataFrame:
    """Landing names and types. Only a bad timestamp is forgiven (NULL); other bad values fail."""
    renamed = sheet.frame.withColumnsRenamed(SHEET_COLUMNS)
    return renamed.select(
        F.col("invoice").cast("string"),
        F.col("stock_code").cast("string"),
        F.col("description").cast("string"),
        F.col("quantity").cast("bigint"),
        F.col("invoice_date").try_cast("timestamp_ntz").alias("invoice_date"),
        F.col("price").cast("double"),
        clean_customer_id(F.col("customer_id")).alias("customer_id"),
        F.col("country").cast("string"),
        F.col(FILE_COLUMN).alias("_source_file"),
        F.lit(sheet.name).alias("_source_sheet"),
        F.col(ROW_COLUMN).cast("bigint").alias("_source_row"),
        loaded_at.alias("_loaded_at"),
    )


def land(sheets: list[Sheet], loaded_at: datetime) -> DataFrame:
    """All sheets as one raw frame: typed, stamped with lineage and hashed, nothing dropped.

    ``loaded_at`` is one instant for the whole run.
    """
    union = reduce(DataFrame.unionByName, [_typed(sheet, F.lit(loaded_at)) for sheet in sheets])
    return conform(union.withColumn("_record_hash", line_hash()), "raw")
