"""Projects the order star tables into two overlapping retail sheets.

The pipeline's own input is a pair of spreadsheet sheets. This adapter derives the same layout, and
the same kinds of dirt, from whole order tables: guests, cancellations, returns, zero prices,
service codes, blank texts, float-like ids, and one month that both sheets contain.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillroll.schemas import SHEET_COLUMNS
from tillroll.sources.scratch import new_path
from tillroll.sources.sheets import FILE_COLUMN, ROW_COLUMN, Sheet, read_csv_sheet, read_parquet_sheet

# Sheet B starts one month before sheet A ends (fixed values).
SHEET_A_END = "1998-07-01"
SHEET_B_START = "1998-06-01"


def _stock_code(part: Column, service_only: Column) -> Column:
    digits = F.lpad(part.cast("string"), F.greatest(F.lit(5), F.length(part.cast("string"))), F.lit("0"))
    return (
        F.when((part % 100 == 0) | service_only, "POST")
        .when(part % 100 == 33, "DOT")
        .when(part % 100 == 66, "M")
        .otherwise(F.concat(digits, F.when(part % 3 == 0, "A").otherwise("")))
    )


TABLES = ("lineitem", "orders", "customer", "nation", "part")


def tables_state(spark: SparkSession, sf_dir: str) -> tuple[int, ...]:
    """When each star table was last changed."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet") for name in TABLES]
    conf = spark._jsc.hadoopConfiguration()
    return tuple(p.getFileSystem(conf).getFileStatus(p).getModificationTime() for p in paths)


def star_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line under the source sheet's headings. Spark picks the join strategies."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    # Small tables first: lines are shuffled for their order and their part only.
    buyers = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    lines = (
        table("lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    order, buyer, part = F.col("o_orderkey"), F.col("o_custkey"), F.col("l_partkey")
    number, units = F.col("l_linenumber"), F.col("l_quantity")

    cancelled = (order % 50 == 0) | (buyer % 75 == 6)
    returned = cancelled | ((order * 7 + number) % 300 == 0)
    cents = F.floor(F.col("l_extendedprice") / units * 100)
    return lines.select(
        F.concat(F.when(cancelled, "C").otherwise(""), order.cast("string")).alias("Invoice"),
        _stock_code(part, service_only=buyer % 75 == 5).alias("StockCode"),
        F.when(order % 250 == 0, F.lit(None).cast("string"))
        .when(order % 251 == 0, "  ")
        .when(number == 7, F.upper("p_name"))
        .otherwise(F.col("p_name"))
        .alias("Description"),
        F.when(returned, -units).otherwise(units).cast("bigint").alias("Quantity"),
        F.col("o_orderdate").alias("InvoiceDate"),
        F.when((order + part) % 170 == 0, 0.0).otherwise(cents / 100.0).alias("Price"),
        F.when(order % 4 == 3, F.lit(None).cast("string"))
        .otherwise(F.concat(F.when(buyer % 75 == 7, "X").otherwise(""), buyer.cast("string"), F.lit(".0")))
        .alias("Customer ID"),
        F.when(order % 500 == 1, "").otherwise(F.col("n_name")).alias("Country"),
        (order * 10 + number).alias(ROW_COLUMN),
        F.lit("lineitem.parquet").alias(FILE_COLUMN),
    )


def star_sheets(spark: SparkSession, sf_dir: str) -> list[Sheet]:
    """The lines split into sheets ``A`` and ``B``; B re-words the descriptions of the shared month."""
    lines = star_lines(spark, sf_dir)
    day = F.col("InvoiceDate")
    shared = day < F.lit(SHEET_A_END).cast("timestamp_ntz")
    reworded = F.when(shared, F.concat("Description", F.lit(" (2)"))).otherwise(F.col("Description"))
    return [
        Sheet("A", lines.filter(shared)),
        Sheet(
            "B",
            lines.filter(day >= F.lit(SHEET_B_START).cast("timestamp_ntz")).withColumn("Description", reworded),
        ),
    ]


# Every so many source rows have a timestamp that is none (fixed value).
BAD_TIMESTAMP_EVERY = 997
# In multiline sheets, every so many source rows have a line break in their description (fixed value).
LINE_BREAK_EVERY = 5


def write_sheet(spark: SparkSession, sheet: Sheet, kind: str) -> tuple[str, str]:
    """A sheet as a folder of ``csv``, ``multiline`` or ``parquet`` files in shared storage; returns its name and
    address.

    Some timestamps are text that is none. ``multiline`` is CSV with line breaks in some descriptions.
    """
    path = new_path(spark, f"sheet-{sheet.name}")
    bad = F.col(ROW_COLUMN) % BAD_TIMESTAMP_EVERY == 0
    when = F.when(bad, "not a date").otherwise(F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss"))
    frame = sheet.frame.withColumn("InvoiceDate", when)
    if kind == "multiline":
        broken = F.col(ROW_COLUMN) % LINE_BREAK_EVERY == 0
        text = F.when(broken, F.replace("Description", F.lit(" "), F.lit("\n"))).otherwise(F.col("Description"))
        frame = frame.withColumn("Description", text)
    writer = frame.select(*SHEET_COLUMNS).write
    if kind != "parquet":
        # Leading and trailing blanks are part of a field.
        writer.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        writer.parquet(path)
    return sheet.name, path


def sheets_from_files(spark: SparkSession, sf_dir: str, kind: str) -> list[Sheet]:
    """The star sheets, written and read again. Row numbers are those of the written files."""
    read = {
        "csv": read_csv_sheet,
        "multiline": partial(read_csv_sheet, multiline=True),
        "parquet": read_parquet_sheet,
    }[kind]
    written = [write_sheet(spark, sheet, kind) for sheet in star_sheets(spark, sf_dir)]
    return [read(spark, path, name) for name, path in written]
