"""What the operators share: input tables, rows kept whole, word counts, running totals."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tillroll.sources.scratch import hold

# A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

ROW = "_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_sent: set[str] = set()


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query`` after sending this package to the workers, once per application, where tasks import it."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        if spark.sparkContext.applicationId not in _sent:
            root = Path(__file__).resolve().parents[2]
            archive = Path(tempfile.mkdtemp()) / "tillroll"
            spark.sparkContext.addPyFile(shutil.make_archive(str(archive), "zip", root, "tillroll"))
            _sent.add(spark.sparkContext.applicationId)
        return query(spark, *args)

    return run


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """The whole input row as one value, so that no helper column can clash with a column of it."""
    return F.struct(*[column(c) for c in df.columns]).alias(ROW)


def unpacked(names: list[str], added: dict[str, Column]) -> list[Column]:
    """The columns of a packed row followed by ``added``; an input column of an added name gives way."""
    taken = {name.lower() for name in added}
    kept = [F.col(ROW).getField(n).alias(n) for n in names if n.lower() not in taken]
    return [*kept, *[value.alias(name) for name, value in added.items()]]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(divisor))


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column], name: str) -> DataFrame:
    """``df`` with, for each of ``totals``, the sum over all rows that come before in ``order``.

    Rows are range-partitioned and written with the partition they fell into. One row per partition
    goes through the global window; rows only meet those of their own partition.
    """
    spread = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = hold(spread, name)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in totals.items()])
    starts = parts.select(
        "_part", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_from_{n}") for n in totals]
    )
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.join(starts, "_part")
    added = {n: F.col(f"_from_{n}") + F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in totals.items()}
    return summed.select(*[column(c) for c in df.columns], *[c.alias(n) for n, c in added.items()])
