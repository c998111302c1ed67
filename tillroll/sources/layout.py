"""How dated tables lie in storage between the steps of a run: a folder per period, clustered within.

A folder per day, as published tables have, pays once a day fills files of its own. Tables that a run holds
for itself are cut by a coarser grain where days are small; either way a date range reads only the folders
it touches, and within a file the clustering keys tell row groups apart.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.schemas import CLUSTER_BY, PARTITION_DAY

# The folder column of held tables; it is no part of any contract.
PERIOD = "_period"
GRAINS = ("day", "month", "year")

# Models whose partitions are ranges by day already; writing by period moves no rows.
RANGED = {"stg"}

# Keys of 32 hexadecimal digits that travel as 16 bytes when a model is moved by period.
DIGESTS = {"fct_orders": "customer_sk"}

# Roll-ups that have no contract, and their day. They are small and mostly read whole, so they have no folders.
ROLL_UP_DAY = {"order_parts": "invoice_date"}


def day_column(name: str) -> str | None:
    return ROLL_UP_DAY.get(name, PARTITION_DAY.get(name))


def in_folders(name: str) -> bool:
    """Whether a held table has folders: those that are dated when published, but for raw, which is read whole."""
    return name in PARTITION_DAY and name != "raw"


def period_of(day: Column, grain: str) -> Column:
    """The first day of the period that ``day`` lies in; NULL stays NULL."""
    if grain not in GRAINS:
        raise ValueError(f"grain {grain!r} is none of {', '.join(GRAINS)}")
    return day if grain == "day" else F.trunc(day, grain)


def with_period(df: DataFrame, name: str, grain: str) -> DataFrame:
    """``df`` arranged for writing by period: ``rebalance`` splits a hot period over tasks and joins small ones."""
    spread = df.withColumn(PERIOD, period_of(F.col(day_column(name)), grain))
    if name not in RANGED:
        keys = [DIGESTS[name]] if name in DIGESTS else []
        packed = spread.withColumns({key: F.unhex(key) for key in keys}).hint("rebalance", PERIOD)
        spread = packed.withColumns({key: F.lower(F.hex(key)) for key in keys})
    return spread.sortWithinPartitions(PERIOD, *CLUSTER_BY.get(name, []))


def between(table: DataFrame, name: str, grain: str, first: date | None, last: date | None) -> DataFrame:
    """Rows of a held table from ``first`` to ``last``, both included; other folders are not opened."""
    day = F.col(day_column(name))
    if first is not None:
        table = table.filter((F.col(PERIOD) >= period_of(F.lit(first), grain)) & (day >= F.lit(first)))
    if last is not None:
        table = table.filter((F.col(PERIOD) <= period_of(F.lit(last), grain)) & (day <= F.lit(last)))
    return table
