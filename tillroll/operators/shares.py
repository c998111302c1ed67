"""Share of a grand total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.columns import ratio


def total_of(df: DataFrame, value: str | Column) -> Column:
    """The sum of ``value`` over ``df`` as a scalar subquery."""
    return df.agg(F.sum(value)).scalar()


def with_share(groups: DataFrame, value: str, total: Column, name: str, digits: int) -> DataFrame:
    """Add ``name``: ``value`` as a percentage of ``total``.

    A scalar total replaces a window over all groups, which would bring them into one task. Take it
    from the rows below the groups where that needs no shuffle; where it must follow a join, take it
    from the groups themselves, and Spark reuses their shuffle.
    """
    return groups.withColumn(name, ratio(F.col(value), total, digits, scale=100))
