"""Referential integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def orphan_rows(child: DataFrame, parent: DataFrame, key: str, null_is_orphan: bool = False) -> DataFrame:
    """One row, ``orphans``: child rows with a ``key`` that no parent row has.

    NULL keys are exempt (a guest has no customer) unless ``null_is_orphan``. The child is counted per
    key before the anti join, so hot keys shrink to one row first.
    """
    rows = child if null_is_orphan else child.filter(F.col(key).isNotNull())
    keys = rows.groupBy(key).agg(F.count("*").alias("_rows"))
    return keys.join(parent.select(key), key, "left_anti").agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphans")
    )
