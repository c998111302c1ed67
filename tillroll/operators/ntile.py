"""NTILE over a whole table without bringing the table into one task.

``ntile(n)`` over an unpartitioned window sorts everything in a single task. A row's tile depends
only on how it compares with the last row of each tile, so this module finds those ``n - 1`` cut
rows and assigns tiles by comparison:

1. range-partition the narrow positions (key, tie-break) and write them once with their partition
   number, which turns partition numbers into data that a lost executor cannot change;
2. count rows per partition; running totals say which partition holds each cut and at what offset;
3. sort only those partitions to read off the cut rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.schemas import MONEY
from tillroll.sources.scratch import hold


def _position(key: Column, tie: Column) -> Column:
    """Sort position of a row: NULL keys last, ties in ``tie`` order."""
    return F.struct(key.isNull().alias("missing"), key.cast(MONEY).alias("key"), tie.alias("tie"))


def tile_cuts(
    df: DataFrame, keys: dict[str, Column], tie: str, tiles: int, wanted: Sequence[int] | None = None
) -> DataFrame:
    """One row, ``cuts``: per score name, the last position of each of its tiles but the last one.

    ``wanted`` picks some of the tiles. Writes the positions when called. ``keys`` maps a score name to its ascending numeric sort key. All scores share one range
    shuffle: the score name leads the sort order. ``tie`` must be unique within ``df``.
    """
    scores = F.array(
        *[F.struct(F.lit(n).alias("score"), _position(k, F.col(tie)).alias("pos")) for n, k in keys.items()]
    )
    ranged = df.select(F.inline(scores)).repartitionByRange("score", "pos")
    positions = hold(ranged.select(F.spark_partition_id().alias("part"), "score", "pos"), "positions")

    by_score = Window.partitionBy("score")
    before = by_score.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per (score, range partition): the windows below see the partition count, not the data.
    placed = (
        positions.groupBy("score", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("total", F.sum("n").over(by_score))
    )
    # The first `total % tiles` tiles hold one row more than the others.
    last_ranks = F.array(
        *[
            F.lit(t) * F.expr(f"total div {tiles}") + F.least(F.lit(t), F.col("total") % tiles)
            for t in wanted or range(1, tiles)
        ]
    )
    offsets = F.filter(
        F.transform(last_ranks, lambda rank: rank - F.col("start")), lambda i: (i >= 1) & (i <= F.col("n"))
    )
    holding = placed.select("score", "part", offsets.alias("offsets")).filter(F.size("offsets") > 0)

    def cut_points(score: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("score") == score, F.col("pos"))))

    # At most (tiles - 1) partitions per score hold a cut, so `holding` has a fixed size bound.
    in_part = Window.partitionBy("score", "part").orderBy("pos")
    return (
        positions.join(F.broadcast(holding), ["score", "part"])
        .withColumn("i", F.row_number().over(in_part).cast("bigint"))
        .filter(F.array_contains("offsets", F.col("i")))
        .agg(F.struct(*[cut_points(score).alias(score) for score in keys]).alias("cuts"))
    )


def with_tiles(df: DataFrame, keys: dict[str, Column], tie: str, tiles: int) -> DataFrame:
    """Add one 1-based NTILE column per entry of ``keys``, each ordered by (key, tie)."""

    def tile(score: str, key: Column) -> Column:
        points = F.col("_cuts").getField(score)
        here = _position(key, F.col(tie))
        past = [F.when(here > F.get(points, F.lit(i)), 1).otherwise(0) for i in range(tiles - 1)]
        return sum(past, F.lit(1)).cast("bigint")

    return (
        df.withColumn("_cuts", tile_cuts(df, keys, tie, tiles).scalar())
        .withColumns({score: tile(score, key) for score, key in keys.items()})
        .drop("_cuts")
    )


def in_first_tile(df: DataFrame, key: Column, tie: str, tiles: int) -> Column:
    """Whether a row of ``df`` is in tile 1 of (key, tie); only that tile's last row is looked for."""
    cut = F.get(tile_cuts(df, {"first": key}, tie, tiles, wanted=[1]).scalar().getField("first"), F.lit(0))
    return ~F.coalesce(_position(key, F.col(tie)) > cut, F.lit(False))
