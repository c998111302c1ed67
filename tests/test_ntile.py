from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from tillroll.operators.ntile import with_tiles


def frame(spark, n: int, values: int, partitions: int = 5):
    rng = random.Random(n * 31 + values)
    rows = [(f"{rng.getrandbits(64):016x}{i}", rng.randrange(values) if values else 0) for i in range(n)]
    return spark.createDataFrame(rows, "sk string, k bigint").repartition(partitions)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 7, 12, 101, 2003])
@pytest.mark.parametrize("values", [0, 3, 100_000])
def test_equals_ntile(spark, n, values):
    df = frame(spark, n, values)
    ours = with_tiles(df, {"up": F.col("k"), "down": -F.col("k")}, tie="sk", tiles=5)
    checked = ours.select(
        "up",
        "down",
        F.ntile(5).over(Window.orderBy("k", "sk")).alias("up_whole"),
        F.ntile(5).over(Window.orderBy(F.desc("k"), "sk")).alias("down_whole"),
    ).collect()
    assert len(checked) == n
    assert all(r.up == r.up_whole and r.down == r.down_whole for r in checked)


def test_tied_majority_is_split_by_the_tie_break(spark):
    """A third of all rows share one key, over several range partitions."""
    rows = [(f"{i:08d}", 1 if i % 3 else 0) for i in range(30_000)]
    df = spark.createDataFrame(rows, "sk string, k bigint").repartition(7)
    tiles = with_tiles(df, {"t": F.col("k")}, tie="sk", tiles=5)
    whole = F.ntile(5).over(Window.orderBy("k", "sk"))
    assert tiles.withColumn("w", whole).filter("t != w").count() == 0


def test_missing_keys_come_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 2), ("c", 1)], "sk string, k bigint")
    rows = {r.sk: r.t for r in with_tiles(df, {"t": F.col("k")}, tie="sk", tiles=3).collect()}
    assert rows == {"c": 1, "b": 2, "a": 3}

