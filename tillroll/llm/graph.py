"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillroll.sources.scratch import hold, release


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of ``links`` (a, b), two bigint columns; root is the least node it reaches.

    The result is a written table; those of earlier rounds are deleted as soon as the next is there.

    Alternating stars: each round, every node's larger neighbours are tied to its least neighbour, then its
    smaller ones are; the links shrink to one star per component, in about log(longest path) rounds. Each
    round is a minimum per node, which is summed before the shuffle, and a join that adaptive execution
    splits where a node has very many links. Rounds are written tables; only a
    count and two checksums reach the driver, which tell when a round changed nothing.
    """
    def state(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))).first())

    pairs = hold(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        name,
    )
    before = state(pairs)
    while True:
        # Towards larger neighbours: both directions of a link are seen by the node in the middle.
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = hold(
            both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            name,
        )
        # Towards smaller neighbours; a node keeps its own link to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = hold(moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), name)
        release(pairs)
        release(large)
        pairs, now = small, state(small)
        if now == before:
            break
        before = now
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = hold(stars.unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), name)
    release(pairs)
    return found
