"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm.common import ROW, column, packed, running_totals, unpacked, word_count
from tillroll.sources.scratch import hold

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SHARE_PERCENT = 100


def _source_order() -> list[Column]:
    return [F.col("_source").asc_nulls_last()]


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    share_percent: int = SHARE_PERCENT,
) -> DataFrame:
    """Per source: its size, its target and the rate at which its documents are repeated.

    ``sizes`` has ``_source`` and ``_size``. Sources in code point order, null last, take the weights
    in turn and divide ``share_percent`` of all sizes; a target stops at ``most_repeats`` times its
    source's size and the excess is divided again by weight. Sorted by size over weight, the sources
    that stop come first: source i stops if its limit is at most its part of what the limits before it
    leave. A source without words has target 0 and rate 1: its documents are kept and take nothing.

    Two range-partitioned running totals (rank, then limits and weights) stand in for global windows,
    so the number of sources is not bounded either.
    """
    # The binary order of the text is its code point order, whatever the session's collation.
    summed = sizes.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    ranked = running_totals(summed, _source_order(), {"_rank": F.lit(1)}, "mix-ranks")
    choices = F.array(*[F.lit(w) for w in weights])
    weighed = ranked.select(
        "_source",
        "_source_size",
        F.get(choices, F.pmod(F.col("_rank"), F.lit(len(weights))).cast("int")).cast("bigint").alias("_weight"),
        (F.col("_source_size") * most_repeats).alias("_limit"),
    )
    by_ratio = [F.col("_limit") / F.col("_weight"), F.col("_source").asc_nulls_last()]
    placed = hold(
        running_totals(weighed, by_ratio, {"_limits": F.col("_limit"), "_weights": F.col("_weight")}, "mix-limits"),
        "mix-placed",
    )
    whole = placed.agg(
        F.coalesce(F.sum("_source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("_weight"), F.lit(0)).alias("weight")
    ).first()
    amount = whole["size"] * share_percent / 100.0
    fair = (F.lit(amount) - F.col("_limits")) * F.col("_weight") / (F.lit(whole["weight"]) - F.col("_weights"))
    judged = placed.withColumn("_stops", F.col("_limit") <= fair)
    stopped = judged.filter("_stops").agg(
        F.coalesce(F.sum("_limit"), F.lit(0)).alias("limit"), F.coalesce(F.sum("_weight"), F.lit(0)).alias("weight")
    ).first()
    open_amount, open_weight = amount - stopped["limit"], whole["weight"] - stopped["weight"]
    target = F.when(F.col("_stops"), F.col("_limit").cast("double"))
    if open_weight:
        target = target.otherwise(F.lit(open_amount) * F.col("_weight") / F.lit(open_weight))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(1.0)
    return hold(
        judged.withColumn("_target", target).select("_source", "_source_size", "_target", rate.alias("_rate")),
        "mix-targets",
    )


def chance(*parts: Column) -> Column:
    """A number from 0 up to 1 that the seed and the id decide: 52 bits of an md5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _planned(docs: DataFrame, seed: int, weights: tuple[int, ...], most_repeats: int, share_percent: int) -> DataFrame:
    """Packed rows with ``_size``, ``_source_size``, ``_target`` and ``_copies``.

    The narrow sizes are summed per source first, so a source with a third of all rows meets in partial
    sums only; the few target rows go back by a join that Spark broadcasts if they are small on disk
    and that adaptive execution splits by rows otherwise.
    """
    sized = docs.select(packed(docs), column("source").alias("_source"), word_count(column("text")).alias("_size"))
    targets = source_targets(
        docs.select(column("source").alias("_source"), word_count(column("text")).alias("_size")),
        weights,
        most_repeats,
        share_percent,
    )
    known = targets.withColumnRenamed("_source", "_of")
    whole_copies = F.floor(F.col("_rate"))
    drawn = chance(F.lit(seed), F.col("_row.doc_id")) < F.col("_rate") - whole_copies
    return sized.join(known, F.col("_source").eqNullSafe(F.col("_of"))).withColumn(
        "_copies", whole_copies + drawn.cast("bigint")
    )


def plan_mix(
    docs: DataFrame,
    seed: int = 5,
    weights: tuple[int, ...] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    share_percent: int = SHARE_PERCENT,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``, the times the mix takes each document.

    A document is taken floor(rate) times and once more with a probability equal to the fraction, by a
    hash of seed and doc_id; reruns and recomputed tasks agree. Null text has no words, a null source is a
    source of its own, rows with the same doc_id (or none) share one draw, an empty table stays empty.
    Input columns named like an added one give way to it.
    """
    return _planned(docs, seed, weights, most_repeats, share_percent).select(
        *unpacked(
            docs.columns,
            {
                "size": F.col("_size"),
                "source_size": F.col("_source_size"),
                "target": F.col("_target"),
                "copies": F.col("_copies"),
            },
        )
    )


def mix(
    docs: DataFrame,
    seed: int = 5,
    weights: tuple[int, ...] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    share_percent: int = SHARE_PERCENT,
) -> DataFrame:
    """The rows of ``docs``, with their columns, each as often as :func:`plan_mix` takes it."""
    none = F.array().cast("array<int>")
    copies = F.when(F.col("_copies") > 0, F.sequence(F.lit(1), F.col("_copies").cast("int"))).otherwise(none)
    planned = _planned(docs, seed, weights, most_repeats, share_percent)
    return planned.select(ROW, F.explode(copies).alias("_copy")).select(*unpacked(docs.columns, {}))
