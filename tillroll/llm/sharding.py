"""Random sharding by a two-pass external shuffle."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from tillroll.llm.common import ROW, column, packed, unpacked, utf8_size
from tillroll.sources.scratch import hold

SHARDS = 24
BUCKET_BYTES = 32 << 20
ROW_BYTES = 8


def _fisher_yates(seed: int):
    def shuffle(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        # A fixed order to start from, so that a recomputed task deals the same permutation.
        rows = rows.sort_by([("_id", "ascending"), ("_order", "ascending")])
        order = np.arange(rows.num_rows)
        np.random.default_rng([seed, bucket]).shuffle(order)  # numpy's in-place Fisher-Yates
        return (
            rows.take(pa.array(order))
            .append_column("_at", pa.array(np.arange(rows.num_rows, dtype=np.int64)))
            .select([ROW, "_size", "_bucket", "_at"])
        )

    return shuffle


def shuffled_shards(
    docs: DataFrame, shards: int = SHARDS, seed: int = 3, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``docs`` in random order, cut into ``shards`` whose row counts differ by one at most.

    Adds ``size`` (UTF-8 bytes of the text plus 8), ``shard`` and ``slot``, the gapless position within
    the shard. Pass one scatters rows by a seeded hash of doc_id into buckets of about ``bucket_bytes``
    and is Spark's shuffle; pass two shuffles each bucket in memory and writes it. Counts per written
    bucket then give every row its place in the whole, and the shards are equal cuts of that.

    The rows of a doc_id that is repeated beyond a bucket's size are scattered by row instead. Null text
    counts as no bytes; null and repeated ids are rows like any other; fewer rows than shards leave the
    last shards empty; an empty table stays empty. Input columns named like an added one give way to it.
    A single row larger than a bucket makes that bucket as large as the row.
    """
    whole = docs.agg(F.sum(utf8_size(column("text")) + ROW_BYTES)).first()[0] or 0
    buckets = max(1, math.ceil(whole / bucket_bytes))
    rows = docs.select(
        packed(docs),
        column("doc_id").alias("_id"),
        F.xxhash64(column("text")).alias("_order"),
        (utf8_size(column("text")) + ROW_BYTES).alias("_size"),
        F.monotonically_increasing_id().alias("_nth"),
    )
    heavy = hold(
        docs.groupBy(column("doc_id").alias("_heavy"))
        .agg(F.sum(utf8_size(column("text")) + ROW_BYTES).alias("_bytes"))
        .filter(F.col("_bytes") > bucket_bytes)
        .select("_heavy", F.lit(True).alias("_spread")),
        "shard-heavy",
    )
    spread = rows.join(heavy, F.col("_id").eqNullSafe(F.col("_heavy")), "left")
    dealt = F.xxhash64(F.lit(seed), F.col("_id"), F.when(F.col("_spread"), F.col("_nth")).otherwise(0))
    scattered = spread.select(
        ROW, "_id", "_order", "_size", F.pmod(dealt, F.lit(buckets)).cast("bigint").alias("_bucket")
    )
    schema = scattered.select(ROW, "_size", "_bucket").schema.add("_at", LongType())
    written = hold(scattered.groupBy("_bucket").applyInArrow(_fisher_yates(seed), schema), "shard-buckets")

    # One row per bucket of tens of megabytes: few even for very large inputs.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = hold(
        written.groupBy("_bucket")
        .agg(F.count("*").alias("_rows"))
        .select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"), "_rows"),
        "shard-starts",
    )
    n = starts.agg(F.sum("_rows")).first()[0] or 0
    least, longer = divmod(n, shards)
    place = F.col("_start") + F.col("_at")
    in_longer = place < longer * (least + 1)
    rest = place - longer * (least + 1)
    shard = F.when(in_longer, F.floor(place / (least + 1)))
    slot = F.when(in_longer, place % (least + 1))
    if least:
        shard = shard.otherwise(longer + F.floor(rest / least))
        slot = slot.otherwise(rest % least)
    return written.join(starts, "_bucket").select(
        *unpacked(docs.columns, {"size": F.col("_size"), "shard": shard.cast("int"), "slot": slot.cast("bigint")})
    )
