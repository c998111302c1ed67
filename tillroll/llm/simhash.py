"""SimHash fingerprints and near-duplicate groups.

Fingerprints of 64 bits that differ by two bits or fewer are linked by multi-index hashing: each half of the
bits has a table, a fingerprint looks up the small Hamming ball around its own half, and what it meets is
verified by the complete distance. What hangs together is a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.llm.common import column, packed, unpacked
from tillroll.llm.graph import components
from tillroll.sources.scratch import hold, release

BITS = 64
SHINGLE_WORDS = 3
HASH_SEED = 42
MOST_DIFFERING = 2
COUNT_BLOCK = 1 << 16

# Two segments: of two differing bits at most one is in one of them.
SEGMENT_BITS = 32
SEGMENT_MASK = (1 << SEGMENT_BITS) - 1
# Table values with more fingerprints than this are looked up by the other half as well.
CROWD = 32

def simhash(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text: bit k is set if it is in over half of the shingles' hashes.

    Words are split at ASCII white space after lower-casing A-Z. Fewer words than a shingle has are one
    shingle; no words give zero.
    """
    return _majority(_shingle_hashes(text, shingle_words))


def _shingle_hashes(text: bytes, shingle_words: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(shingle_words, len(words))
    shingles = map(b" ".join, zip(*[words[k:] for k in range(width)]))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED)), np.uint64)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), COUNT_BLOCK):
        block = hashes[k : k + COUNT_BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _fingerprinter(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_signed(simhash(t.as_py(), shingle_words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(values, pa.int64())], names=["_id", "_hash", "_print"]
            )

    return run


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(_id, _hash, _print) per document: doc_id, hash of the text, fingerprint as a signed bigint.

    Null text has fingerprint zero.
    """
    rows = docs.select(
        column("doc_id").cast("bigint").alias("_id"),
        F.coalesce(column("text"), F.lit("")).cast("binary").alias("text"),
        F.xxhash64(column("text")).alias("_hash"),
    )
    return rows.mapInArrow(_fingerprinter(shingle_words), "_id bigint, _hash bigint, _print bigint")


def _half(print_: Column, segment: Column) -> Column:
    """The bits of one segment, 0 the high ones; marked with the segment, so that tables do not mix."""
    high = F.shiftrightunsigned(print_, SEGMENT_BITS)
    low = print_.bitwiseAND(F.lit(SEGMENT_MASK))
    return F.when(segment == 0, high).otherwise(low.bitwiseOR(F.lit(1 << SEGMENT_BITS)))


def _segment(key: Column) -> Column:
    return F.shiftrightunsigned(key, SEGMENT_BITS)


def _flips() -> Column:
    return F.array(*[F.lit(1 << bit) for bit in range(SEGMENT_BITS)])


def _looked_up(key: Column) -> Column:
    """A half and its neighbours with one more bit set. Of two halves one bit apart one finds the other so."""
    unset = F.filter(_flips(), lambda m: key.bitwiseAND(m) == 0)
    return F.concat(F.array(key), F.transform(unset, lambda m: key.bitwiseOR(m)))


def _ball(key: Column) -> Column:
    """A half and all that differ from it by one bit."""
    return F.concat(F.array(key), F.transform(_flips(), lambda m: key.bitwiseXOR(m)))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, a written table, that tie together all at most two bits apart.

    Multi-index hashing over two segments. A table per segment holds every fingerprint under the value of
    that half. Two fingerprints at most two bits apart have a half in which they differ by one bit or none;
    so each looks up its own half and its neighbours, about 34 values in all, and fetches what is there.
    Complete distances decide.

    A value that more than CROWD fingerprints share, as a family of near copies does, is looked up by both
    halves: its own fingerprints are put under each value of the ball around their other half, those that
    came from a neighbouring value under their own other half. All that meet under one key, 65 at most, are
    within two bits of each other, so a chain of them ties them together and no pairs multiply. Nothing is
    missed either way, and rows grow as the fingerprints.
    """
    print_ = F.col("_print")
    table = prints.select("_print").distinct()
    table = hold(
        table.select("_print", F.explode(F.array(F.lit(0), F.lit(1))).alias("_segment")).select(
            "_print", _half(print_, F.col("_segment")).alias("_key")
        ),
        "simhash-table",
    )
    sizes = table.groupBy("_key").agg(F.count("*").alias("_size"))
    probes = table.select("_print", F.col("_key").alias("_own"), F.explode(_looked_up(F.col("_key"))).alias("_key"))
    own = F.col("_own") == F.col("_key")
    # Most neighbours hold nothing, and a value that only its own fingerprint has leads nowhere.
    # Spark takes probes to be as large as the table they explode from, so it must not choose to broadcast them.
    met = probes.join(sizes.hint("merge"), "_key").filter(~own | (F.col("_size") > 1))
    hits = hold(met.select("_print", "_key", own.alias("_home"), (F.col("_size") > CROWD).alias("_crowd")), "simhash-hits")

    entries = table.select("_key", F.col("_print").alias("_entry"))
    fetched = hits.filter(~F.col("_crowd")).join(entries, "_key").filter(
        (_distance("_print", "_entry") <= MOST_DIFFERING)
        # Two of one value meet twice; neighbours meet once.
        & (~F.col("_home") | (F.col("_print") < F.col("_entry")))
    )
    crowd = hits.filter("_crowd").withColumn("_other", _half(print_, 1 - _segment(F.col("_key"))))
    second = F.when(F.col("_home"), _ball(F.col("_other"))).otherwise(F.array("_other"))
    crowd = crowd.select("_print", "_key", F.explode(second).alias("_other"))
    together = Window.partitionBy("_key", "_other").orderBy("_print")
    chained = crowd.withColumn("_entry", F.lag("_print").over(together)).filter(
        (F.col("_entry") != F.col("_print")) & (_distance("_print", "_entry") <= MOST_DIFFERING)
    )
    both = fetched.select("_print", "_entry").unionAll(chained.select("_print", "_entry"))
    links = hold(both.select(F.least("_print", "_entry").alias("a"), F.greatest("_print", "_entry").alias("b")), "simhash-links")
    release(hits)
    release(table)
    return links


def near_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(_id, _hash, _print, _root, _group) of every document; _group is the least doc_id it reaches.

    Groups are joined over fingerprints at most two bits apart and _root is the fingerprint that names the
    group. Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat a
    doc_id are rows of their own. A null doc_id never is the least unless all of its group are null. An
    empty table gives no rows. Other columns are ignored.

    Equal fingerprints are one node, so a group of copies, however large, costs one node; what goes back
    to the documents is one row per fingerprint, by a join whose hot side is split.
    """
    prints = hold(fingerprints(docs, shingle_words), "simhash")
    links = near_links(prints)
    roots = components(links, "simhash-components")
    release(links)
    nodes = prints.groupBy("_print").agg(F.min("_id").alias("_least"))
    known = nodes.join(roots, F.col("_print") == F.col("node"), "left").select(
        "_print", "_least", F.coalesce("root", "_print").alias("_root")
    )
    known = hold(known, "simhash-roots")
    release(roots)
    least = known.groupBy("_root").agg(F.min("_least").alias("_group"))
    # Neither all fingerprints nor all documents fit the driver, however small their files are.
    labels = hold(known.join(least.hint("merge"), "_root").select("_print", "_root", "_group"), "simhash-groups")
    release(known)
    return prints.join(labels.hint("merge"), "_print").select("_id", "_hash", "_print", "_root", "_group")


def hexadecimal(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def _row_key(doc_id: Column, text_hash: Column) -> list[Column]:
    """A key without nulls that only rows of the same id and text share."""
    return [
        F.coalesce(doc_id, F.lit(0)).alias("_key_id"), doc_id.isNull().alias("_key_none"), text_hash.alias("_key_hash")
    ]


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each group of ``near_groups``, the one with the least doc_id.

    Of several texts under the least doc_id the one with the least hash stays, of identical rows any one.
    A group whose ids are all null keeps one row. Columns are those of ``docs``.
    """
    groups = near_groups(docs, shingle_words)
    leaders = (
        groups.filter(F.col("_id").eqNullSafe(F.col("_group")))
        .groupBy("_root", "_group")
        .agg(F.min("_hash").alias("_hash"))
    )
    key = ["_key_id", "_key_none", "_key_hash"]
    chosen = hold(leaders.select(*_row_key(F.col("_group"), F.col("_hash"))), "simhash-leaders")
    release(groups)
    rows = docs.select(
        packed(docs), *_row_key(column("doc_id").cast("bigint"), F.xxhash64(column("text")))
    ).join(chosen.hint("merge"), key, "left_semi")
    # Partitioned like the join, so identical rows meet without another shuffle.
    first = F.row_number().over(Window.partitionBy(*key).orderBy("_key_hash"))
    return rows.withColumn("_nth", first).filter("_nth = 1").select(*unpacked(docs.columns, {}))
