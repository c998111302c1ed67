"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance.

A fingerprint is ``SIZE:FINE:COARSE``. A rolling hash of the last seven bytes ends a chunk wherever it is
SIZE - 1 modulo SIZE; every chunk adds one character to FINE, or six where chunks are few. COARSE is made
in the same way with twice the size. What is left behind the last end is a chunk too, so every byte counts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tillroll.llm.common import column
from tillroll.sources.scratch import hold

WINDOW = 7
LEAST_SIZE = 3
BITS_OF_HASH = 32
LONGEST = 64
# Twice a size leaves about half of the ends; if it leaves less than one in LEAST_LEFT, the text repeats itself.
LEAST_LEFT = 3
SHARED_RUN = 7
LETTERS_OF_FEW = 6
# No signature has more chunks; beyond it repeats are folded, then chunks are grouped.
MOST_CHUNKS = 2048
LONGEST_PERIOD = 512
GROUP_WINDOW = 16
BLOCK_BYTES = 1 << 20
OUT_ROWS = 1024
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

# One odd multiplier a place of the window; any odd numbers would do.
_WEIGHTS = [(2 * k + 1) * 0x9E3779B1 & 0xFFFFFFFF | 1 for k in range(WINDOW)]
_GROUP_WEIGHTS = [(2 * k + 1) * 0x85EBCA6B & 0xFFFFFFFF | 1 for k in range(GROUP_WINDOW)]
_SPREAD = ((np.arange(256, dtype=np.uint64) + 1) * np.uint64(0x85EBCA6B) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _rolling(data: bytes, start: int, end: int) -> np.ndarray:
    """The rolling hash at every byte from ``start`` to ``end``; bytes before the text count as zero."""
    ahead = min(start, WINDOW - 1)
    values = _SPREAD[np.frombuffer(data, np.uint8, end - start + ahead, start - ahead)]
    values = np.concatenate([np.zeros(WINDOW - 1 - ahead, np.uint32), values])
    n = end - start
    total = np.zeros(n, np.uint32)
    for k, weight in enumerate(_WEIGHTS):
        total += values[k : k + n] * np.uint32(weight)
    return total ^ (total >> np.uint32(15))


def _triggers(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks of ``size`` end and the hashes there, in blocks so that a long text needs little memory."""
    ends, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for start in range(0, len(data), BLOCK_BYTES):
        rolled = _rolling(data, start, min(len(data), start + BLOCK_BYTES))
        found = np.flatnonzero(rolled % np.uint32(size) == size - 1)
        ends.append(found + start + 1)
        hashes.append(rolled[found].astype(np.uint64))
    return np.concatenate(ends), np.concatenate(hashes)


def _end_counts(data: bytes) -> np.ndarray:
    """How many chunks end at LEAST_SIZE and at each of its doubles."""
    steps = np.zeros(BITS_OF_HASH + 2, np.int64)
    for start in range(0, len(data), BLOCK_BYTES):
        above = _rolling(data, start, min(len(data), start + BLOCK_BYTES)).astype(np.uint64) + np.uint64(1)
        above = above[above % np.uint64(LEAST_SIZE) == 0]
        lowest = (above & (~above + np.uint64(1))).astype(np.float64)
        steps += np.bincount(np.frexp(lowest)[1] - 1, minlength=len(steps))
    return np.cumsum(steps[::-1])[::-1]


def _chunk_sums(data: bytes, ends: np.ndarray) -> np.ndarray:
    """crc32 of every chunk; what is left behind the last end is one too."""
    view = memoryview(data)
    found = [np.empty(0, np.uint32)]
    start = 0
    for k in range(0, len(ends), OUT_ROWS):
        stops = ends[k : k + OUT_ROWS].tolist()
        found.append(np.fromiter((zlib.crc32(view[a:b]) for a, b in zip([start, *stops], stops)), np.uint32, len(stops)))
        start = stops[-1]
    if start < len(data):
        found.append(np.array([zlib.crc32(view[start:])], np.uint32))
    return np.concatenate(found)


def _repeats(sums: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, period, end) of stretches that repeat their first ``period`` chunks, at least three times, in order."""
    stretches = []
    free = np.ones(len(sums), bool)
    for period in range(1, min(LONGEST_PERIOD, len(sums) // 3) + 1):
        same = (sums[period:] == sums[:-period]) & free[period:] & free[:-period]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= 2 * period and free[start : end + period].all():
                stretches.append((start, period, end + period))
                free[start : end + period] = False
        if free.sum() <= MOST_CHUNKS // 2:
            break
    return sorted(stretches)


def _folded(sums: np.ndarray, stretches: list[tuple[int, int, int]], halvings: int) -> np.ndarray:
    """``sums`` with the repeats in each stretch halved ``halvings`` times, one at least."""
    parts, at = [], 0
    for start, period, end in stretches:
        times = max(1, (end - start) // period >> halvings)
        parts += [sums[at:start], np.tile(sums[start : start + period], times), sums[end - (end - start) % period : end]]
        at = end
    return np.concatenate([*parts, sums[at:]])


def _shortened(sums: np.ndarray) -> np.ndarray:
    """At most MOST_CHUNKS sums that stand for all of ``sums``.

    What repeats is folded: the repeats of each stretch are halved until there is room, so that the shares
    of a text in its signature stay about the same. If that is not enough, chunks are grouped where a hash
    of the GROUP_WINDOW chunks before says so, as chunks are cut out of bytes.
    """
    stretches = _repeats(sums)
    shorter = sums
    for halvings in range(1, 33):
        if len(shorter) <= MOST_CHUNKS or not stretches:
            break
        shorter = _folded(sums, stretches, halvings)
    if len(shorter) <= MOST_CHUNKS:
        return shorter
    context = np.zeros(len(shorter), np.uint32)
    for k in range(GROUP_WINDOW):
        context[k:] += shorter[: len(shorter) - k] * np.uint32(_GROUP_WEIGHTS[k])
    context ^= context >> np.uint32(15)
    bits = 1
    while ((context & np.uint32((1 << bits) - 1)) == 0).sum() >= MOST_CHUNKS:
        bits += 1
    ends = np.flatnonzero((context & np.uint32((1 << bits) - 1)) == 0) + 1
    groups = np.split(shorter.astype("<u4"), ends)
    return np.array([zlib.crc32(g.tobytes()) for g in groups if len(g)], np.uint32)


def _signature(data: bytes, ends: np.ndarray) -> str:
    sums = _chunk_sums(data, ends)
    # Few chunks are spelled out, or equal letters would prove nothing.
    letters = 1 if len(sums) >= SHARED_RUN else LETTERS_OF_FEW
    if len(sums) > MOST_CHUNKS:
        sums = _shortened(sums)
    return "".join(LETTERS[total >> 6 * k & 63] for total in sums.tolist() for k in range(letters))


def fingerprint(data: bytes) -> str:
    """The signatures at the smallest size that ends fewer than LONGEST chunks, and at twice that size.

    A text that repeats itself has its ends at few values of the hash, and they go at once. So no size is
    taken that leaves less than one in LEAST_LEFT of the ends, all chunks are kept, and of sizes that end
    nearly the same ones the finest counts. A signature of fewer than SHARED_RUN chunks has LETTERS_OF_FEW
    letters for each, and none has more than MOST_CHUNKS: longer ones are folded and grouped.

    Ends at twice a size are ends at the size too, so one pass counts those of every size. Equal texts give
    equal fingerprints; the empty text gives ``3::``.
    """
    counts = _end_counts(data)
    step = taken = 0
    while counts[step] >= LONGEST and counts[step + 1] * LEAST_LEFT >= counts[step]:
        step += 1
        if counts[step] * 4 < counts[step - 1] * 3:
            taken = step
    size = LEAST_SIZE << taken
    ends, hashes = _triggers(data, size)
    coarse = ends[hashes % np.uint64(2 * size) == 2 * size - 1]
    return f"{size}:{_signature(data, ends)}:{_signature(data, coarse)}"


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements that turn ``a`` into ``b``; a column of the table is one integer."""
    # What both begin and end with costs nothing.
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    same = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = every, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right = down | ~(diagonal | up) & every
        left = up & diagonal
        distance += bool(right & last) - bool(left & last)
        right = (right << 1 | 1) & every
        up = (left << 1) & every | ~(diagonal | right) & every
        down = right & diagonal
    return distance


def _alike(a: str, b: str) -> float:
    """1 - distance / longer length, or 0 where no run of SHARED_RUN characters is common."""
    if a == b:
        return 1.0
    runs = {a[k : k + SHARED_RUN] for k in range(len(a) - SHARED_RUN + 1)}
    if not any(b[k : k + SHARED_RUN] in runs for k in range(len(b) - SHARED_RUN + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(a: str, b: str) -> float:
    """From 0 to 1; signatures are compared where their chunk sizes agree, and 1 is for equal fingerprints."""
    if a == b:
        return 1.0
    size_a, fine_a, coarse_a = a.split(":")
    size_b, fine_b, coarse_b = b.split(":")
    if size_a == size_b:
        return max(_alike(fine_a, fine_b), _alike(coarse_a, coarse_b))
    if int(size_a) == 2 * int(size_b):
        return _alike(fine_a, coarse_b)
    if int(size_b) == 2 * int(size_a):
        return _alike(coarse_a, fine_b)
    return 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_ROW = pa.schema(
    {
        "doc_id": pa.int64(),
        "n_chars": pa.int64(),
        "edited_sha256": pa.string(),
        "fingerprint": pa.string(),
        "edited_fingerprint": pa.string(),
        "near_edited": pa.float64(),
        "near_next": pa.float64(),
        "edge": pa.string(),
        "text": pa.string(),
        "part": pa.int64(),
    }
)
_RESULT = _ROW.names[:7]
_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, edge string, text string, part bigint"
)


def _compared(doc_id: int | None, text: str, print_: str, after: str, after_print: str) -> tuple:
    changed = edited(text, after).encode()
    changed_print = fingerprint(changed)
    return (
        doc_id,
        len(text),
        hashlib.sha256(changed).hexdigest(),
        print_,
        changed_print,
        likeness(print_, changed_print),
        likeness(print_, after_print),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished rows of all documents whose successor is in this partition, and its first and last texts."""
    part = TaskContext.get().partitionId()
    previous, rows = None, []

    def edge(kind: str, doc_id: int | None, text: str, print_: str) -> tuple:
        return (doc_id, len(text), None, print_, None, None, None, kind, text, part)

    for batch in batches:
        for key, value in zip(batch.column(0), batch.column(1)):
            doc_id, text = key.as_py(), value.as_py()
            print_ = fingerprint(text.encode())
            if previous is None:
                rows.append(edge("first", doc_id, text, print_))
            else:
                rows.append((*_compared(*previous, text, print_), None, None, None))
            previous = (doc_id, text, print_)
            if len(rows) >= OUT_ROWS:
                yield _batch(rows)
                rows = []
    if previous is not None:
        rows.append(edge("last", *previous))
        yield _batch(rows)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last document of a partition with the first of the one that follows."""
    for batch in batches:
        for row in batch.to_pylist():
            done = _compared(row["doc_id"], row["text"], row["fingerprint"], row["next_text"], row["next_fingerprint"])
            yield _batch([(*done, None, None, None)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint, edited text's fingerprint and likeness to the next document, one row per document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    next document is the one with the next doc_id; after the last comes the first, and a single document
    follows itself. Null text is empty; null ids come first; rows of one id go by a hash of their text;
    identical rows are all kept, in either order. Other columns are ignored; an empty table gives no rows.

    Documents are range-partitioned by id once, with their texts, and stream through each task in order,
    one document and its successor at a time. Only the first and the last text of each partition are
    written aside and meet across partitions.
    """
    rows = docs.select(
        column("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(column("text"), F.lit("")).alias("text"),
        F.xxhash64(column("text")).alias("hash"),
        F.monotonically_increasing_id().alias("nth"),
    )
    placed = rows.repartitionByRange("doc_id", "hash", "nth").sortWithinPartitions("doc_id", "hash", "nth")
    done = hold(placed.select("doc_id", "text").mapInArrow(_neighbours, _SCHEMA), "ctph")

    # One row per partition: which part follows which; the texts are joined to it by number.
    parts = done.filter("edge = 'first'").select("part")
    order = Window.orderBy("part")
    first = parts.agg(F.min("part").alias("first_part"))
    follows = parts.select("part", F.lead("part").over(order).alias("next_part"))
    firsts = done.filter("edge = 'first'").select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")
    )
    start = first.first()["first_part"]
    lasts = done.filter("edge = 'last'").select("part", "doc_id", "text", "fingerprint").join(
        follows.select("part", F.coalesce("next_part", F.lit(start).cast("bigint")).alias("next_part")), "part"
    )
    joined = lasts.join(firsts, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    crossed = joined.mapInArrow(_across, _SCHEMA)
    return done.filter("edge IS NULL").select(*_RESULT).unionAll(crossed.select(*_RESULT))
