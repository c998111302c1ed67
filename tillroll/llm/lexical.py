"""Ranked lexical search: every document against every item, by dense matrix products.

An item tile is a matrix of term weights over the terms its items have, and nothing else; a document tile is
a matrix of term impacts over the same terms. Their product is the scores of all items in all documents of
the tile. Weights and impacts are whole numbers, and a vocabulary tile ends where a sum could pass 2^53, so
double-precision products are exact, in whatever order they add up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tillroll.llm.common import column, running_totals
from tillroll.sources.scratch import hold, release

BEST = 10

# Fixed values of the score: term saturation in thousandths and length normalisation in hundredths.
IMPACT_SCALE = 1_000_000_000
TF_SCALE = 1000
LENGTH_SCALE = 8
LENGTH_PART = 75

# Items of one search are taken in groups of about so many bytes of distinct terms: what the driver holds and
# workers get. Every group costs two passes over the documents.
GROUP_BYTES = 8 << 20

ITEM_TILE = 128
TERM_TILE = 2048
DOC_TILE = 1024
# No impact reaches a million, so no sum over a tile of weights up to this one reaches 2^53.
MOST_IMPACT = IMPACT_SCALE // TF_SCALE
MOST_WEIGHT = ((1 << 53) - 1) // MOST_IMPACT

# Long texts are cut into terms piece by piece.
PIECE_BYTES = 1 << 20

# Bytes that are no part of a term become spaces, A-Z become a-z; bytes of other letters than ASCII's stay.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists of a piece of the text each."""
    spaced = text.translate(_TERM_BYTES)
    start = 0
    while len(spaced) - start > PIECE_BYTES:
        end = spaced.find(b" ", start + PIECE_BYTES)
        if end < 0:
            break
        yield spaced[start:end].split()
        start = end
    yield (spaced[start:] if start else spaced).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, terms, counts, bytes): the distinct terms of an item."""
    for batch in batches:
        found, counts, sizes = [], [], []
        for text in batch.column(1):
            of_item: dict[bytes, int] = {}
            for piece in terms(text.as_py()):
                for term in piece:
                    of_item[term] = of_item.get(term, 0) + 1
            found.append(list(of_item))
            counts.append(list(of_item.values()))
            sizes.append(sum(map(len, of_item)) + 16 * len(of_item))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(found, pa.list_(pa.binary())),
                pa.array(counts, pa.list_(pa.int64())),
                pa.array(sizes, pa.int64()),
            ],
            names=["item_id", "terms", "counts", "bytes"],
        )


class _Counter:
    """Counts the terms of documents that are in a vocabulary."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.get = vocabulary.get
        self.size = len(vocabulary)

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, times) of a tile of ``texts``, sorted by document, and the number of all terms of each."""
        lengths = np.zeros(len(texts), np.int64)
        keys, times = [], []
        for nth, text in enumerate(texts):
            for piece in terms(text):
                lengths[nth] += len(piece)
                ids = np.fromiter(map(self.get, piece, repeat(-1)), np.int64, len(piece))
                found, n = np.unique(ids[ids >= 0], return_counts=True)
                keys.append(found + nth * self.size)
                times.append(n)
        all_keys, place = np.unique(np.concatenate([*keys, np.empty(0, np.int64)]), return_inverse=True)
        summed = np.zeros(len(all_keys), np.int64)
        np.add.at(summed, place, np.concatenate([*times, np.empty(0, np.int64)]))
        docs, words = np.divmod(all_keys, max(1, self.size))
        return docs, words, summed, lengths


def _tiles_of_texts(batches: Iterator[pa.RecordBatch], texts_at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, DOC_TILE):
            tile = batch.slice(start, DOC_TILE)
            yield tile, tile.column(texts_at).to_pylist()


# Rows of the statistics that are no term.
DOCUMENTS, TERMS = -1, -2


def _statistics(vocabulary: list[bytes]):
    """(term, number): documents that hold each term, documents with any term, and all terms, of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter({t: k for k, t in enumerate(vocabulary)})
        holding = np.zeros(len(vocabulary), np.int64)
        documents = all_terms = 0
        for _, texts in _tiles_of_texts(batches, 0):
            _, words, _, lengths = counter.count(texts)
            holding += np.bincount(words, minlength=len(vocabulary))
            documents += int((lengths > 0).sum())
            all_terms += int(lengths.sum())
        known = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array([DOCUMENTS, TERMS, *known], pa.int64()), pa.array([documents, all_terms, *holding[known]], pa.int64())],
            names=["term", "number"],
        )

    return run


@dataclass
class TermTile:
    """Weights of one item tile over some of its terms, as entries (row, col, weight) of a matrix."""

    terms: np.ndarray
    rows: np.ndarray
    cols: np.ndarray
    weights: np.ndarray


@dataclass
class Model:
    vocabulary: list[bytes]
    items: int
    tiles: list[tuple[int, int, list[TermTile]]]  # first item, end, term tiles
    documents: int
    all_terms: int


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def term_tiles(items: list[dict[int, int]]) -> list[TermTile]:
    """The weights (term -> weight) of some items as term tiles: at most TERM_TILE terms, and no item's weights
    in a tile add up to more than MOST_WEIGHT. A weight above that is spread over columns of the same term."""
    of_term: dict[int, list[tuple[int, int]]] = {}
    for row, weights in enumerate(items):
        for term, value in weights.items():
            if value:
                of_term.setdefault(term, []).append((row, value))
    tiles: list[TermTile] = []
    chosen: list[tuple[int, list[tuple[int, int]]]] = []
    sums = [0] * len(items)

    def close() -> None:
        if chosen:
            entries = [(row, col, value) for col, (_, column_) in enumerate(chosen) for row, value in column_]
            rows, cols, values = (np.array(part) for part in zip(*entries))
            tiles.append(TermTile(np.array([t for t, _ in chosen], np.int64), rows, cols, values.astype(np.float64)))
        chosen.clear()
        sums[:] = [0] * len(items)

    for term in sorted(of_term):
        waiting = of_term[term]
        while waiting:
            part = [(row, min(value, MOST_WEIGHT)) for row, value in waiting]
            if len(chosen) == TERM_TILE or any(sums[row] + value > MOST_WEIGHT for row, value in part):
                close()
            chosen.append((term, part))
            for row, value in part:
                sums[row] += value
            waiting = [(row, value - MOST_WEIGHT) for row, value in waiting if value > MOST_WEIGHT]
    close()
    return tiles


def _model(found: list, statistics: dict[int, int], vocabulary: dict[bytes, int]) -> Model:
    documents, all_terms = statistics.get(DOCUMENTS, 0), statistics.get(TERMS, 0)
    weights = [
        {
            vocabulary[t]: n * weight(documents, statistics[vocabulary[t]])
            for t, n in zip(map(bytes, row["terms"]), row["counts"])
            if vocabulary[t] in statistics
        }
        for row in found
    ]
    tiles = [
        (first, min(first + ITEM_TILE, len(weights)), term_tiles(weights[first : first + ITEM_TILE]))
        for first in range(0, len(weights), ITEM_TILE)
    ]
    return Model(list(vocabulary), len(found), tiles, documents, all_terms)


def scores(model: Model, docs: np.ndarray, words: np.ndarray, times: np.ndarray, lengths: np.ndarray):
    """(first item, exact scores of an item tile in the documents of a tile), tile after tile."""
    spread = 100 - LENGTH_PART + LENGTH_PART * lengths * model.documents // max(1, model.all_terms)
    impacts = IMPACT_SCALE * times // (TF_SCALE * times + LENGTH_SCALE * spread[docs])
    place = np.full(len(model.vocabulary), -1, np.int64)
    for first, end, parts in model.tiles:
        total = np.zeros((end - first, len(lengths)), np.int64)
        for part in parts:
            # A term whose weight is spread stands in several columns, which follow each other.
            once, starts = np.unique(part.terms, return_index=True)
            place[once] = starts
            cols = place[words]
            held = cols >= 0
            place[once] = -1
            if not held.any():
                continue
            some, at = np.unique(docs[held], return_inverse=True)
            weights = np.zeros((end - first, len(part.terms)))
            weights[part.rows, part.cols] = part.weights
            of_docs = np.zeros((len(part.terms), len(some)))
            of_docs[cols[held], at] = impacts[held]
            repeated = np.flatnonzero(np.diff(part.terms) == 0) + 1
            for col in repeated:
                of_docs[col] = of_docs[col - 1]
            total[:, some] += (weights @ of_docs).astype(np.int64)
        yield first, total


class Best:
    """The ``best`` rows per item so far: highest score, then least doc_id, rows without an id last."""

    def __init__(self, items: int, best: int):
        self.best = best
        self.least = np.ones(items, np.int64)
        self.rows = [np.empty(0, np.int64) for _ in range(4)]  # item, score, no id, doc_id

    def add(self, first: int, total: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        least = self.least[first : first + len(total)]
        if total.shape[1] > self.best:
            least = np.maximum(least, np.partition(total, -self.best, axis=1)[:, -self.best])
        item, doc = np.nonzero(total >= least[:, None])
        if not len(item):
            return
        added = (item + first, total[item, doc], none[doc], ids[doc])
        item, score, no_id, doc_id = (np.concatenate(pair) for pair in zip(self.rows, added))
        order = np.lexsort((doc_id, no_id, -score, item))
        item, score, no_id, doc_id = item[order], score[order], no_id[order], doc_id[order]
        begins = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        nth = np.arange(len(item)) - np.repeat(begins, np.diff(np.r_[begins, len(item)]))
        keep = nth < self.best
        self.rows = [part[keep] for part in (item, score, no_id, doc_id)]
        last = nth == self.best - 1
        self.least[item[last]] = score[last]


def _best_of_task(shared, best: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        counter = _Counter({t: k for k, t in enumerate(model.vocabulary)})
        found = Best(model.items, best)
        for tile, texts in _tiles_of_texts(batches, 1):
            none = np.array(tile.column(0).is_null()).astype(np.int64)
            ids = tile.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for first, total in scores(model, *counter.count(texts)):
                found.add(first, total, none, ids)
        item, score, none, ids = found.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(ids, mask=none == 1), pa.array(score)], names=["item", "doc_id", "score"]
        )

    return run


# Rows of an item's best lists of all tasks meet in so many parts first.
PARTS = 32


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents with a score above zero for each row of ``items``.

    Equal scores go by ascending doc_id, rows without a doc_id last. Every row of ``docs`` and of ``items`` is
    one of its own, also where ids or texts repeat; a null item_id stays null. Null, empty and termless
    texts score nothing and count as no document. Other columns are ignored. An empty table on either side
    gives no rows.

    Documents are read twice for each group of items, and are neither shuffled nor written: a task gives
    numbers per term, then its own best rows per item.
    """
    spark = docs.sparkSession
    texts = docs.select(
        column("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(column("text"), F.lit("")).cast("binary").alias("text"),
    )
    wanted = items.select(
        column("item_id").cast("bigint").alias("item_id"),
        F.coalesce(column("text"), F.lit("")).cast("binary").alias("text"),
    ).mapInArrow(_item_terms, "item_id bigint, terms array<binary>, counts array<bigint>, bytes bigint")
    wanted = hold(wanted, "lexical-items")
    order = [F.col("item_id"), F.hash("terms", "counts")]
    grouped = running_totals(wanted, order, {"before": F.col("bytes")}, "lexical-groups")
    grouped = hold(
        grouped.select("item_id", "terms", "counts", F.floor(F.col("before") / GROUP_BYTES).alias("group")), "lexical-grouped"
    )
    release(wanted)
    numbers = [row["group"] for row in grouped.select("group").distinct().orderBy("group").toLocalIterator()]
    result = None
    for group in numbers:
        found = grouped.filter(F.col("group") == group).collect()
        vocabulary = {t: k for k, t in enumerate(sorted({bytes(t) for row in found for t in row["terms"]}))}
        counted = texts.select("text").mapInArrow(_statistics(list(vocabulary)), "term bigint, number bigint")
        statistics = {r["term"]: r["number"] for r in counted.groupBy("term").agg(F.sum("number").alias("number")).collect()}
        shared = spark.sparkContext.broadcast(_model(found, statistics, vocabulary))
        candidates = texts.mapInArrow(_best_of_task(shared, best), "item int, doc_id bigint, score bigint")
        names = spark.createDataFrame(
            [(k, row["item_id"]) for k, row in enumerate(found)], "item int, item_id bigint"
        )
        ranked = _ranked(candidates, best).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        result = ranked if result is None else result.unionAll(ranked)
    if result is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return result


def _ranked(candidates: DataFrame, best: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")
    of_part = candidates.select("*", part)
    of_part = of_part.withColumn("nth", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return of_part.filter(F.col("nth") <= best).withColumn("rank", rank).filter(F.col("rank") <= best)
