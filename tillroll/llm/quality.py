"""Quality scores: random Fourier features over document statistics, ridge by normal equations, isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tillroll.llm.common import column, id_remainder, packed, unpacked
from tillroll.sources.scratch import hold, release

FEATURES = 128
SEED = 8
RIDGE = 1e-4
CLIP = 5.0
PARTS = 2
SCORE_STEP = 1000

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_STOP = np.isin(np.arange(256), list(b".,"))
_MARK = np.isin(np.arange(256), list(b"!?"))
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{|}~"))
_HIGH = np.arange(256) >= 128
_CLASSES = [_UPPER, _DIGIT, _STOP, _MARK, _SYMBOL, _HIGH]
_SYMBOL_ENDS = tuple(bytes([c]) for c in b"!?#$%&*+/<=>@[\\]^_`{|}~")
N_STATS = 17


def statistics(text: bytes) -> list[float]:
    """N_STATS numbers about a whole text: its length, kinds of characters, words and repetition."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    letters = max(1, int(counts[_UPPER].sum() + counts[_LOWER].sum()))
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen = Counter(words)
    twice = sum(map(bytes.__eq__, words, words[1:]))
    return [
        math.log1p(len(words)),
        float(lengths.mean()) if words else 0.0,
        float(lengths.std()) if words else 0.0,
        *[float(counts[c].sum()) / size for c in _CLASSES],
        float(counts[_UPPER].sum()) / letters,
        len(seen) / math.pow(n, 0.75),
        max(seen.values(), default=0) / n,
        twice / n,
        len(set(lines)) / max(1, len(lines)),
        math.log1p(len(words) / len(lines)),
        sum(w.endswith(_SYMBOL_ENDS) for w in words) / n,
        float((lengths == 1).sum()) / n,
    ]


@F.arrow_udf(ArrayType(DoubleType()))
def _statistics_of(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))


def document_statistics(text: Column) -> Column:
    """The statistics of a text; those of the empty text for null."""
    return _statistics_of(F.coalesce(text, F.lit("")).cast("binary"))


@dataclass(frozen=True)
class Model:
    """Everything a score needs; without weights every score is 0.5."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return fourier(stats, self.center, self.scale) @ weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(self.knots):
            return np.full(len(stats), 0.5)
        return np.interp(self.raw(stats, self.weights), self.knots, self.levels)


def fourier(stats: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A constant and FEATURES random cosines whose products approximate a Gaussian kernel of width sqrt(N_STATS)."""
    x = np.clip((stats - center) / scale, -CLIP, CLIP)
    draw = np.random.default_rng(SEED)
    waves = draw.normal(0.0, 1.0 / math.sqrt(N_STATS), (N_STATS, FEATURES))
    shifts = draw.uniform(0.0, 2 * math.pi, FEATURES)
    return np.hstack([np.ones((len(x), 1)), math.sqrt(2.0 / FEATURES) * np.cos(x @ waves + shifts)])


def _matrix(stats: pa.Array) -> np.ndarray:
    return np.asarray(stats.values.slice(stats.offset * N_STATS, len(stats) * N_STATS)).reshape(-1, N_STATS)


def _equations(center: np.ndarray, scale: np.ndarray):
    """Sums of z z' and z y over a partition, one row per part and cell of the triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = FEATURES + 1
        sums = np.zeros((PARTS, d, d + 1))
        for batch in batches:
            z = fourier(_matrix(batch.column("stats")), center, scale)
            weight, y, part = (np.asarray(batch.column(c)) for c in ("n", "y", "part"))
            for p in range(PARTS):
                rows = z[part == p] * np.sqrt(weight[part == p])[:, None]
                sums[p, :, :d] += rows.T @ rows
                sums[p, :, d] += z[part == p].T @ (weight * y)[part == p]
        keep = np.triu(np.ones((d, d + 1), bool))
        cells = np.flatnonzero(keep)
        for p in range(PARTS):
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(np.full(len(cells), p, np.int32)),
                    "cell": pa.array(cells.astype(np.int32)),
                    "value": pa.array(sums[p][keep]),
                }
            )

    return run


def _solved(sums: np.ndarray) -> np.ndarray:
    d = FEATURES + 1
    upper = sums[:, :d]
    whole = upper + upper.T - np.diag(np.diag(upper))
    return np.linalg.solve(whole + (RIDGE * whole[0, 0] + 1e-9) * np.eye(d), sums[:, d])


def isotonic(at: np.ndarray, means: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing levels nearest to ``means``: neighbours that fall are pooled.

    A pool stands at the mean place of its rows, and one more row of either label pulls its level away
    from 0 and 1; between pools scores are interpolated.
    """
    pools: list[tuple[float, float, float]] = []  # weight, weight * mean, weight * place
    for x, mean, weight in zip(at.tolist(), means.tolist(), weights.tolist()):
        pools.append((weight, weight * mean, weight * x))
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last, before = pools.pop(), pools.pop()
            pools.append((before[0] + last[0], before[1] + last[1], before[2] + last[2]))
    n, ones, places = np.array(pools).T
    return places / n, np.maximum.accumulate((ones + 0.5) / (n + 1.0))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels`` (doc_id, quality) from ``stats`` (doc_id, stats).

    All labelled rows count: several labels of a document by their mean and number, null labels and ids
    not at all. Normal equations are summed per partition and part; what reaches the driver is one number
    per cell of a FEATURES square, and for calibration one row per thousandth of a score. Each part's rows
    are scored by the equations of the other part, so calibration sees scores of unseen documents.
    """
    known = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.avg(F.col("quality").cast("double")).alias("y"), F.count("*").cast("double").alias("n"))
    )
    rows = hold(
        stats.join(known, "doc_id").withColumn(
            "part", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(PARTS)).cast("int")
        ),
        "quality-rows",
    )
    numbers = [F.col("stats")[k] for k in range(N_STATS)]
    moments = rows.agg(*[F.avg(c) for c in numbers], *[F.stddev_pop(c) for c in numbers]).first()
    if moments[0] is None:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), None, np.empty(0), np.empty(0))
    center, scale = np.array(moments[:N_STATS]), np.maximum(np.array(moments[N_STATS:]), 1e-6)

    d = FEATURES + 1
    sums = np.zeros((PARTS, d * (d + 1)))
    cells = rows.mapInArrow(_equations(center, scale), "part int, cell int, value double")
    for part, cell, value in cells.groupBy("part", "cell").agg(F.sum("value")).collect():
        sums[part, cell] = value
    sums = sums.reshape(PARTS, d, d + 1)
    whole = sums.sum(axis=0)
    unseen = [_solved(whole - sums[p]) if (whole - sums[p])[0, 0] > 0 else _solved(whole) for p in range(PARTS)]
    model = Model(center, scale, _solved(whole), np.empty(0), np.empty(0))

    def score_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = fourier(_matrix(batch.column("stats")), center, scale)
            raw = (z @ np.stack(unseen, axis=1))[np.arange(len(z)), np.asarray(batch.column("part"))]
            step = np.clip(np.round(raw * SCORE_STEP), -SCORE_STEP, 2 * SCORE_STEP).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {"step": pa.array(step), "y": batch.column("y"), "n": batch.column("n")}
            )

    steps = (
        rows.mapInArrow(score_parts, "step bigint, y double, n double")
        .groupBy("step")
        .agg(F.sum("n").alias("n"), F.sum(F.col("y") * F.col("n")).alias("y"))
        .orderBy("step")
        .collect()
    )
    release(rows)
    n = np.array([s["n"] for s in steps])
    places = np.array([s["step"] for s in steps]) / SCORE_STEP
    return Model(center, scale, model.weights, *isotonic(places, np.array([s["y"] for s in steps]) / n, n))


def scores(stats: Column, model: Model) -> Column:
    """Calibrated score of a statistics column."""

    @F.arrow_udf("double")
    def score(values: pa.Array) -> pa.Array:
        return pa.array(np.clip(model.scores(_matrix(values)), 0.0, 1.0))

    return score(stats)


def learnable(doc_id: Column) -> Column:
    """Labels are learned from ids whose crc32 is not 1 modulo 3; the others are held out."""
    return id_remainder(doc_id, 3) != 1


def all_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row, written once."""
    rows = docs.select(
        column("doc_id").cast("bigint").alias("doc_id"), document_statistics(column("text")).alias("stats")
    )
    return hold(rows, "quality-stats")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on) of every row of ``docs``.

    A score depends on the text alone; null text is the empty text. Equal texts score equally; repeated
    ids and null ids (never held out) are rows like any other. Without a label to learn from every score
    is 0.5. An empty table gives no rows; other columns are ignored.
    """
    stats = all_statistics(docs)
    model = fit(stats.filter(learnable(F.col("doc_id"))), labels)
    scored = stats.select(
        "doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), scores(F.col("stats"), model).alias("score")
    )
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose predicted quality is 1, with their columns."""
    rows = docs.select(
        packed(docs),
        column("doc_id").cast("bigint").alias("doc_id"),
        document_statistics(column("text")).alias("stats"),
    )
    # Statistics cost far more than writing the rows beside them: they are worked out once.
    rows = hold(rows, "quality-documents")
    model = fit(rows.filter(learnable(F.col("doc_id"))).select("doc_id", "stats"), labels)
    return rows.filter(scores(F.col("stats"), model) >= 0.5).select(*unpacked(docs.columns, {}))
