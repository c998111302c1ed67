from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from tillroll.llm import whitening
from tillroll.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, n bigint, component string, `a.b` string"


def frame(spark, vectors: list):
    return spark.createDataFrame([(k, v, 1, "x", "y") for k, v in vectors], SCHEMA)


def fitted(rows: list[tuple]) -> tuple[list[tuple], list[list[int]]]:
    """Kept rows as (vec_id, x), and the distinct x."""
    kept = []
    for vec_id, vector in rows:
        if vector is None or any(c is None or not math.isfinite(c) for c in vector):
            continue
        kept.append((vec_id, tuple(math.floor(256 * float(np.float32(c))) for c in vector)))
    return kept, sorted({x for _, x in kept})


def exact_covariance(fit: list) -> np.ndarray:
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    return np.array(
        [
            [float(Fraction(sum(x[i] * x[j] for x in fit), n) - Fraction(sums[i] * sums[j], n * n)) for j in range(d)]
            for i in range(d)
        ]
    )


def check(rows: list[tuple], got: list, components: int = 4) -> None:
    kept, fit = fitted(rows)
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    values, vectors = np.linalg.eigh(exact_covariance(fit))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == len(kept) * min(components, d)
    assert {r["n"] for r in got} == {n}
    by_key: dict = {}
    for r in got:
        by_key.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = {}
    for vec_id, x in kept:
        mine = by_key[vec_id]
        assert {r["deviation"] for r in mine.values()} == {sum((n * a - s) ** 2 for a, s in zip(x, sums))}
        centred = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, sums)])
        for c in range(min(components, d)):
            expected = centred @ vectors[:, c] / math.sqrt(values[c])
            if abs(expected) > 1e-6:
                sign = signs.setdefault(c, math.copysign(1, expected * mine[c + 1]["whitened"]))
                assert mine[c + 1]["whitened"] * sign == pytest.approx(expected, rel=1e-9, abs=1e-10)
            assert mine[c + 1]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9


def random_rows(n: int, d: int, seed: int = 1) -> list[tuple]:
    random = np.random.default_rng(seed)
    mix = random.normal(size=(d, d))
    return [(k, [float(c) for c in (random.normal(size=d) @ mix + 3).astype(np.float32)]) for k in range(n)]


def test_against_the_definition(spark):
    rows = random_rows(300, 6)
    rows += [(1000 + k, rows[3][1]) for k in range(100)]  # copies weigh nothing
    check(rows, whitening.whiten(frame(spark, rows).repartition(5)).collect())


def test_rows_that_are_no_vector_are_dropped(spark):
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [1.0, float("inf"), 0.0], [1.0, 2.0], [3e38, 1.0, 2.0]]
    rows = random_rows(50, 3)
    got = whitening.whiten(frame(spark, rows + [(500 + k, v) for k, v in enumerate(bad)])).collect()
    check(rows, got)


def test_repeated_and_missing_ids_are_rows_of_their_own(spark):
    rows = random_rows(20, 3)
    got = whitening.whiten(frame(spark, [*rows, (0, rows[0][1]), (None, rows[1][1]), (None, rows[1][1])])).collect()
    assert len(got) == 23 * 3
    assert sum(r["vec_id"] is None for r in got) == 6
    assert len({(r["component"], r["whitened"]) for r in got if r["vec_id"] == 0}) == 3


def test_fewer_dimensions_and_no_spread(spark):
    check(random_rows(30, 2), whitening.whiten(frame(spark, random_rows(30, 2))).collect())
    one = whitening.whiten(frame(spark, [(k, [1.0, 2.0, 3.0]) for k in range(5)])).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {
        (1, 0, None, None, None)
    }
    flat = whitening.whiten(frame(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True), (3, True)}
    assert {r["explained"] for r in flat if r["component"] > 1} == {0.0}
    assert max(r["identity_error"] for r in flat) < 1e-9


def test_empty_tables(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, []), (3, [None])])).collect() == []


def test_numbers_beyond_doubles_stay_exact(spark):
    rows = [(k, [2.0**50 * (k % 7), 2.0**40 * (k % 5), float(k)]) for k in range(40)]
    got = whitening.whiten(frame(spark, rows)).collect()
    _, fit = fitted(rows)
    n, sums = len(fit), [sum(x[k] for x in fit) for k in range(3)]
    kept = dict(fitted(rows)[0])
    for r in got:
        exact = sum((n * a - s) ** 2 for a, s in zip(kept[r["vec_id"]], sums))
        assert r["deviation"] == (exact if exact < 10**38 else None)
    assert max(r["identity_error"] for r in got) < 1e-9


@pytest.mark.parametrize(
    "spectrum",
    [
        [9, 7, 5, 3, 1, 0.5],
        [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5 - 1e-8, 0.1],
        [1, 1 - 1e-13, 1 - 2e-13, 1 - 1e-11, 1e-3, 1e-6],
        [1, 1, 1, 0.5, 0.5, 0],
        [1e12, 1, 1 - 1e-6, 1e-6, 0, 0],
    ],
    ids=["apart", "close", "closer", "equal", "wide"],
)
def test_eigenvectors_in_high_precision(spectrum):
    n = len(spectrum)
    high = np.longdouble
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(n, n)))
    q = q.astype(high)
    for _ in range(4):
        q = q @ (3 * np.eye(n, dtype=high) - q.T @ q) / 2
    a = q @ np.diag(np.array(spectrum, high)) @ q.T
    a = (a + a.T) / 2
    values, x = whitening.eigenvectors(a)
    size = float(max(spectrum))
    assert np.abs(values - np.array(spectrum, high)).max() <= 1e-17 * size
    assert np.abs(x.T @ x - np.eye(n)).max() <= 1e-17
    assert np.abs(a @ x - x * values).max() <= 1e-17 * size
    # A vector is as sharp as extended precision and the gap to its neighbours allow; equal values share a space.
    for k in range(n):
        gap = min(abs(spectrum[k] - s) for j, s in enumerate(spectrum) if j != k)
        if gap:
            sign = np.sign(q[:, k] @ x[:, k])
            assert np.abs(x[:, k] * sign - q[:, k]).max() <= 1e-17 + 1e-17 * size / gap


def test_query_is_exact_and_white(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(rows, QUERIES["op13_whitening"](spark, sf_dir).collect())
