"""Whitening of embeddings: principal components of their exact covariance, to double precision.

Entries become integers, so sums and products add up exactly whatever the order of tasks; products are matrix
multiplications of centred rows, blocked so that no sum of doubles passes 2^53. The eigenvectors start in
float32 and are corrected by matrix multiplications in extended precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import column
from tillroll.sources.scratch import hold, release

SCALE = 256
COMPONENTS = 4

# Exact whole numbers of doubles end here.
EXACT = 1 << 53
# Sums travel as so many limbs of 30 bits, the last with the sign; Spark adds each up as a bigint.
LIMBS, LIMB_BITS = 6, 30
LIMB_NAMES = [f"l{k}" for k in range(LIMBS)]
LIMB_SCHEMA = ", ".join(f"{n} bigint" for n in LIMB_NAMES)

# Corrections of the eigenvectors: each about squares their error, so few are needed.
MOST_ROUNDS = 24
# Gaps of so many times the rounding are left to the solves within clusters.
NARROW = 1000
HIGH = np.longdouble


# Vectors as bytes: one for the width of an entry, then the entries, as narrow as the vector allows.


def _packed_vector(x: np.ndarray) -> bytes:
    most = int(np.abs(x).max()) if len(x) else 0
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _unpacked_vectors(values: pa.Array, dims: int) -> np.ndarray:
    """Rows of int64 of packed vectors that all have ``dims`` entries."""
    raw = values.to_pylist()
    out = np.empty((len(raw), dims), np.int64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        bytes_ = np.frombuffer(b"".join([raw[k] for k in rows]), np.uint8).reshape(len(rows), size)
        width = (size - 1) // dims
        out[rows] = np.ascontiguousarray(bytes_[:, 1:]).view(f"<i{width}")
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, vector, dims) of the rows whose vectors are whole and finite."""
    for batch in batches:
        vectors = batch.column(1)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        lengths = np.array(vectors.value_lengths().fill_null(0))
        ends = np.cumsum(lengths)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(flat * SCALE) + 0.0
            fits = np.abs(x) < 2.0**63
        bad = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(~fits, out=bad[1:])
        keep = (bad[ends] == bad[ends - lengths]) & np.array(vectors.is_valid()) & (lengths > 0)
        x = np.where(fits, x, 0).astype(np.int64)
        rows = np.flatnonzero(keep)
        packed = [_packed_vector(x[ends[k] - lengths[k] : ends[k]]) for k in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows)), pa.array(packed, pa.binary()), pa.array(lengths[rows], pa.int32())],
            names=["vec_id", "vector", "dims"],
        )


def _limbs(numbers: np.ndarray) -> list[pa.Array]:
    """Whole numbers, int64 or Python's, cut into limbs."""
    out = []
    for k in range(LIMBS):
        out.append(pa.array((numbers & ((1 << LIMB_BITS) - 1) if k < LIMBS - 1 else numbers).astype(np.int64)))
        numbers = numbers >> LIMB_BITS
    return out


def _from_limbs(row) -> int:
    return sum(int(row[name]) << (LIMB_BITS * k) for k, name in enumerate(LIMB_NAMES))


def _sums(dims: int):
    """(i, limbs): per dimension the sum of its entries in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpacked_vectors(batch.column(0), dims)
            if float(np.abs(x.astype(np.float64)).max()) * len(x) >= 2.0**62:
                x = x.astype(object)
            total = x.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), *_limbs(total)], names=["i", *LIMB_NAMES])

    return run


def _products(dims: int, centre: list[int]):
    """(i, j, limbs) for i <= j: sums over a task's rows of products of entries less ``centre``."""
    upper = np.triu_indices(dims)

    def flushed(total: np.ndarray) -> pa.RecordBatch:
        places = [pa.array(side.astype(np.int32)) for side in upper]
        return pa.RecordBatch.from_arrays([*places, *_limbs(total[upper])], names=["i", "j", *LIMB_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bound = np.zeros((dims, dims), np.int64), 0
        for batch in batches:
            x = _unpacked_vectors(batch.column(0), dims)
            if not len(x):
                continue
            most = int(np.abs(x.astype(object)).max()) + max(map(abs, centre))
            if most >= 1 << 26:
                # One product alone may pass 2^53: whole numbers of any size.
                z = x.astype(object) - np.array(centre, object)
                yield flushed(z.T.dot(z))
                continue
            z = x.astype(np.float64) - np.array(centre, np.float64)
            step = max(1, (EXACT - 1) // max(1, most * most))
            for at in range(0, len(z), step):
                block = z[at : at + step]
                if bound + len(block) * most * most >= 1 << 62:
                    yield flushed(total)
                    total, bound = np.zeros((dims, dims), np.int64), 0
                total += (block.T @ block).astype(np.int64)
                bound += len(block) * most * most
        if bound:
            yield flushed(total)

    return run


def _high(number: int) -> np.longdouble:
    """A whole number in extended precision, not by way of a double."""
    result, rest = HIGH(0), number
    for _ in range(3):
        part = float(rest)
        result += HIGH(part)
        rest -= int(part)
    return result


def eigenvectors(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, in its own precision.

    Ogita and Aishima's iteration: with R = I - X'X and S = X'AX, the first-order correction E of the
    vectors follows from S and R entry by entry, and X + XE has about the square of the error. Where two
    eigenvalues are nearer than what S and R still leave open, E only makes the vectors orthogonal, and the
    vectors of the whole cluster are turned by the eigenvectors of their own small matrix, less its mean
    eigenvalue; that shift is what brings out the differences float32 could not see.
    """
    a = covariance.astype(HIGH)
    n = len(a)
    size = HIGH(np.abs(a).max()) if n else HIGH(0)
    if not size:
        return np.zeros(n, HIGH), np.eye(n, dtype=HIGH)
    a = a / size
    noise = n * np.finfo(HIGH).eps
    _, x = np.linalg.eigh(a.astype(np.float32))
    x = x[:, ::-1].astype(HIGH)
    one = np.eye(n, dtype=HIGH)
    for _ in range(MOST_ROUNDS):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        # Evenly rounded, so that whatever a small gap makes of the rounding turns the vectors and no more.
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, r, s, values = x[:, order], r[order][:, order], s[order][:, order], values[order]
        open_ = 2 * (_norm(s - np.diag(values)) + _norm(a) * _norm(r)) + NARROW * noise
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= open_
        correction = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ correction
        turned = HIGH(0)
        for first, last in _runs(values, open_):
            turned = max(turned, _turn(a, x, first, last, noise))
        if turned <= 4 * noise and np.all(np.abs(correction) <= 4 * noise / np.minimum(1, np.where(near, 1, np.abs(gap)))):
            break
    for _ in range(2):
        # What rounding over a small gap left, squared.
        x = x @ (3 * one - x.T @ x) / 2
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order]


def _norm(matrix: np.ndarray) -> np.longdouble:
    """The largest row sum: no less than the spectral norm of a symmetric matrix."""
    return np.abs(matrix).sum(axis=1).max()


def _runs(values: np.ndarray, open_: np.longdouble) -> Iterator[tuple[int, int]]:
    """Clusters [first, last) of two and more falling values whose neighbours are no further apart than ``open_``."""
    first = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k - 1] - values[k] > open_:
            if k - first > 1:
                yield first, k
            first = k


def _turn(a: np.ndarray, x: np.ndarray, first: int, last: int, noise: np.longdouble) -> np.longdouble:
    """Turns the columns [first, last) of ``x`` to the eigenvectors within their span; how far they were off."""
    own = x[:, first:last]
    size = last - first
    small = own.T @ (a @ own)
    small = (small + small.T) / 2
    small = small - np.eye(size, dtype=HIGH) * (np.trace(small) / size)
    scale = np.abs(small).max()
    apart = np.abs(small - np.diag(np.diag(small))).max()
    if apart <= 4 * noise:
        # Nothing but rounding: one eigenvalue, for which any basis serves.
        return HIGH(0)
    _, q = np.linalg.eigh((small / scale).astype(np.float32))
    q = q[:, ::-1].astype(HIGH)
    for _ in range(3):
        q = q @ (3 * np.eye(size, dtype=HIGH) - q.T @ q) / 2
    x[:, first:last] = own @ q
    return apart


@dataclass
class Whitener:
    """What every row is projected with: fit size, centre, remainders, directions and their eigenvalues."""

    dims: int
    n: int
    centre: list[int]
    rest: list[int]  # S - n * centre
    vectors: np.ndarray  # dims x components
    values: list[float]
    explained: list[float | None]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values (rows x components); equal rows give equal bits, as sums run in one order."""
        z = (x - np.array(self.centre, np.int64)).astype(np.float64)
        z -= np.array([d / self.n for d in self.rest])
        out = np.zeros((len(x), len(self.values)))
        for c, value in enumerate(self.values):
            for k in range(self.dims):
                out[:, c] += z[:, k] * self.vectors[k, c]
            out[:, c] = out[:, c] / np.sqrt(value) if value > 0 else np.nan
        return out

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over the dimensions of (n x - S)^2, exact: n^2 z.z - 2 n z.D + D.D of z = x - centre."""
        most = float(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, self.centre))
        kind = np.int64 if self.dims * most * max(most, max(map(abs, self.rest))) < 2.0**62 else object
        z = x.astype(kind) - np.array(self.centre, kind)
        rest = np.array(self.rest, kind)
        squares, crosses, own = (z * z).sum(axis=1), (z * rest).sum(axis=1), sum(d * d for d in self.rest)
        n = self.n
        return [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, crosses)]


def _whitener(fit: DataFrame, dims: int, n: int, components: int) -> Whitener:
    vectors = fit.filter(F.col("dims") == dims).select("vector")
    limbs = [F.sum(name).alias(name) for name in LIMB_NAMES]
    sums = {
        r["i"]: _from_limbs(r)
        for r in vectors.mapInArrow(_sums(dims), f"i int, {LIMB_SCHEMA}").groupBy("i").agg(*limbs).collect()
    }
    centre = [(2 * sums[k] + n) // (2 * n) for k in range(dims)]
    rest = [sums[k] - n * centre[k] for k in range(dims)]
    products = vectors.mapInArrow(_products(dims, centre), f"i int, j int, {LIMB_SCHEMA}").groupBy("i", "j").agg(*limbs)
    covariance = np.zeros((dims, dims), HIGH)
    square = _high(n * n)
    trace = 0
    for row in products.collect():
        i, j = row["i"], row["j"]
        exact = n * _from_limbs(row) - rest[i] * rest[j]
        covariance[i, j] = covariance[j, i] = _high(exact) / square
        trace += exact if i == j else 0
    values, x = eigenvectors(covariance)
    count = min(components, dims)
    x = x[:, :count]
    largest = np.abs(x).argmax(axis=0)
    x = x * np.sign(x[largest, np.arange(count)])
    # Rounding alone may leave a value a little above zero where there is no spread at all.
    least = dims * np.finfo(np.float64).eps * float(values[0]) if dims else 0.0
    kept = [float(v) if float(v) > least else 0.0 for v in values[:count]]
    total = _high(trace) / square
    explained = [float(HIGH(v) / total) if trace else None for v in kept]
    return Whitener(dims, n, centre, rest, x.astype(np.float64), kept, explained)


def _whitened_products(whitener: Whitener):
    """(a, b, total) for components a <= b: sums of products of whitened values over a batch."""
    live = [c for c, v in enumerate(whitener.values) if v > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = whitener.project(_unpacked_vectors(batch.column(0), whitener.dims))[:, live]
            pairs = [(a, b) for a in range(len(live)) for b in range(a, len(live))]
            totals = [float((y[:, a] * y[:, b]).sum()) for a, b in pairs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int32()), pa.array(totals, pa.float64())],
                names=["a", "b", "total"],
            )

    return run


def _rows(whitener: Whitener, identity_error: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(whitener.values)
        for batch in batches:
            x = _unpacked_vectors(batch.column(1), whitener.dims)
            y = whitener.project(x)
            most = 10**38
            deviations = [d if d < most else None for d in whitener.deviations(x)]
            for c in range(count):
                rows = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([c + 1] * rows, pa.int32()),
                        pa.array([whitener.n] * rows, pa.int64()),
                        pa.array(deviations, pa.decimal128(38, 0)),
                        pa.array(y[:, c], from_pandas=True),
                        pa.array([whitener.explained[c]] * rows, pa.float64()),
                        pa.array([identity_error] * rows, pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


SCHEMA = (
    "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
    "identity_error double"
)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component.

    Rows whose vector is null, empty or has an entry that is null, not finite or beyond a long at ``SCALE``
    are dropped. Vectors are of one length; if they are not, those of the length most distinct vectors have
    stay (of equal ones the least). The components are fit on each distinct vector once, so copies, however
    many, weigh nothing; n is the number of distinct vectors. A repeated row is a row of its own, a null vec_id
    stays null. Where a component has no spread whitened is null and explained zero (null if nothing has
    any), and it takes no part in identity_error. deviation is exact up to 38 digits, beyond them null. Fewer
    dimensions than ``components`` give as many components. An empty table gives no rows. Other columns are
    ignored.

    The driver holds a square matrix of the dimensions, nothing that grows with the rows.
    """
    packed = embeddings.select(
        column("vec_id").cast("bigint").alias("vec_id"), column("embedding").cast("array<double>").alias("vector")
    ).mapInArrow(_whole, "vec_id bigint, vector binary, dims int")
    fit = hold(packed.select("vector", "dims").distinct(), "whitening-fit")
    sizes = fit.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    if not sizes:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    dims, n = sizes[0]
    whitener = _whitener(fit, dims, n, components)
    found = (
        fit.filter(F.col("dims") == dims)
        .select("vector")
        .mapInArrow(_whitened_products(whitener), "a int, b int, total double")
        .groupBy("a", "b")
        .agg(F.sum("total").alias("total"))
        .collect()
    )
    # Rows are centred by S/n exactly, so the mean of whitened values is zero.
    errors = [abs(r["total"] / n - (1.0 if r["a"] == r["b"] else 0.0)) for r in found]
    release(fit)
    rows = packed.filter(F.col("dims") == dims).select("vec_id", "vector")
    return rows.mapInArrow(_rows(whitener, max(errors) if errors else None), SCHEMA)
