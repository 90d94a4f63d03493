"""Whitening of embeddings by their leading components, found by spectrum slicing.

Components of vectors become whole numbers, so sums and the covariance are exact; they are added up where
vectors are read, after the nearest whole number to the mean is taken away. The covariance of one length of vectors is a
small matrix, whose leading eigenvalues are isolated one by one: the inertia of a shifted matrix, read off
the pivots of its LDLᵀ factors, counts the eigenvalues above the shift. In an interval that holds
just one of them Rayleigh quotient iteration converges cubically, and counts on both sides of
the value found certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorcast.llm.vectors import usable
from sensorcast.staging import stage

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
LENGTHS = 1_000  # a table with vectors of more different lengths is an error: each has a matrix of its own
_ALPHA = (1 + np.sqrt(17)) / 8  # limits the growth of pivots
_LONG = 1 << 63


# The eigenvalues of a symmetric matrix


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``matrix`` are larger than ``shift``: the positive ones of the
    block-diagonal factor D of matrix - shift = LDLᵀ, by Sylvester's law of inertia. Pivots of one or
    two rows are chosen as Bunch and Kaufman do, so that the factors do not grow."""
    rest = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(rest):
        column = np.abs(rest[1:, 0])
        largest = column.max(initial=0.0)
        if largest == 0.0:
            positive += rest[0, 0] > 0
            rest = rest[1:, 1:]
            continue
        pair = False
        if abs(rest[0, 0]) < _ALPHA * largest:
            r = 1 + int(column.argmax())
            others = np.abs(rest[r])
            others[r] = 0.0
            if abs(rest[0, 0]) * others.max() < _ALPHA * largest * largest:
                pair = abs(rest[r, r]) < _ALPHA * others.max()
                to = 1 if pair else 0
                if r != to:
                    rest[[to, r]] = rest[[r, to]]
                    rest[:, [to, r]] = rest[:, [r, to]]
        if pair:
            block, side = rest[:2, :2], rest[2:, :2]
            positive += 1  # such a block has one eigenvalue on either side of zero
            rest = rest[2:, 2:] - side @ np.linalg.solve(block, side.T)
        else:
            positive += rest[0, 0] > 0
            rest = rest[1:, 1:] - np.outer(rest[1:, 0], rest[1:, 0] / rest[0, 0])
    return positive


def _solve(matrix: np.ndarray, shift: float, vector: np.ndarray, spread: float) -> np.ndarray:
    eye = np.eye(len(matrix))
    while True:
        try:
            out = np.linalg.solve(matrix - shift * eye, vector)
        except np.linalg.LinAlgError:
            out = np.full(len(vector), np.inf)
        if np.isfinite(out).all():
            return out / np.linalg.norm(out)
        shift += spread  # the shift is an eigenvalue to the last digit


def _orthogonal(vector: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            vector = vector - (vector @ other) * other
    return vector / np.linalg.norm(vector)


def leading(matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as rows): the ``most`` largest eigenvalues that are above zero by more than rounding, falling,
    and their unit eigenvectors. Eigenvalues that are equal to the last digits have an orthogonal set of
    vectors of their space."""
    n = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    tiny = 4 * n * np.finfo(float).eps * norm
    if norm == 0.0:
        return np.empty(0), np.empty((0, n))
    start = np.random.default_rng(0).normal(size=n)
    values, vectors = [], []
    known = {}  # counts by shift

    def above(shift: float) -> int:
        if shift not in known:
            known[shift] = count_above(matrix, shift)
        return known[shift]

    total = min(most, above(tiny))
    while len(values) < total:
        number = len(values) + 1
        # The tightest known limits with at least this many, and fewer, eigenvalues above them.
        low = max((s for s, c in known.items() if c >= number), default=tiny)
        high = min((s for s, c in known.items() if c < number), default=norm + tiny)
        while above(low) - (above(high) if high <= norm else 0) > 1 and high - low > tiny:
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= number else (low, middle)
        held = above(low) - (above(high) if high <= norm else 0)
        if held > 1:
            # As good as equal: each next vector is sought beside those found.
            group: list[np.ndarray] = []
            for k in range(min(held, total - len(values))):
                vector = _orthogonal(np.roll(start, k), group)
                for _ in range(4):
                    vector = _orthogonal(_solve(matrix, (low + high) / 2, vector, tiny), vectors + group)
                group.append(vector)
                values.append(float(vector @ matrix @ vector))
            vectors += group
            continue
        while True:
            vector = _orthogonal(start, vectors)
            shift = (low + high) / 2
            for _ in range(3):  # towards the one eigenvalue that is near the middle
                vector = _solve(matrix, shift, vector, tiny)
            for _ in range(12):
                value = float(vector @ matrix @ vector)
                left = np.linalg.norm(matrix @ vector - value * vector)
                if left <= tiny / 4:
                    break
                vector = _solve(matrix, value, vector, tiny)
            certain = low - tiny <= value <= high + tiny and left <= tiny
            if certain and above(value - 2 * tiny) >= number and above(value + 2 * tiny) < number:
                break
            if high - low <= tiny:
                raise ArithmeticError(f"eigenvalue {number} could not be certified")
            middle = (low + high) / 2  # it went to another eigenvalue: come closer first
            low, high = (middle, high) if above(middle) >= number else (low, middle)
        # Once more, so that the vector is as good as the value, and free of those before it.
        vector = _orthogonal(_solve(matrix, value, vector, tiny), vectors)
        vectors.append(vector)
        values.append(float(vector @ matrix @ vector))
    return np.array(values), np.array(vectors).reshape(-1, n)


# The covariance of a table of vectors


@dataclass(frozen=True)
class Fit:
    """What the vectors of one length have in common: their number, exact sums per dimension, eigenvalues,
    unit eigenvectors as rows, and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole_numbers(vector: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) + OFFSET as long; an error where a long cannot hold it."""
    scaled = np.floor(SCALE * vector)
    if not (np.abs(scaled) < 2.0**62).all():
        raise OverflowError("a component is too large for a whole number of 64 bits")
    return scaled.astype(np.int64) + OFFSET


def _matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, whole numbers) for each length of usable vectors."""
    found: dict[int, list] = {}
    for n, vector in usable(batch.column(column)):
        found.setdefault(len(vector), []).append((n, whole_numbers(vector)))
    for length, rows in found.items():
        yield length, np.array([n for n, _ in rows]), np.array([x for _, x in rows])


def _cells(totals: dict) -> Iterator[pa.RecordBatch]:
    """Sums by (length, row, column) as text of any number of digits."""
    for length, (count, cells) in totals.items():
        shape = np.shape(cells)
        at = np.indices(shape).reshape(len(shape), -1)
        if len(shape) == 2:
            keep = at[0] <= at[1]
            at, cells = at[:, keep], cells[keep.reshape(shape)]
        else:
            at = np.stack([at[0], np.full(len(at[0]), -1)])
        size = at.shape[1]
        for begin in range(0, size, 100_000):
            part = slice(begin, begin + 100_000)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at[0][part]), length), pa.int32()),
                    pa.array(at[0][part], pa.int32()),
                    pa.array(at[1][part], pa.int32()),
                    pa.array(np.full(len(at[0][part]), count), pa.int64()),
                    pa.array([str(int(c)) for c in cells[part]], pa.string()),
                ],
                names=["dim", "i", "j", "n", "total"],
            )


def _added(partial: DataFrame) -> list:
    """Sums over all tasks, exact in 38 digits; a row per cell of the matrices, whose size the lengths bound."""
    exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    return partial.groupBy("dim", "i", "j").agg(F.sum("n").alias("n"), exact).collect()


def _products(z: np.ndarray) -> np.ndarray:
    """Sum of z zᵀ over the rows, exact. Doubles are multiplied fast and add whole numbers below 2**53 exactly."""
    top = int(np.abs(z).max(initial=0))
    if top >= 1 << 26:
        wide = z.astype(object)
        return wide.T @ wide
    rows = max(1, (1 << 53) // max(1, top * top))
    out = np.zeros((z.shape[1], z.shape[1]), object)
    for at in range(0, len(z), rows):
        part = z[at : at + rows].astype(float)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def fit(embeddings: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The leading components of all usable vectors, by length: two passes over the table, from which
    come only sums; the covariance is centred before multiplying and exact up to one rounding."""
    vectors = embeddings.select(F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "dim int, i int, j int, n long, total string"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            for length, _, x in _matrices(batch, 0):
                count, before = totals.get(length, (0, 0))
                totals[length] = count + len(x), before + x.astype(object).sum(axis=0)
        yield from _cells(totals)

    counts: dict[int, int] = {}
    first: dict[int, list[int]] = {}
    for row in sorted(_added(vectors.mapInArrow(sums, schema)), key=lambda r: (r["dim"], r["i"])):
        counts[row["dim"]] = row["n"]
        first.setdefault(row["dim"], []).append(int(row["total"]))
    if len(counts) > LENGTHS:
        raise ValueError(f"vectors of {len(counts)} different lengths")
    means = {d: np.array([(2 * s + counts[d]) // (2 * counts[d]) for s in all_], np.int64) for d, all_ in first.items()}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            for length, _, x in _matrices(batch, 0):
                count, before = totals.get(length, (0, 0))
                totals[length] = count + len(x), before + _products(x - means[length])
        yield from _cells(totals)

    squares = {d: np.zeros((d, d), object) for d in counts}
    for row in _added(vectors.mapInArrow(products, schema)):
        squares[row["dim"]][row["i"], row["j"]] = squares[row["dim"]][row["j"], row["i"]] = int(row["total"])
    out = {}
    for d, n in counts.items():
        off = np.array([s - n * int(m) for s, m in zip(first[d], means[d])], object)  # what the rounded means leave
        above = n * squares[d] - np.outer(off, off)
        cov = np.array([[c / (n * n) for c in line] for line in above], float).reshape(d, d)
        values, vectors_ = leading(cov, components)
        trace = sum(above[k, k] for k in range(d)) / (n * n)
        out[d] = Fit(n, tuple(first[d]), values, vectors_, trace)
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each usable row along each component.

    Entries become x = floor(1024 * c) + 100000. ``whitened`` is x less the mean on a unit eigenvector of the
    covariance, over the root of its eigenvalue; components are numbered from 1 by falling eigenvalue. ``deviation`` is
    the sum over dimensions of (n * x - S)², exact; ``explained`` the eigenvalue's part of the trace; ``identity_error``
    the largest entry of the covariance of ``whitened`` less the identity, measured on the result.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped. Vectors of
    different length are fitted and measured apart. Eigenvalues that are zero up to rounding have no component, so equal
    vectors, or a single one, give no rows. Each of repeated rows counts; a null vec_id stays null. Numbers that a long cannot
    hold are an error. Other columns are ignored; an empty table gives no rows.
    """
    fits = fit(embeddings, components)
    dims = pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, x in _matrices(batch, 1):
                model = fits[length]
                n, sums = model.n, model.sums
                if max(abs(n * int(v) - s) for k, s in enumerate(sums) for v in (x[:, k].min(), x[:, k].max())) < 1 << 31 and length < 1 << 30:
                    apart = n * x - np.array(sums, np.int64)
                    deviation = (apart.astype(object) ** 2).sum(axis=1) if length * float(np.abs(apart).max()) ** 2 >= 2.0**62 else np.square(apart).sum(axis=1)
                else:
                    apart = n * x.astype(object) - np.array(sums, object)
                    deviation = (apart**2).sum(axis=1)
                if max(deviation) >= _LONG:
                    raise OverflowError("a deviation is too large for a long")
                centred = np.array(apart / n, float)
                along = centred @ model.vectors.T / np.sqrt(model.values)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        pa.array(np.full(len(rows), length), dims),
                        pa.array([int(v) for v in deviation], pa.int64()),
                        pa.array(along.tolist(), pa.list_(pa.float64())),
                    ],
                    names=["vec_id", "dim", "deviation", "along"],
                )

    columns = F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    rows = stage(embeddings.select(*columns).mapInArrow(run, "vec_id long, dim int, deviation long, along array<double>"), "whitened")
    at = [F.get("along", F.lit(k)) for k in range(components)]
    means = rows.groupBy("dim").agg(*[F.avg(a).alias(f"m{k}") for k, a in enumerate(at)])
    centred = rows.join(F.broadcast(means), "dim")
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    cells = [F.avg((at[i] - F.col(f"m{i}")) * (at[j] - F.col(f"m{j}"))) - (1.0 if i == j else 0.0) for i, j in pairs]
    errors = centred.groupBy("dim").agg(F.greatest(*[F.coalesce(F.abs(c), F.lit(0.0)) for c in cells]).alias("identity_error"))
    facts = [(d, k + 1, f.n, float(v / f.trace)) for d, f in fits.items() for k, v in enumerate(f.values)]
    spark = embeddings.sparkSession
    known = spark.createDataFrame(facts, "dim int, component int, n long, explained double")
    long = rows.select("vec_id", "dim", "deviation", F.posexplode("along").alias("component", "whitened"))
    long = long.withColumn("component", F.col("component") + 1)
    # Both tables have a row or a few per length of vectors.
    return (
        long.join(F.broadcast(known), ["dim", "component"])
        .join(F.broadcast(errors), "dim")
        .select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    )
