"""Whitening against dense linear algebra and exact fractions."""

from fractions import Fraction

import numpy as np
import pytest
from llm_data import workers  # noqa: F401

from sensorcast.llm import whitening


def symmetric(rnd, n, kind):
    q, _ = np.linalg.qr(rnd.normal(size=(n, n)))
    values = [
        lambda: rnd.uniform(0, 1, n),
        lambda: np.round(rnd.uniform(0, 3, n)),  # many equal ones
        lambda: np.full(n, 2.0),
        lambda: np.where(rnd.random(n) < 0.5, 0, rnd.random(n)),
        lambda: rnd.normal(size=n),
    ][kind]()
    made = (q * values) @ q.T
    return (made + made.T) / 2


@pytest.mark.parametrize("kind", range(5))
def test_inertia_counts(kind):
    rnd = np.random.default_rng(kind)
    for n in (1, 2, 3, 7, 20, 40):
        matrix = symmetric(rnd, n, kind)
        values = np.linalg.eigvalsh(matrix)
        for shift in [*rnd.uniform(-2, 3, 8), 0.5, 1.5]:
            if np.abs(values - shift).min() > 1e-9:
                assert whitening.count_above(matrix, shift) == (values > shift).sum()
    zero_diagonal = np.array([[0.0, 1, 0], [1, 0, 0], [0, 0, 0]])
    assert whitening.count_above(zero_diagonal, 0.0) == 1


@pytest.mark.parametrize("kind", range(5))
def test_leading_eigenvalues(kind):
    rnd = np.random.default_rng(10 + kind)
    for n in (1, 2, 5, 12, 33, 64):
        matrix = symmetric(rnd, n, kind)
        norm = np.abs(matrix).sum(axis=1).max()
        values, vectors = whitening.leading(matrix)
        want = np.linalg.eigvalsh(matrix)[::-1]
        assert len(values) == min(8, (want > 1e-13 * norm).sum())
        assert np.allclose(values, want[: len(values)], rtol=0, atol=1e-13 * n * norm)
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-9)
        assert np.abs(matrix @ vectors.T - vectors.T * values).max(initial=0) <= 1e-13 * n * norm


def test_close_eigenvalues_are_told_apart():
    rnd = np.random.default_rng(3)
    q, _ = np.linalg.qr(rnd.normal(size=(30, 30)))
    want = np.concatenate([5 - 1e-9 * np.arange(4), 4 - 1e-12 * np.arange(4), np.linspace(3, 0, 22)])
    values, vectors = whitening.leading((q * want) @ q.T)
    assert np.allclose(values, want[:8], rtol=0, atol=1e-13)
    assert np.allclose(vectors @ vectors.T, np.eye(8), atol=1e-9)


def plain(vectors):
    """n, deviations, projections and so on by definition: exact fractions, then NumPy's solver."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    deviation = [sum((n * r[k] - sums[k]) ** 2 for k in range(d)) for r in x]
    apart = np.array([[float(Fraction(n * r[k] - sums[k], n)) for k in range(d)] for r in x])
    cov = apart.T @ apart / n
    values, basis = np.linalg.eigh(cov)
    return deviation, apart, values[::-1], basis.T[::-1], np.trace(cov)


def check(rows, vectors):
    deviation, apart, values, basis, trace = plain(vectors)
    along = np.array([[r["whitened"] for r in rs] for rs in rows])
    count = along.shape[1]
    for rs, own in zip(rows, deviation):
        assert [r["component"] for r in rs] == list(range(1, count + 1))
        assert all(r["n"] == len(vectors) and r["deviation"] == own for r in rs)
        assert all(abs(r["explained"] - values[k] / trace) <= 1e-12 for k, r in enumerate(rs))
    for k in range(count):
        want = apart @ basis[k] / np.sqrt(values[k])
        want *= np.sign(want @ along[:, k])
        assert np.allclose(along[:, k], want, atol=1e-7)
    error = np.abs(along.T @ along / len(along) - np.eye(count)).max()
    assert error <= 1e-9
    assert all(abs(r["identity_error"] - error) <= 1e-9 for rs in rows for r in rs)


def by_vector(frame):
    out = {}
    for r in frame.orderBy("vec_id", "component").collect():
        out.setdefault(r["vec_id"], []).append(r)
    return out


@pytest.mark.parametrize("scale", [1.0, 1e-3, 300.0])
def test_whitening(workers, scale):
    rnd = np.random.default_rng(1)
    base = (rnd.normal(size=(150, 12)) * np.linspace(2, 0.5, 12) + 5) * scale
    vectors = [[float(np.float32(c)) for c in v] for v in base]
    rows = [(n, v, 7) for n, v in enumerate(vectors)]
    bad = [(900, None, 1), (901, [], 1), (902, [None] + [1.0] * 11, 1), (903, [float("nan")] * 12, 1), (904, [float("inf")] + [0.0] * 11, 1)]
    frame = workers.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n int").repartition(5)
    got = by_vector(whitening.whiten(frame))
    assert sorted(got) == list(range(150))
    check([got[n] for n in range(150)], vectors)


def test_large_numbers(workers):
    vectors = [[3e9 * (n % 3), 1e10 + n, float(n * n)] for n in range(6)]
    frame = workers.createDataFrame([(n, v) for n, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame)
    small = [[4e4 * (n % 3), 1e5 + n, float(n * n)] for n in range(6)]
    frame = workers.createDataFrame([(n, v) for n, v in enumerate(small)], "vec_id long, embedding array<double>")
    got = by_vector(whitening.whiten(frame))
    check([got[n] for n in range(6)], small)


def test_odd_tables(workers):
    schema = "vec_id long, embedding array<float>, component int, dim int"
    make = lambda rows: workers.createDataFrame([(i, v, 0, 0) for i, v in rows], schema)
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0])])).count() == 0  # no spread
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = [[float(n), 2.0 * n, 1.0] for n in range(5)]  # all on a line: one component
    got = by_vector(whitening.whiten(make(list(enumerate(line)))))
    check([got[n] for n in range(5)], line)
    assert len(got[0]) == 1
    # Two lengths, a repeated row and a missing identifier.
    rows = [(n, [float(n % 4), float(n % 3)]) for n in range(12)] + [(3, [3.0, 0.0]), (None, [9.0, 1.0])]
    others = [(100 + n, [float(n), 0.0, float(n * n)]) for n in range(4)]
    got = by_vector(whitening.whiten(make(rows + others)))
    assert len(got[3]) == 4 and len(got[None]) == 2 and got[0][0]["n"] == 14 and got[100][0]["n"] == 4
    check([got[100 + n] for n in range(4)], [v for _, v in others])
