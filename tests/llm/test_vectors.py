"""Vector operators against full scans."""

import numpy as np
import pytest
from conftest import rows_of
from llm_data import workers  # noqa: F401
from pyspark.sql import functions as F

from sensorcast.llm import near_vectors, topk
from sensorcast.llm.components import components


@pytest.fixture(scope="module")
def embeddings(workers):
    rnd = np.random.default_rng(5)
    rows = []
    for n in range(400):
        if n % 5 < 2 and n > 10:
            vector = np.array(rows[n - 7][1]) + rnd.normal(0, 0.02, 16)
            label = rows[n - 7][2]
        else:
            vector, label = rnd.normal(0, 0.3, 16), n % 3
        rows.append((n, vector.tolist(), label, "x"))
    rows += [
        (400, None, 1, "x"),
        (401, [], 1, "x"),
        (402, [0.0] * 16, 1, "x"),
        (403, [float("nan")] + [1.0] * 15, 1, "x"),
        (404, [None] + [1.0] * 15, 1, "x"),
        (405, [float("inf")] + [1.0] * 15, 1, "x"),
        (420, rows[3][1], None, "x"),  # no label
        (440, rows[3][1], rows[3][2], "x"),  # an exact copy
        (460, [1.0, 2.0, 3.0], 1, "x"),  # of another length
        (480, [1.0, 2.0, 3.5], 1, "x"),
        (None, rows[3][1], rows[3][2], "x"),
    ]
    frame = workers.createDataFrame(rows, "vec_id long, embedding array<float>, label int, links string")
    return frame, [(i, None if v is None else np.array([np.nan if x is None else np.float32(x) for x in v], float), g) for i, v, g, _ in rows]


def fit(rows):
    return [(i, v, g) for i, v, g in rows if i is not None and v is not None and len(v) and np.isfinite(v).all()]


@pytest.mark.parametrize("sizes", [None, (7, 40, 16, 3)])
def test_top_k(embeddings, sizes, monkeypatch):
    frame, rows = embeddings
    if sizes:
        for name, value in zip(("CHUNK", "GROUP", "TILE", "STEP"), sizes):
            monkeypatch.setattr(topk, name, value)
    want = []
    for q, x, _ in fit(rows):
        if q % 20 == 0:
            near = [
                (-int(np.floor(64 * x) @ np.floor(64 * y)), i) for i, y, _ in fit(rows) if i != q and len(x) == len(y)
            ]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(near)[:20])]
    assert sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0).collect()) == sorted(want)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_large_numbers(workers):
    rows = [(0, [5e6, 0.0]), (1, [5e6, 1.0]), (2, [1e15, 1.0]), (20, [-3e6, 2.0]), (21, [-3e6, 2.5]), (40, [1.0, -1e9])]
    frame = workers.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i != 2}
    want = []
    for q in (0, 20, 40):
        near = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    got = topk.top_k(frame.filter("vec_id <> 2"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in got) == want
    assert (0, 1, 1, 102400000000000000) in want
    with pytest.raises(Exception, match="too large"):
        topk.top_k(frame, F.col("vec_id") % 20 == 0).collect()
    with pytest.raises(Exception, match="too large"):
        topk.top_k(frame.limit(0).union(workers.createDataFrame([(0, [1e40])], frame.schema)), F.col("vec_id") % 20 == 0).collect()


def test_search_beyond_doubles():
    rnd = np.random.default_rng(2)
    queries, columns = rnd.integers(-(2**30), 2**30, (9, 40)), rnd.integers(-(2**27), 2**27, (40, 700))
    best = topk.search(queries, np.full(9, -1), columns, np.arange(700), 20)
    exact = queries.astype(object) @ columns.astype(object)
    for q in range(9):
        want = sorted((-s, n) for n, s in enumerate(exact[q]))[:20]
        assert [(-s, n) for s, n in zip(best.scores[best.rows == q], best.ids[best.rows == q])] == want


@pytest.mark.parametrize("shard", [near_vectors.SHARD, 60])
def test_near_duplicates(embeddings, shard):
    frame, rows = embeddings
    links = {i: set() for i, _, _ in rows}
    usable = [(i, v, g) for i, v, g in fit(rows) if g is not None and np.abs(v).max() > 0]
    for a, x, g in usable:
        for b, y, h in usable:
            if a != b and g == h and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a].add(b)
    want = []
    for i, _, _ in rows:
        reached, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reached
            reached |= new
            todo += new
        want.append((i, len(links[i]), None if i is None else min(reached), i is not None and i == min(reached)))
    got = [tuple(r) for r in near_vectors.near_duplicates(frame, shard=shard).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_duplicates_of_nothing(embeddings):
    assert near_vectors.near_duplicates(embeddings[0].limit(0)).count() == 0


def test_graph_finds_neighbours():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(300, 24))
    data = near_vectors._unit(np.repeat(centres, 10, axis=0) + rnd.normal(0, 0.05, (3000, 24)))
    graph = near_vectors.Graph(data)
    q, c = graph.within(data[::10], 0.93, 48)
    truth = set(zip(*(x.tolist() for x in graph.scan(data[::10], 0.93))))
    assert len(truth & set(zip(q.tolist(), c.tolist()))) >= 0.98 * len(truth)


def test_components(workers):
    edges = [(n, n + 1) for n in range(50)] + [(7, 7), (100, 99), (99, 100), (None, 3), (200, 150), (150, 180)]
    got = rows_of(components(workers.createDataFrame(edges, "a long, b long")))
    want = [(n, 0) for n in range(51)] + [(99, 99), (100, 99), (150, 150), (180, 150), (200, 150)]
    assert sorted(got) == sorted(want)
    assert components(workers.createDataFrame([], "a long, b long")).count() == 0
