"""Periodic runs against a search by definition."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from llm_data import documents, prose, workers  # noqa: F401

from sensorcast.llm import runs
from sensorcast.llm.queries import op13_periodic_runs, planted


def by_definition(words):
    found = {}
    for period in range(1, len(words) // 3 + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end > at and end - at + period >= max(24, 3 * period):
                found.setdefault((at, end - at + period), period)
            at = max(end, at + 1)
    return sorted((start, length, period) for (start, length), period in found.items())


def hashes(words):
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def found_in(*lists):
    words = [[str(w).encode() for w in one] for one in lists]
    return runs.runs_of_documents(words, [hashes(w) for w in words])


def sample(rnd):
    kinds = rnd.choice([1, 2, 2, 3, 5, 40])
    words = [rnd.randrange(kinds) for _ in range(rnd.randrange(120))]
    if len(words) > 30 and rnd.random() < 0.6:
        at = rnd.randrange(len(words) - 5)
        period = rnd.randrange(1, max(2, (len(words) - at) // 3))
        words = words[:at] + [words[at + i % period] for i in range(len(words) - at)]
        if rnd.random() < 0.3:
            words += [rnd.randrange(kinds) for _ in range(5)] + words
    return words


def test_runs_of_many_documents_together():
    rnd = random.Random(1)
    lists = [sample(rnd) for _ in range(600)]
    assert found_in(*lists) == [by_definition(words) for words in lists]


@pytest.mark.parametrize("together", [1, 150])
def test_groups_of_any_size(together, monkeypatch):
    monkeypatch.setattr(runs, "TOGETHER", together)
    monkeypatch.setattr(runs, "FLAT", 7)
    rnd = random.Random(2)
    lists = [sample(rnd) for _ in range(60)]
    assert found_in(*lists) == [by_definition(words) for words in lists]


def test_runs_of_highly_repetitive_texts():
    short, long = "a", "ab"
    while len(long) < 3_000:
        short, long = long, long + short
    assert found_in(long[:900])[0] == by_definition(long[:900])
    assert found_in("a" * 200_000) == [[(0, 200_000, 1)]]
    words = [f"w{n % 3_333}" for n in range(50_000)]
    assert found_in(words) == [[(0, 50_000, 3_333)]]


def test_equal_hashes_do_not_make_runs():
    words = [[str(n).encode() for n in range(100)]]
    assert runs.runs_of_documents(words, [np.zeros(100, np.uint64)]) == [[]]


def test_limits():
    assert found_in("ab" * 12) == [[(0, 24, 2)]]
    assert found_in("ab" * 11 + "a") == [[]]
    cycle = [f"c{n}" for n in range(10)]
    assert found_in(cycle * 3) == [[(0, 30, 10)]]
    assert found_in((cycle * 3)[:-1]) == [[]]


def test_strongest_is_exact():
    assert runs.strongest([]) is None
    assert runs.strongest([(5, 30, 10), (1, 27, 9), (9, 24, 8)]) == (1, 27, 9)
    huge = 10**15
    assert runs.strongest([(0, 3 * huge, huge), (1, 3 * huge + 1, huge)]) == (1, 3 * huge + 1, huge)


def expected(doc_id, text, order):
    words = (text or "").encode().split()
    at = order(doc_id, len(words)) if order else None
    words = words if at is None else [words[i] for i in at]
    found = by_definition(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {n for start, length, period in found for n in range(start + period, start + length)}
    return found, best, b" ".join(w for n, w in enumerate(words) if n not in gone)


@pytest.mark.parametrize("order", [None, planted])
def test_odd_documents(workers, documents, order):
    rows = [(n, prose(n, 60, 30), n) for n in range(30, 300)] + [(900, "x y " * 20 + "z " * 30, 0)]
    frame = documents.select("doc_id", "text", "n_words").unionByName(
        workers.createDataFrame(rows, "doc_id long, text string, n_words int")
    )
    given = [(r["doc_id"], r["text"]) for r in frame.filter("doc_id is null or doc_id <> 13").collect()]
    made = [r for r in runs.periodic_runs(frame, order).collect() if r["doc_id"] != 13]
    show = lambda i, rs, b, text: (str(i), [tuple(r) for r in rs], b and tuple(b), text)
    got = sorted(show(r["doc_id"], r["runs"], r["best"], r["collapsed"]) for r in made)
    want = []
    for doc_id, text in given:
        found, best, left = expected(doc_id, text, order)
        want.append(show(doc_id, found, best, left.decode()))
    assert got == sorted(want)
    assert runs.periodic_runs(frame.limit(0), order).count() == 0
    assert any(found for _, found, _, _ in got)


def test_query_digests(workers, tmp_path):
    rows = [(n, prose(n, 90, 50)) for n in range(200)] + [(None, "a b " * 20), (1000, None)]
    workers.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in op13_periodic_runs(workers, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        found, best, left = expected(doc_id, text, planted)
        start, length, period = best or (None,) * 3
        shown = "".join(f"{s},{k},{p}\n" for s, k, p in found)
        milli = best and 1000 * length // period
        digests = [hashlib.sha256(x).hexdigest() for x in (shown.encode(), left)]
        assert got[doc_id] == (len(found), start, length, period, milli, *digests)
    assert sum(bool(g[0]) for g in got.values()) > 10
