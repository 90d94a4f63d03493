"""The pipeline and the registered queries."""

from pathlib import Path

import pytest
from llm_data import documents, prose, workers  # noqa: F401

import corpus_pipeline
from sensorcast.llm import near_texts, quality
from sensorcast.llm.queries import QUERIES, ratings

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables not present")


@pytest.mark.parametrize("number", range(1, 14))
def test_each_operator_has_one_query(number):
    assert sum(name.startswith(f"op{number}_") for name in QUERIES) == 1


def test_stages(workers, tmp_path):
    docs = workers.read.parquet(f"{DATA}/documents.parquet")
    for n, (_, function) in enumerate(corpus_pipeline.STAGES[:-1]):
        function(workers, docs, DATA).write.parquet(f"{tmp_path}/{n}")
        made = workers.read.parquet(f"{tmp_path}/{n}")
        assert made.dtypes == docs.dtypes
        ids, before = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (made, docs))
        assert ids <= before
        if n == 0:
            model = quality.train(docs, ratings(workers, DATA))
            assert ids == {r["doc_id"] for r in quality.score(docs, model).filter("kept").collect()}
        if n == 1:
            assert ids == {r["doc_id"] for r in near_texts.near_duplicates(docs, corpus_pipeline.NEAR_PERCENT).filter("kept").collect()}
        if n == 2:
            assert ids == before
            assert made.filter("text rlike 'AKIA[A-Z0-9]{12}'").count() == 0
        docs = made
    pieces = corpus_pipeline.STAGES[-1][1](workers, docs, DATA)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}


def test_run_takes_whole_table(workers):
    got = corpus_pipeline.run(workers, DATA)
    assert got.filter("length > 2048 or offset < 0").count() == 0
    assert got.count() > 0


def test_near_copies_of_80_percent_go(workers):
    words = [f"w{n}" for n in range(104)]  # 100 shingles; 10 other ones give 90 of 110
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-10], *(f"x{n}" for n in range(10))])), (3, "something else of five words")]
    docs = workers.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in near_texts.near_duplicates(docs).filter("kept").collect()} == {1, 2, 3}
    assert {r["doc_id"] for r in corpus_pipeline.distinct(workers, docs, DATA).collect()} == {1, 3}


def test_near_copies_are_decided_by_row(workers, documents):
    more = workers.createDataFrame([(20, prose(7, 50)), (0, prose(10, 50)), (15, prose(10, 50))], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(more)
    got = [tuple(r) for r in corpus_pipeline.distinct(workers, docs, DATA).collect()]
    assert [i for i, t in got if t == prose(8, 50)] == [16]  # a row twice
    assert [i for i, t in got if t == prose(7, 50)] == [15]
    assert [i for i, t in got if t == prose(10, 50)] == [0]
    assert any(i == 15 and "PASSWORD" in t for i, t in got)  # a clean text under an id that has a copy
    assert [t for i, t in got if i is None] == [prose(9, 50)]
