"""Quality classifier and mixing."""

import numpy as np
import pytest
from llm_data import documents, workers  # noqa: F401
from pyspark.sql import functions as F

from sensorcast.llm import mixing, quality
from sensorcast.llm.queries import ratings


def test_ordinal_fit_orders_grades():
    rnd = np.random.default_rng(0)
    latent = rnd.normal(size=900)
    grades = np.digitize(latent, [-0.7, 0.7])
    cells = [np.array([5000 + int(10 * (x + 4))]) for x in latent]
    model = quality.fit_ordinal(cells, [np.ones(1)] * 900, grades, 3, least=1)
    assert model.thresholds[0] < model.thresholds[1]
    tails = np.array([model.tails(model.weights[c[0]]) for c in cells])
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert np.mean(np.round(tails.sum(axis=1)) == grades) > 0.9


@pytest.fixture(scope="module")
def rated(workers):
    rows = []
    for n in range(240):
        words = " ".join(f"w{(n * 7 + k) % 90}" for k in range(40))
        text = [words + " rotten and vile", words.replace(" ", "!! "), words][n % 3]
        rows.append((n, text, n % 3))
    frame = workers.createDataFrame(rows, "doc_id long, text string, grade int")
    return frame.drop("grade"), frame.drop("text")


def test_held_out_documents_get_their_grade(rated):
    documents, ratings = rated
    model = quality.train(documents, ratings.filter("doc_id < 150"))
    scored = quality.score(documents, model).join(ratings, "doc_id").filter("doc_id >= 150").collect()
    assert np.mean([r["kept"] == (r["grade"] == 2) for r in scored]) > 0.97
    assert np.mean([round(r["expected_grade"]) == r["grade"] for r in scored]) > 0.9


def test_held_out_accuracy_on_labelled_documents(workers):
    data = "/root/testdata/sf0.1"
    texts, grades = workers.read.parquet(f"{data}/documents.parquet"), ratings(workers, data).filter("grade is not null")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    scored = quality.score(texts, quality.train(texts, grades.filter(~held))).join(grades.filter(held), "doc_id").toPandas()
    good = scored["grade"].to_numpy() == 2
    assert len(scored) > 500 and 0.6 < good.mean() < 0.9
    assert (scored["kept"] == good).mean() > 0.93 and scored["kept"][good].mean() > 0.95 and scored["kept"][~good].mean() < 0.15
    for above, rank in ((good, scored["tail_2"]), (scored["grade"].to_numpy() > 0, scored["tail_1"])):
        n = above.sum()
        area = (rank.rank().to_numpy()[above].sum() - n * (n + 1) / 2) / (n * (len(above) - n))
        assert area > (0.96 if above is good else 0.9)


def test_odd_documents(rated, documents):
    model = quality.train(*rated)
    scored = quality.score(documents, model)
    assert scored.count() == documents.count()
    blank = scored.filter("doc_id in (7, 8, 9)").collect()
    assert [(r["expected_grade"], r["kept"]) for r in blank] == [(0.0, False)] * 3
    chosen = quality.select(documents, model)
    assert chosen.schema == documents.schema
    assert chosen.count() == scored.filter("kept").count()
    assert quality.score(documents.limit(0), model).count() == 0


def test_no_ratings(documents, rated):
    nothing = rated[1].limit(0)
    assert quality.score(documents, quality.train(documents, nothing)).count() == documents.count()


TARGETS = {"source": {"src0": 0.5, "gone": 0.2}, "lang": {"en": 0.4}, "topic": {"prose": 0.9, "table": 0.1}}


def test_raked_weights_meet_targets():
    cells = [(s, g, t) for s in "ab" for g in "xy" for t in "pq"]
    tokens = np.array([10.0, 1, 3, 7, 2, 2, 9, 30])
    targets = ({"a": 0.6, "b": 0.4}, {"x": 0.3, "y": 0.7}, {"p": 0.8, "q": 0.2})
    weight = mixing.rake(tokens, cells, targets)
    for d, stated in enumerate(targets):
        for name, share in stated.items():
            assert weight[[c[d] == name for c in cells]].sum() == pytest.approx(share, abs=1e-6)
    # Raking keeps the odds ratios of the start.
    ratio = lambda v: v[0] * v[3] / (v[1] * v[2])
    assert ratio(weight) == pytest.approx(ratio(tokens), rel=1e-6)
    chance = mixing.probabilities(tokens, weight, 0.3)
    assert chance.max() <= 1 and (chance * tokens).sum() == pytest.approx(0.3 * tokens.sum(), rel=1e-6)


def test_mix_of_odd_documents(documents):
    made = mixing.mix(documents, **TARGETS, keep=0.5)
    into = made.columns[-1]
    assert into == "mix_" and made.columns[:-1] == documents.columns
    rows = made.select("doc_id", "text", f"{into}.*").collect()
    assert len(rows) == documents.count()
    assert all(r["tokens"] == len((r["text"] or "").split()) for r in rows if r["doc_id"] != 12)
    cells = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in rows if r["tokens"]}
    assert sum(cells.values()) == pytest.approx(1)
    twice = [r["kept"] for r in rows if r["doc_id"] == 16]
    assert twice[0] == twice[1]
    again = mixing.mix(documents, **TARGETS, keep=0.5).filter(F.col(into)["kept"]).count()
    assert again == sum(r["kept"] for r in rows)
    assert mixing.mix(documents.limit(0), **TARGETS).count() == 0


def test_kept_tokens_have_the_shares_where_a_source_is_scarce(workers):
    rows = [(n, "a b c d", "en" if n % 3 else "de", "rare" if n % 20 == 0 else "common") for n in range(600)]
    docs = workers.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="of the tokens"):
        made = mixing.mix(docs, {"rare": 0.3, "common": 0.7}, {"en": 0.5, "de": 0.5}, {"prose": 1.0}, keep=0.6)
    expected = {}
    for r in made.select("mix.*").collect():
        for name in (r["source"], r["lang"]):
            expected[name] = expected.get(name, 0.0) + r["tokens"] * r["probability"]
    total = expected["rare"] + expected["common"]
    assert 0 < total < 0.6 * 2400
    assert expected["rare"] / total == pytest.approx(0.3, abs=1e-6)
    assert expected["en"] / total == pytest.approx(0.5, abs=1e-6)
