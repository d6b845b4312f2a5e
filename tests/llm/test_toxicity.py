import random

import numpy as np
import pytest

from pagework.llm import toxicity

BAD = ["vilest", "rotten", "scumbag"]


def text_of(numbers, bad, words=30):
    found = ["".join(numbers.choices(["lo", "mi", "ta", "re", "sun"], k=3)) for _ in range(words)]
    for _ in range(2 if bad else 0):
        found.insert(numbers.randrange(len(found)), numbers.choice(BAD) + numbers.choice(["", "a", "el"]))
    return " ".join(found)


@pytest.fixture(scope="module")
def tables(spark):
    numbers = random.Random(8)
    docs = [(i, text_of(numbers, i % 8 == 0)) for i in range(1600)]
    labels = [(i, int(i % 8 == 0)) for i in range(1600) if i % 3] + [(None, 1), (3, None), (10**9, 1), (8, 1)]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


@pytest.fixture(scope="module")
def model(spark, tables):
    from pagework.llm.common import ship_package

    ship_package(spark)
    return toxicity.fit(*tables)


def test_held_out(model):
    numbers = random.Random(77)
    texts = [text_of(numbers, bad) for bad in [True] * 100 + [False] * 400]
    score = model.scores(texts, toxicity.WordFeatures(model.features))
    assert (score[:100] >= 0.5).mean() >= 0.97 and (score[100:] >= 0.5).mean() <= 0.01


def test_features_are_those_of_toxic_words(model):
    assert {"=vilest", "=rotten", "=scumbag"} <= set(model.features)
    assert not any("lomi" in f for f in model.features)


def test_the_risk_estimate_is_corrected():
    """With the prior, unlabelled positives do not pull the score of positives down to their share."""
    x = np.array([[1.0]] * 100 + [[1.0]] * 20 + [[0.0]] * 80)
    positive = np.arange(200) < 100
    weights, bias = toxicity.nonnegative_pu(x, positive, prior=0.2)
    assert 1 / (1 + np.exp(-(weights[0] + bias))) > 0.9
    assert 1 / (1 + np.exp(-bias)) < 0.1


def test_fits_agree(tables, model):
    again = toxicity.fit(*tables)
    assert again.features == model.features and again.weights == pytest.approx(model.weights, abs=1e-6)


def test_table(spark, model, long_text):
    rows = [(1, None, 0.1), (2, "", 0.2), (3, "Rotten VILEST scumbag", 0.3), (3, "Rotten VILEST scumbag", 0.3), (None, long_text, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    found = [tuple(r) for r in toxicity.score(df, model, ["doc_id"]).collect()]
    by = dict(found)
    assert len(found) == 5 and by[1] == by[2] < 0.5 < by[3] and 0 <= by[None] < 0.5
    assert toxicity.score(df.limit(0), model, ["doc_id"]).collect() == []


def test_without_labels_every_text_has_the_prior(spark, tables):
    docs, labels = tables
    found = toxicity.fit(docs, labels.limit(0))
    assert found.features == [] and found.bias < 0
    nothing = toxicity.fit(docs.limit(0), labels)
    assert nothing.features == []


def test_gradients_against_differences():
    numbers = np.random.default_rng(3)
    x = toxicity.with_bias(numbers.integers(0, 2, (60, 7)).astype(float))
    xp, xu, w = x[:20], x[20:], numbers.normal(0, 1, 8)
    negative, as_positive, as_negative = toxicity.gradients(w, xp, xu, 0.3)
    parts = lambda w: np.array(toxicity.risk_parts(w, xp, xu, 0.3))
    assert negative == pytest.approx(parts(w)[1])
    for i in range(8):
        step = np.zeros(8)
        step[i] = 1e-6
        assert (parts(w + step) - parts(w - step)) / 2e-6 == pytest.approx([as_positive[i], as_negative[i]], abs=1e-6)


def test_a_text_without_features_never_passes_the_prior():
    """Positives of which many have no feature: plain descent of the corrected risk would raise the bias for ever."""
    numbers = np.random.default_rng(1)
    toxic = np.arange(400) % 8 == 0
    shown = (numbers.random((400, 30)) < np.where(toxic, 0.06, 0.001)[:, None]).astype(float)
    x, positive = np.vstack([shown[toxic], shown]), np.arange(450) < 50
    for held in (None, np.arange(450) % 4 == 0):
        weights, bias = toxicity.nonnegative_pu(x, positive, 0.125, held)
        assert bias <= np.log(0.125 / 0.875) + 1e-9
        assert ((shown @ weights + bias > 0) & ~toxic).sum() <= 0.03 * (~toxic).sum()


def test_few_features_stand_out_by_chance():
    assert toxicity.standing_out([20.0, 9.0, 1.0], 1000) == 1
    assert toxicity.standing_out([20.0, 9.3, 9.2, 1.0], 1000) == 3
    assert toxicity.standing_out([], 0) == 0 and toxicity.standing_out([3.0], 1) == 1


def test_parts_that_stand_twice():
    words = toxicity.WordFeatures(["=rotten", "^rott+", "otten"])
    assert words.of("a Rotten day") == [0, 2] and words.of("rotten rotter") == [0, 1, 2] and words.of("fine") == []
    assert {"=rotten", "^rott+"} <= set(toxicity.features_of("rotten rotter")) and "=rotten+" not in toxicity.features_of("rotten rotter")
