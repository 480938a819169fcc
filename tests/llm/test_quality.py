import numpy as np
import pyarrow as pa
import pytest

from difftide.llm.quality import LABELLERS, MISTAKES, Texts, expectation_maximisation, fit_scorer, keep, pattern_of, quality, votes_of


def test_measures_by_hand():
    texts = pa.array(["skip", "AB ab Ab! $$ x.\nsame line\nsame line", "", " \n ", "é É one one one"])[1:]
    m = Texts(texts).measures
    words = "AB ab Ab! $$ x. same line same line".split()
    assert m[0].tolist() == [4 / 23, 2 / 27, 7 / 9, 1 / 8, pytest.approx(1 / 3), 9 / 2, 27 / 9, 1 / 9, len(words)] or m[0][8] == 9
    assert m[0][3] == 1 / 8 and m[0][4] == pytest.approx(1 / 3) and m[0][7] == pytest.approx(1 / 9)
    assert m[1].tolist() == [0, 0, 0, 0, 0, 0, 0, 0, 0] and m[2][8] == 0
    assert m[3][3] == 3 / 4 and m[3][2] == 2 / 5


def test_accuracies_are_recovered():
    rng = np.random.default_rng(1)
    good = rng.random(40_000) < 0.85
    sees = np.linspace(0.2, 0.7, len(LABELLERS))
    v = np.where(good[:, None], rng.random((40_000, len(LABELLERS))) > MISTAKES / 2, rng.random((40_000, len(LABELLERS))) > sees).astype(int)
    v[rng.random(v.shape) < 0.2] = 2
    p = pattern_of(v)
    posterior, share, calls = expectation_maximisation(dict(zip(*(x.tolist() for x in np.unique(p, return_counts=True)))))
    assert abs(share - 0.85) < 0.02 and np.abs(calls[0] - sees).max() < 0.05 and calls[1].max() <= MISTAKES
    assert ((np.array([posterior[x] for x in p.tolist()]) >= 0.5) == good).mean() > 0.97
    assert (votes_of(p) == v).all()


def test_scorer_learns():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    weights = fit_scorer(np.arange(400), y * 7 + 3, np.ones(400), y.astype(float))
    assert weights[10] > 1 > -1 > weights[3]


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_against_labels(spark, size):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    every = quality(docs)
    rows = every.join(labels, "doc_id").toPandas()
    good = rows["quality"] == 1
    assert rows["kept"][good].mean() > 0.97 and (~rows["kept"][~good]).mean() > 0.85
    assert every.count() == docs.count()


def test_edges(spark):
    rows = [(1, "Plain words, as they come. They end like this. " * 5, "a"), (2, None, "b"), (3, "", "c"), (None, "$$$ ### " * 30, "d"), (1, "SHOUT!! LOUD!! " * 20, "e"), (4, "word " * 60_000, "f"), (5, " \n\t ", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = quality(df).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    kept = keep(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    assert quality(df.limit(0)).count() == 0 and keep(df.limit(0)).count() == 0
