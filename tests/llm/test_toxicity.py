import re
import zlib
from collections import Counter

import numpy as np
import pytest

from difftide.llm import toxicity as tox
from difftide.llm.toxicity import NEIGHBOURS, BlockMaxIndex, _counts, terms_of, toxicity


def test_block_max_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(1500):
        terms = np.sort(rng.choice(40, rng.integers(0, 6), replace=False)).astype(np.int64)
        vectors.append((terms, rng.integers(1, 4, len(terms)).astype(np.int64)))
    idf = rng.uniform(1, 5, 40)
    index = BlockMaxIndex(vectors, rng.integers(0, 2, 1500).tolist(), list(range(1500)), idf)
    dense = np.zeros((1500, 40))
    for k, (t, c) in enumerate(vectors):
        if len(t):
            dense[k, t] = index.weights(t, c)
    for t, c in vectors[:200]:
        if not len(t):
            continue
        query = np.zeros(40)
        query[t] = index.weights(t, c)
        near, cosines = index.nearest(t, c)
        got = np.repeat(cosines, index.size[near])
        want = np.sort((dense @ query))[::-1]
        want = want[want > 0]
        assert len(got) >= min(NEIGHBOURS, len(want)) and np.allclose(got[:NEIGHBOURS], want[: min(NEIGHBOURS, len(got))])


def test_counts_are_plain_counts():
    import pyarrow as pa

    number = {"idiot": 0, "idio*": 1, "ab": 2}
    got = _counts(pa.array(["Idiot idiots, ab!", "", "none", "AB-ab 1ab"]), number)
    assert [dict(zip(t.tolist(), c.tolist())) for t, c in got] == [{0: 1, 1: 2, 2: 1}, {}, {}, {2: 3}]
    assert terms_of("abcde") == ["abcde", "abcd*", "abcde*"]


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    values, inverse, counts = np.unique(np.array(s), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    pos = np.array(y) == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum()), order


@pytest.mark.parametrize(("size", "area"), [("sf0.01", 0.8), ("sf0.1", 0.93)])  # 41 and some 400 toxic examples in four languages
def test_held_out_accuracy(spark, size, area):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    assert auc(rows["toxic"], rows["score"])[0] > area
    assert (rows["predicted"] == rows["toxic"]).mean() > 0.93
    every = toxicity(docs, labels).toPandas()
    assert len(every) == docs.count() and every["score"].between(0, 1).all()
    assert (every["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in every["doc_id"]]).all()


def test_edges(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in [(1, "bad idiot"), (2, None), (3, ""), (None, "idiot"), (1, "bad idiot"), (4, "fine " * 50_000)]], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    rows = toxicity(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in toxicity(docs, labels.limit(0)).collect()] == [0.0] * 6
    assert toxicity(docs.limit(0), labels).count() == 0


def plain_scores(texts, labels, taught):
    """Scores by plain loops over all examples: term choice, cosine with every example, votes, curve."""
    words = [[w for w in re.split(r"[^a-z]+", t.lower()) if w] for t in texts]
    counts = [Counter(t for w in ws for t in terms_of(w)) for ws in words]
    once = {(texts[k], labels[k]): set(counts[k]) for k in taught}  # copies count once in the choice of terms
    n, toxic = len(once), sum(label for _, label in once)
    terms = {}
    for term in set().union(*once.values()):
        with_term = [label for (_, label), has in once.items() if term in has]
        a, b = sum(with_term), len(with_term)
        if tox.LEAST <= b < n and n * (a * (n - toxic) - (b - a) * toxic) ** 2 / (b * (n - b) * toxic * (n - toxic)) >= tox.DEPENDENT:
            terms[term] = np.log((1 + n) / (1 + b)) + 1
    assert 0 < len(terms) <= tox.TERMS
    kinds = [tuple(sorted((t, c) for t, c in count.items() if t in terms)) for count in counts]
    vectors = [{t: (1 + np.log(c)) * terms[t] for t, c in kind} for kind in kinds]
    vectors = [{t: w / np.sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for v in vectors]
    rate = (sum(labels[k] for k in taught) + 1) / (len(taught) + 2)

    def share(v, examples):
        alike = {}  # equal vectors vote together
        for k in examples:
            if (cosine := sum(w * vectors[k].get(t, 0.0) for t, w in v.items())) > 1e-12:
                alike.setdefault(kinds[k], []).append((cosine, k))
        votes = weight = taken = 0
        for group in sorted(alike.values(), key=lambda g: (-round(g[0][0], 9), min(k for _, k in g))):
            if taken >= NEIGHBOURS:
                break
            taken += len(group)
            weight += len(group) * group[0][0] ** 2
            votes += sum(labels[k] for _, k in group) * group[0][0] ** 2
        return (votes + tox.PRIOR * rate) / (weight + tox.PRIOR)

    own = [(share(vectors[k], [j for j in taught if j != k]), labels[k]) for k in taught if vectors[k]]
    x = np.array([np.log(s / (1 - s)) for s, _ in own])
    y = np.array([label for _, label in own])

    def loss(w):
        z = w[0] * x + w[1]
        return (np.logaddexp(0, z) - y * z).sum() + tox.IDENTITY / 2 * ((w[0] - 1) ** 2 + w[1] ** 2)

    best, width = np.array([1.0, 0.0]), 1.0
    while width > 1e-7:  # the loss is convex: walk down on a grid that shrinks
        around = [best + width * np.array(d) for d in [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1)]]
        least = min(around, key=loss)
        best, width = least, width if least is not around[0] else width / 2
    empty = [labels[k] for k in taught if not vectors[k]]
    without = min(rate, (sum(empty) + rate) / (len(empty) + 1))
    logit = lambda s: np.log(s / (1 - s))
    return [1 / (1 + np.exp(-(best[0] * logit(share(v, taught)) + best[1]))) if v else without for v in vectors]


def test_whole_query_is_a_plain_search(spark):
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(150)]
    rude = ["".join(rng.choice(list("klmnopq"), 6)) for _ in range(8)]
    labels = (rng.random(240) < 0.25).astype(int).tolist()
    texts = []
    for label in labels:
        ws = rng.choice(plain, rng.integers(3, 15)).tolist()
        ws += rng.choice(rude[1:] if label else rude[:3], 2).tolist() if rng.random() < (0.9 if label else 0.4) else []
        texts.append(" ".join(rng.permutation(ws)))
    texts[7], texts[8], texts[9] = texts[3], texts[3], ""
    labels[7] = labels[8] = labels[3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    want = plain_scores(texts, labels, [k for k in range(240) if zlib.crc32(str(k).encode()) % 5])
    got = {r.doc_id: r.score for r in toxicity(docs, marks).collect()}
    assert np.allclose([got[k] for k in range(240)], want, atol=1e-4)


def test_scores_are_probabilities(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "evidence", "toxic").toPandas()
    assert (rows["evidence"].str.len() == 0).mean() < 0.2  # nearly all are searched
    for low, high in [(0, 0.1), (0.1, 0.5), (0.5, 0.9), (0.9, 1.01)]:
        part = rows[(rows["score"] >= low) & (rows["score"] < high)]
        error = 2.5 * np.sqrt((part["score"] * (1 - part["score"])).sum()) / len(part)  # of the mean of such trials
        assert abs(part["toxic"].mean() - part["score"].mean()) < error + 0.02
    caught = rows["score"] >= 0.5
    assert rows["toxic"][caught].sum() >= 0.72 * rows["toxic"].sum() and (rows["toxic"][caught] == 0).sum() <= 3
