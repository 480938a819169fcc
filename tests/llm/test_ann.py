import numpy as np
import pytest
from pyspark.sql import functions as F

from difftide.llm.ann import Codes, nearest, rotation


def brute(rows, asked, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            good[i] = min(good.get(i, v), v)
    out = set()
    for q in good:
        if asked(q):
            near = sorted((float(np.sqrt(((np.array(v) - np.array(good[q])) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:k]
            out |= {(q, n + 1, i) for n, (_, i) in enumerate(near)}
    return out


@pytest.mark.parametrize("blocks", [(1024, 8192), (7, 40)])
def test_recall_and_edges(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(24).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[5][1]) for k in range(4)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, []), (None, rows[0][1]), (5, rows[5][1])]
    rows += [(3000 + k, [float(k + 1), 0.0, 1.0]) for k in range(6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    got = nearest(df, F.col("vec_id") % 5 == 0, 10, query_block=blocks[0], candidate_block=blocks[1]).collect()
    want = brute(rows, lambda q: q % 5 == 0, 10)
    have = {(r.query_id, r.rank, r.vec_id) for r in got}
    assert {(q, n) for q, n, _ in have} == {(q, n) for q, n, _ in want}
    assert len({(q, i) for q, _, i in have} & {(q, i) for q, _, i in want}) >= 0.95 * len(want)
    vec = {i: v for i, v in rows if i is not None}
    assert all(abs(r.score - np.linalg.norm(np.array(vec[r.query_id]) - np.array(vec[r.vec_id]))) < 1e-12 for r in got)
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 5][:4] == [1000, 1001, 1002, 1003]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, centre, turn = rng.standard_normal((3000, 64)), rng.standard_normal(64) * 0.1, rotation(64)
    codes = Codes(x, centre, turn)
    for q in rng.standard_normal((20, 64)):
        low, high = codes.estimate(q, centre, turn)
        exact = ((x - q) ** 2).sum(axis=1)
        assert ((low <= exact + 1e-9) & (exact <= high + 1e-9)).mean() > 0.97


def test_registered_table_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in df.collect()]
    want = {(q, i) for q, _, i in brute(rows, lambda q: q % 100 == 0, 10)}
    have = {(r.query_id, r.vec_id) for r in nearest(df, F.col("vec_id") % 100 == 0).collect()}
    assert len(want & have) >= 0.97 * len(want)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(df, F.col("vec_id") % 100 == 0).count() == 0
