"""Every registered query against its check SQL on the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from difftide.operators import extras
from difftide.plans.catalog import QUERIES
from difftide.plans.checks import CHECKS
from difftide.plans.derived import SOURCE_TABLES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in SOURCE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(map(repr, pdf.where(pdf.notna(), None).astype(str).values.tolist()))


def test_every_query_has_a_check():
    assert set(CHECKS) == set(QUERIES) and set(entry.queries()) >= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, str(SF)).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_similar_vectors_in_blocks(spark):
    corpus = spark.read.parquet(str(SF / "embeddings.parquet"))
    queries = corpus.where(F.col("vec_id") % 5 == 0)
    want = {tuple(r) for r in extras.similar_vectors(queries, corpus, 3).select("query_id", "rank", "vec_id").collect()}
    got = {tuple(r) for r in extras.similar_vectors(queries, corpus, 3, corpus_block=40, query_block=7).select("query_id", "rank", "vec_id").collect()}
    assert got == want
    rows = [(r.vec_id, r.label, np.asarray(r.embedding, dtype=float)) for r in corpus.collect()]
    unit = lambda v: v / np.linalg.norm(v)
    for qid, label, v in rows[::5]:
        near = sorted((-(unit(v) @ unit(w)), i) for i, other, w in rows if other == label and i != qid)[:3]
        assert [i for _, i in near] == [i for _, _, i in sorted(t for t in got if t[0] == qid)]


def test_similar_vectors_of_any_shape(spark):
    """Vectors that can't be compared take no part, and lengths don't mix."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, [0.0, 0.0]), (10, [2.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([(k, "a", v) for k, v in rows] + [(12, None, [1.0, 0.0])], "vec_id long, label string, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.cosine, 6)) for r in extras.similar_vectors(df, df, 2).collect()}
    half = round(0.5**0.5, 6)
    assert got == {
        (1, 1): (2, half), (1, 2): (9, 0), (2, 1): (1, half), (2, 2): (9, 0), (8, 1): (10, 1), (10, 1): (8, 1),
        (9, 1): (1, 0), (9, 2): (2, 0), (11, 1): (9, 0), (11, 2): (2, -half),
    }
    assert extras.similar_vectors(df.limit(0), df, 2).count() == 0
