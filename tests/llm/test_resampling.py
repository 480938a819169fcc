import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from difftide.llm import resampling
from difftide.llm.queries import QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def buckets(text):
    w = words(text)
    return Counter(zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1))


def brute(docs, target):
    """[(doc_id, n_features, weight, score, rank)] by the definition, for rows (doc_id, text)."""
    each = [buckets(t) for _, t in docs]
    s, t = sum(each, Counter()), sum(map(buckets, target), Counter())
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for (k, text), found in zip(docs, each):
        weight = sum(n * gain[b] for b, n in found.items())
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, found.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = [r for r, (_, text) in zip(rows, docs) if len(words(text)) >= 20]
    fit.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(fit[: 5 * len(fit) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, rows), key=str)


TEXTS = ["", None, " .,-", "a", "B c", "É d Éé 0x9 " * 9, "x" * 70, "y" * 5_000 + " z " * 30, "lorem ipsum dolor sit amet " * 20, "\x85  q" * 25, "A" * 63 + " " + "b" * 64 + " " + "c" * 65]


def test_runs_of_words():
    first, runs = resampling.bucket_runs(pa.array(["zz", *TEXTS])[1:])
    for k, text in enumerate(TEXTS):
        w = words(text)
        for n in (1, 2, 3):
            start, end = (x[k] for x in resampling.within(first, n))
            assert runs[n - 1][start:end].tolist() == [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for i in range(len(w) - n + 1)]


def test_against_brute_force(spark):
    docs = [(k, " ".join(f"w{(k * j) % 13}" for j in range(k % 45))) for k in range(400)] + [(1_000 + k, t) for k, t in enumerate(TEXTS)]
    docs += [(7, docs[7][1])] * 3 + [(None, docs[44][1]), (None, docs[44][1]), (None, None)] + [(44, docs[44][1])] * 30 + [(5, "long text " * 40_000)]
    target = ["w1 w2 w3 w1 w2", None, "lorem ipsum"]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, weight string, row int").repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    none = docs.limit(0)
    assert resampling.resample(none, docs).count() == 0
    one = resampling.resample(docs, none.select("text")).collect()
    assert [(r.n_features, r.rank) for r in one] == [(87, None)]


@pytest.mark.parametrize("k", [1, 2, 50, 100, 250, 300])
def test_kth_key(spark, k):
    values = [(n % 3, None if n % 50 == 0 else n % 30) for n in range(300)]
    df = spark.createDataFrame(values, "a long, b long")
    got = resampling.kth_key(df, ["a", "b"], k, pivots=3)
    assert tuple(got) == sorted(values, key=lambda v: (v[0], v[1] is not None, v[1] or 0))[k - 1]


def test_the_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_importance_resampling"](spark, sf_dir).collect()), key=str) == brute(docs, target)
