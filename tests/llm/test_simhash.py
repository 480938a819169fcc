import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from difftide.llm.graph import components
from difftide.llm.simhash import BKTree, fingerprint, keep_one, link_fingerprints, simhash_groups


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(prints, radius=3):
    """Smallest position reachable, of each."""
    best = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius and best[j] < best[i]:
                    best[i], changed = best[j], True
    return best


def test_documents(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["Alpha", "beta", "ÉTÉ", "g\xa0h", "x1"]) + str(rng.randrange(40)) for _ in range(60)) for _ in range(25)]
    texts = [*base, *(b.upper() if b.isascii() else b for b in base[:5]), *(b + " tail" for b in base), "", None, " \t\n ", "one", "one two", "ONE  two", "one two three", "w " * 30_000]
    rows = [(k, t, "c") for k, t in enumerate(texts)] + [(3, texts[3], "c"), (None, "one", "c"), (None, "lonely words here without id", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash_groups(df).collect()
    prints = [plain(t) for t in texts]
    best = reach(prints)
    want = [(k, f"{p:016x}", b) for k, (p, b) in enumerate(zip(prints, best))]
    want += [want[3], (None, f"{plain('one'):016x}", best[texts.index("one")]), (None, f"{plain('lonely words here without id'):016x}", None)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = keep_one(df, simhash_groups(df)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(best)) and sum(r.doc_id is None for r in kept) == 2


@pytest.mark.parametrize("shard", [4096, 6])
def test_links_of_dense_and_random_prints(spark, shard):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(150)} | {centre ^ sum({1 << rng.choice([0, 1, 15, 16, 17, 31, 32, 40, 63]) for _ in range(rng.randrange(6))}) for _ in range(120)}
    for p in list(prints)[:60]:
        prints.add(p ^ sum({1 << rng.randrange(64) for _ in range(3)}))
    prints = sorted(prints)
    df = spark.createDataFrame([(k, int(np.uint64(p).view(np.int64))) for k, p in enumerate(prints)], "id long, fp long")
    found = {r.id: r.component for r in components(link_fingerprints(df, shard=shard)).collect()}
    assert [found.get(k, k) for k in range(len(prints))] == reach(prints)


def test_tree_finds_all():
    rng = random.Random(3)
    values = [rng.getrandbits(10) for _ in range(300)]
    tree = BKTree()
    for k, v in enumerate(values):
        tree.add(v, k)
    for q in range(0, 1024, 7):
        assert sorted(tree.near(q, 2)) == [k for k, v in enumerate(values) if (v ^ q).bit_count() <= 2]


def test_long_chain_of_links(spark):
    chain = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.component for r in components(chain).collect()} == {0}
    assert components(chain.limit(0)).count() == 0


def test_empty_and_radius(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_groups(df).count() == 0 and fingerprint("") == 0
    with pytest.raises(ValueError):
        link_fingerprints(spark.createDataFrame([(1, 1)], "id long, fp long"), radius=4)


def test_rows_of_repeated_and_null_ids_are_decided_by_text(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (6, c), (6, c.upper()), (6, c), (7, c), (8, d), (8, a), (None, "x y"), (None, "x y"), (None, "X y"), (None, None)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, component_id string")
    groups = simhash_groups(df)
    assert sorted({(r.doc_id, r.component_id) for r in groups.collect() if r.doc_id is not None}) == [(3, 3), (5, 3), (5, 5), (6, 6), (7, 6), (8, 3), (8, 8)]
    kept = keep_one(df.repartition(5), groups)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id or 0, (r.text or "").lower()) for r in kept.collect()))
    assert got == sorted([(3, a), (5, b), (6, c), (8, d), (0, "x y"), (0, "")])


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b c d", "p", 7, "q", 1), (1, "a b c d", "p", 7, "q", 1), (2, "A b c d", "p", 7, "q", 1), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __fingerprint string, __ID long, __print string, __row int")
    kept = keep_one(df, simhash_groups(df))
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted({rows[0], rows[3]}, key=str)
