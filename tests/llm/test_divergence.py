import re
from collections import Counter, defaultdict

import pyarrow as pa

from difftide.llm import divergence
from difftide.llm.queries import QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, ranks=10):
    """[(lang, source, part, item, value, rank)] by the definition, for rows (text, lang, source)."""
    df, counts = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        df[lang or ""].update(set(found))
        counts[lang or ""][source or ""].update(found)
    out = []
    for lang, of in counts.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def share(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // total for t in kept}

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: share(c) for s, c in of.items()}, share(sum(of.values(), Counter()))
        for s in of:
            pairs = sorted(((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in of if o != s))
            best = sorted((-gap(p[s][t], q[t]), t.encode()) for t in kept if of[s][t] and p[s][t] > q[t])[:ranks]
            for part, items in (("pair", pairs), ("term", best)):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "text string, lang string, source string, term string, df int").repartition(4)
    got = divergence.source_divergence(df, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


def cases():
    rows = [(" ".join(f"T{'abcdefgh'[(k * j) % 8]}{'xyzé'[j % (1 + k % 4)]}" for j in range(k % 17)), ["en", "de", None, ""][k % 4], f"s{k % 5}" if k % 7 else None) for k in range(300)]
    rows += [rows[40]] * 25 + [(None, "en", "nothing"), ("", "fr", "a"), ("rare once", "fr", "b"), ("mot " * 20_000, "en", "s1"), (None, None, None)]
    return rows + [("same words here", "tie", s) for s in ("b", "a", "c") for _ in range(4)]


def test_against_brute_force(spark):
    assert run(spark, cases()) == brute(cases())
    assert run(spark, cases(), least=1, ranks=3) == brute(cases(), 1, 3)


def test_spills_and_small_blocks(spark, monkeypatch):
    """The same result when hashes spill after a few entries, blocks hold a few stripes and long groups are squeezed."""
    rows = cases()
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] or "" for r in rows]) for c in (1, 2, 0)], names=["lang", "source", "text"])
    whole = list(divergence.fold(iter([batch])))
    monkeypatch.setattr(divergence, "ENTRIES", 10)
    monkeypatch.setattr(divergence, "BLOCK", 3)
    spilled = list(divergence.fold(iter([batch])))

    def blocks(parts):
        table = pa.Table.from_batches(parts).sort_by([("lang", "ascending"), ("term", "ascending")]).combine_chunks()
        found = {}
        for b in divergence.merge(1)(iter(table.to_batches(max_chunksize=2))):
            for lang, terms, sizes, sources, counts in zip(*(c.to_pylist() for c in b.columns)):
                assert len(terms) <= 3
                at = 0
                for term, n in zip(terms, sizes):
                    assert (lang, term) not in found
                    found[lang, term] = dict(zip(sources[at : at + n], counts[at : at + n]))
                    at += n
        return found

    assert len(spilled) > len(whole) and blocks(spilled) == blocks(whole)


def test_sums_spill(spark, monkeypatch):
    names = [f"s{k}" for k in range(6)]
    block = {"lang": ["l", "l"], "terms": [[b"a", b"b"], [b"c"]], "sizes": [[1, 2], [1]], "sources": [["s1", "s1", "s5"], ["s0"]], "counts": [[3, 4, 9], [2]], "names": [names] * 2, "totals": [[2, 7, 0, 0, 0, 9]] * 2, "kept": [3] * 2}

    def sums():
        total = Counter()
        for b in divergence.emit(10)(iter([pa.RecordBatch.from_pydict(block)])):
            for lang, source, part, item, value in zip(*(c.to_pylist() for c in b.columns)):
                total[lang, source, part, item] += value
        return total

    want = sums()
    monkeypatch.setattr(divergence, "CELLS", 4)
    assert sums() == want and len([k for k in want if k[2] == "pair"]) == 15


def test_large_counts():
    import numpy as np

    c, total = 3 * 10**14, 9 * 10**14
    assert divergence.shares(np.array([c]), np.array([total]), 10**6)[0] == 1 + 10**9 * (c + 2) // (total + 2 * 10**6)


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(df).count() == 0
    one = spark.createDataFrame([("a b", "en", "x")] * 12, "text string, lang string, source string")
    assert divergence.source_divergence(one).count() == 0  # one source alone, and p equals q


def test_the_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_source_divergence"](spark, sf_dir).collect())) == brute(rows)
