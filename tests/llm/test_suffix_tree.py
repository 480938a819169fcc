import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from difftide.llm import suffix_tree
from difftide.llm.queries import QUERIES
from difftide.llm.suffix_tree import GAIN, LEAST, POWER, PRIOR

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HELD = "crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)) % 7 = 2"


def brute(docs, depth=2):
    """The rows by the definition for (doc_id, text) rows, and the probability of a word after a context."""
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in docs]
    every = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None] for _, t in docs]
    count = Counter(w for h, t in zip(held, every) if not h for w in t)
    n, v = count.total(), len(count)
    follow = defaultdict(Counter)
    for h, t in zip(held, every):
        for k in range(0 if h else 1, 0 if h else len(t)):
            for size in range(1, min(depth, k) + 1):
                follow[tuple(t[k - size : k])][t[k]] += 1
    states = {}

    def prob(context, w):
        for size in range(len(context), 0, -1):
            if (s := context[-size:]) in states:
                found, seen, weight = states[s]
                return (found[w] + weight * prob(s[1:], w)) / (seen + weight)
        return (count[w] + 1) / (n + v + 1)

    for size in range(1, depth + 1):
        for s, found in [x for x in follow.items() if len(x[0]) == size]:
            seen, weight = found.total(), PRIOR * found.total() ** POWER
            if seen >= LEAST and sum(c * math.log((c - 1 + weight * (q := prob(s[1:], w))) / ((seen - 1 + weight) * q)) for w, c in found.items()) > GAIN:
                states[s] = found, seen, weight
    rows = [
        (k, h, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10(prob((), w)) for w in t), sum(math.log10(prob(tuple(t[max(0, j - depth) : j]), w)) for j, w in enumerate(t)))
        for (k, _), h, t in zip(docs, held, every)
    ]
    return rows, prob, count, states


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], rel=1e-9)


def cases():
    rng = np.random.default_rng(3)
    docs = []
    for k in range(300):
        w, text = "a", []
        for _ in range(rng.integers(0, 40)):
            w = {"a": "Bc", "b": "aab", "c": "aé"}.get(w.lower(), "abcé")[rng.integers(0, 2)] if rng.random() < 0.9 else f"w{rng.integers(0, 50)}"
            text.append(w)
        docs.append((k, " ".join(text) + "\t\n" * (k % 3)))
    docs += [docs[9]] * 20 + [(None, "a b\x0bc\x85d"), (None, None), (300, ""), (301, " \n "), (302, "a " * 50_000), (303, "x" * 100_000), (2, "a b c other words")]
    return docs


def test_against_brute_force(spark):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in cases()], "doc_id long, text string, words string, block int").repartition(5)
    for depth in (1, 2, 3):
        got = suffix_tree.scores(df, HELD, depth=depth)
        assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        want, _, _, states = brute(cases(), depth)
        assert any(len(s) == depth for s in states)
        same(got.collect(), want)


def test_a_distribution():
    """After any context, the probabilities of all words, the end and one unknown word sum to one."""
    _, prob, count, states = brute(cases())
    for context in [(), ("nothing",), ("a",), ("b", "a"), *list(states)[:20]]:
        assert sum(prob(context, w) for w in count) + prob(context, "never seen") == pytest.approx(1)


def test_several_blocks_and_one_give_the_same(spark, monkeypatch):
    """Blocks and shards only deal the work out."""
    docs = cases()
    texts, held = [t for _, t in docs], np.array([r[1] for r in brute(docs)[0]])
    n = sum(r[2] for r in brute(docs)[0] if not r[1])

    def run(cuts, shards):
        blocks = [suffix_tree.Block(*suffix_tree.tokens(pa.array(texts[a:b], pa.string()))[:2], suffix_tree.tokens(pa.array(texts[a:b], pa.string()))[2], held[a:b]) for a, b in zip(cuts, cuts[1:])]
        v = len(brute(docs)[2])
        turns = [suffix_tree.replay(b, n, v) for b in blocks]
        asked = [next(t) for t in turns]
        for turn in range(5):
            told = [(np.zeros(len(q.sums), np.int64), np.zeros(len(q.sums), np.int64)) for q in asked]
            dealt = [q.shards(shards) for q in asked]
            for s in range(shards):
                at = [np.flatnonzero(d == s) for d in dealt]
                keys = [q.keys[k] for q, w in zip(asked, at) for k in w] if not turn else [np.concatenate([q.keys[j][w] for q, w in zip(asked, at)]) for j in range(len(asked[0].keys))]
                sums, ids = suffix_tree.answer(asked[0].kind, keys, np.concatenate([q.sums[w] for q, w in zip(asked, at)]), s)
                for t, w, e in zip(told, at, np.cumsum([len(w) for w in at])):
                    t[0][w], t[1][w] = sums[e - len(w) : e], ids[e - len(w) : e]
            assert turn or v == sum(int((t[0] >> 62).sum()) for t in told)
            asked = [t.send(x) for t, x in zip(turns, told)]
        return [np.concatenate(x) for x in zip(*asked)]

    want = brute(docs)[0]
    for cuts, shards in (([0, len(docs)], 1), ([0, 1, 2, 50, 51, 200, len(docs)], 7)):
        known, base, score = run(cuts, shards)
        assert known.tolist() == [r[3] for r in want]
        assert base == pytest.approx([r[5] for r in want]) and score == pytest.approx([r[6] for r in want])


def test_packed_and_back():
    """Words, keys, sums and ids of any kind and order come back; those that lie as in a block take few bytes."""
    rng = np.random.default_rng(5)
    for v in (np.zeros(0, np.int64), np.full(9, -1), rng.integers(-(2**63), 2**63 - 1, 999), rng.integers(0, 2, 999) * suffix_tree.OWNER + suffix_tree.SOLE + 3):
        assert suffix_tree.spread(suffix_tree.squeeze(v)).tolist() == v.tolist()
    words = [b"", b"a" * 300, b"a" * 299 + b"b", *sorted({f"w{k}é".encode() for k in range(5000)}), b"a"]
    for some in ([b""], words, words[::-1]):
        assert suffix_tree.unpack_words(suffix_tree.pack_words(some)) == some
    assert len(suffix_tree.pack_words(words)) < len(suffix_tree.zstandard.ZstdCompressor(level=1).compress(b" ".join(words)))

    first, second, which = suffix_tree.distinct(rng.integers(0, 900, 60_000), rng.integers(0, 20_000, 60_000), 20_000)
    at = np.flatnonzero(rng.random(len(first)) < 0.3)
    for keys in ((first, second), (rng.permutation(first), rng.permutation(second)), (first << 36, second << 36)):
        back = suffix_tree.unpack_keys("pair", *suffix_tree.pack_keys("pair", keys, at))
        assert all((x == k[at]).all() for x, k in zip(back, keys))
        assert (suffix_tree.unpack_keys("context", *suffix_tree.pack_keys("context", keys[:1], at))[0] == keys[0][at]).all()
    assert sum(map(len, suffix_tree.pack_keys("pair", (first, second), at))) < 2.2 * len(at)

    asked = rng.integers(0, 4, 5000)
    others = rng.integers(0, 9, 5000)
    told = np.where(others == 0, asked + suffix_tree.SOLE + np.where(asked > 0, suffix_tree.OWNER, 0), asked + others + rng.integers(0, 2, 5000) * suffix_tree.OWNER)
    assert (suffix_tree.unpack_sums("pair", suffix_tree.spread(suffix_tree.pack_sums("pair", told, asked)), asked) == told).all()
    ids = np.where(rng.random(5000) < 0.5, np.arange(5000), -1)
    for kind, some in (("word", rng.permutation(ids)), ("pair", ids), ("pair", rng.permutation(ids)), ("last", np.full(9, -1)), ("pair", ids[:0])):
        assert (suffix_tree.unpack_ids(kind, suffix_tree.pack_ids(kind, some)) == some).all()
    assert len(suffix_tree.pack_ids("pair", ids)) < 0.6 * len(ids)


def test_distinct_beyond_63_bits():
    for top in (1 << 20, 1 << 44):
        first, second = np.array([top, 3, top, 0, 3]), np.array([1, 7, 1, 0, 6])
        a, b, which = suffix_tree.distinct(first, second, 1 << 17)
        assert (a.tolist(), b.tolist(), which.tolist()) == ([0, 3, 3, top], [0, 6, 7, 1], [3, 2, 3, 0, 1])


def test_shuffle_files_go_with_their_round(spark):
    """Rounds end in stored tables, so nothing that they shuffled stays on disk, and the session is as before."""

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(suffix_tree.CLEANUP)
    suffix_tree.scores(spark.createDataFrame([(k, t) for k, t in cases()[:50]], "doc_id long, text string").repartition(3), HELD)
    end = time.time() + 3  # files are removed in the background
    while shuffled() - before and time.time() < end:
        time.sleep(0.5)
    assert not shuffled() - before
    assert spark.conf.get(suffix_tree.CLEANUP) == setting


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, None)], "doc_id long, text string")
    assert suffix_tree.scores(df.limit(0), HELD).count() == 0
    rows = suffix_tree.scores(df, "true").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in sorted(rows)] == [(5, 0, 0, 0.0), (1, 0, 0, 0.0)]


def test_the_query(spark):
    """All rows as by the definition; texts held out are likelier by the tree than by their words alone."""
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op11_language_model"](spark, sf_dir).collect()
    same(rows, brute(docs)[0])
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
