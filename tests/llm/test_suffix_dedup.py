import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from difftide.llm import suffix_dedup as sd


def brute(rows):
    """(id, n, removed, spans, sha) of (id, text) rows: every window by every earlier one."""
    docs = sorted({(sd.NO_ID if i is None else i, (t or "").encode()) for i, t in rows}, key=lambda d: (d[0], _h(d[1])))
    seen, result = set(), {}
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        result[i, b] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return [(i, *result[sd.NO_ID if i is None else i, (t or "").encode()]) for i, t in rows]


def _h(data):
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(data, 42)).view(np.int64))


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(30) for _ in range(4)] + [text(16)[:99], text(18)[:100], text(19)[:101]]
    docs = [text(rng.randrange(5, 120)) for _ in range(40)]
    docs += [text(rng.randrange(0, 20)) + rng.choice(passages) + text(rng.randrange(0, 20)) for _ in range(60)]
    docs += [docs[k] for k in (0, 3, 3, 41, 42)] + [docs[k][: len(docs[k]) // 2] + " x " + docs[k][len(docs[k]) // 2 :] for k in range(0, 60, 3)]
    docs += ["a" * 700, "ab" * 300, "\0" * 130, "a" * 99, "a" * 100, "", None, passages[0], passages[0] + passages[0], passages[1] + "é" + passages[1][1:]]
    rng.shuffle(docs)
    return [*enumerate(docs), (None, docs[5]), (None, text(40)), (7, docs[7]), (8, text(30)), (8, docs[9])]


@pytest.mark.parametrize("segment", [1 << 20, 64])
def test_against_all_windows(spark, monkeypatch, segment):
    rows = corpus()
    if segment == 64:  # on the driver only: positions of anchors don't depend on segments
        data = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
        want = sd.anchors(data)
        monkeypatch.setattr(sd, "SEGMENT", 64)
        got = sd.anchors(data)
        assert (want[0] == got[0]).all() and (want[1] == got[1]).all()
        return
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string")
    got = sd.remove_repeats(df).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    assert not [t for t in spark.catalog.listTables() if "difftide_llm" in t.name]
    out = sd.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    removed = {r.doc_id: r.n_removed for r in got}
    for r in out.collect():
        if r.doc_id is not None and removed[r.doc_id] == 0 and r.doc_id not in (7, 8):
            assert r.text == rows[r.doc_id][1]


def test_frequent_grams_do_not_change_the_result(spark, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    line = " ".join(rng.choice(words) for _ in range(28))
    rows = [(k, " ".join(rng.choice(words) for _ in range(20 + k % 7)) + line + " ".join(rng.choice(words) for _ in range(9))) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(sd._frequent_grams(df.selectExpr("cast(text as binary) as body"))) > 0
    assert sorted(map(tuple, sd.remove_repeats(df).collect())) == sorted(brute(rows))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=6, max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=12), max_size=7))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    given_runs = [(r, sd.common_prefixes(np.array([list(x) for x in r], np.uint8).reshape(-1, 6)).tolist()) for r in runs]
    order, prefix = sd.merge_runs(given_runs, 6)
    merged = [runs[r][k] for r, k in order]
    assert merged == sorted(x for r in runs for x in r)
    for n in range(1, len(merged)):
        assert prefix[n] == next((k for k in range(6) if merged[n][k] != merged[n - 1][k]), 6)


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 100, 4000).astype(np.uint8)
    at, h = sd.anchors(base)
    assert (np.diff(at) <= sd.BEFORE + 1).all()
    other = np.concatenate([rng.integers(97, 100, 500).astype(np.uint8), base[700:1500]])
    inside = {int(p) - 500 + 700 for p in sd.anchors(other)[0] if 500 + 100 <= p <= 500 + 600}
    assert inside == {int(p) for p in at if 800 <= p <= 1300}
    assert all(len(x) == 0 for x in sd.anchors(base[:99])) and len(sd.anchors(base[:100])[0]) == 1


def test_spans_and_characters():
    s, e = sd.joined_spans(np.array([5, 0, 7, 20]), np.array([9, 2, 12, 30]))
    assert s.tolist() == [0, 5, 20] and e.tolist() == [2, 12, 30]
    data = "aéb".encode()
    assert sd.whole_characters(data, np.array([2]), np.array([4])) == "aé" and sd.whole_characters(data, np.array([0]), np.array([2])) == "éb"


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.remove_repeats(df).count() == 0 and sd.without_repeats(df).count() == 0


def test_columns_of_any_name_stay(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, "a", 1, "b", 2), (2, text, None, None, "b", 2), (None, None, "a", 1, "b", None), (3, "short", "a", 1, "b", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __kept string, __H int, h string, __id int")
    out = sd.without_repeats(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], (2, "", *rows[1][2:]), rows[2], rows[3]], key=str)
