import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from difftide.llm.sharding import Rooms, best_fit_decreasing, fixed_shards, shard_documents


def brute(classes, capacity):
    rooms, out = [], []
    for size in sorted((s for s, n in classes for _ in range(n)), reverse=True):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= size]
        if fits:
            k = min(fits)[1]
        else:
            rooms.append(max(capacity, size))
            k = len(rooms) - 1
        rooms[k] -= size
        out.append((size, k))
    return out, rooms


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=10), st.integers(5, 40))
def test_best_fit(classes, capacity):
    runs = best_fit_decreasing(classes.items(), capacity)
    flat = [(s, k) for s, n, k in runs for _ in range(n)]
    want, rooms = brute(classes.items(), capacity)
    assert sorted(s for s, _ in flat) == sorted(s for s, _ in want)
    load = Counter()
    for s, k in flat:
        load[k] += s
    assert sorted(load.values()) == sorted(_loads(want)) and len(load) == len(rooms)


def _loads(placed):
    load = Counter()
    for s, k in placed:
        load[k] += s
    return [load[k] for k in sorted(load)]


def test_tree():
    rooms = Rooms()
    for k in range(50):
        rooms.add(k * 7 % 50, k)
    room, shard = rooms.tightest(13)
    assert room == 13
    rooms.remove(room, shard)
    assert rooms.tightest(13)[0] == 14 and rooms.tightest(50) is None and rooms.widest()[0] == 49


def test_shards_are_near_equal():
    classes = [(s, 40) for s in range(10, 400, 7)]
    load = Counter()
    for s, n, k in fixed_shards(classes, 24):
        load[k] += s * n
    assert len(load) == 24 and max(load.values()) - min(load.values()) <= 400
    load = Counter()
    for s, n, k in fixed_shards([*classes, (10**6, 1)], 24):
        load[k] += s * n
    del load[0]
    assert len(load) == 23 and max(load.values()) - min(load.values()) <= 400


def test_documents(spark):
    texts = [None, "", "", None] + ["copy of one"] * 40 + [f"text {k} " * (k % 50) for k in range(800)] + ["ü" * 9000]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(5, "copy of one", 1), (None, "x", 1)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, slot int"), 8).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((-1 if k is None else k, len(b := (t or "").encode()) + 8, zlib.crc32(b)) for k, t, _ in rows)
    slots, groups, load = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        groups[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sorted(slots) == list(range(8))
    assert all(len(g) == 1 for g in groups.values())
    assert sorted(load.values())[-2] <= sorted(load.values())[0] * 1.02


def test_capacity_empty_and_bad_arguments(spark):
    df = spark.createDataFrame([(k, "x" * 92) for k in range(10)] + [(k, f"{k}" * 92) for k in range(5)], "doc_id long, text string")
    rows = shard_documents(df, None, 250).collect()
    assert Counter(r.shard for r in rows)[0] == 10 and len({r.shard for r in rows}) == 4
    assert shard_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        shard_documents(df, 3, 3)
