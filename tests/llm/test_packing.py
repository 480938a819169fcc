import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from difftide.llm.packing import WordEncoder, fullest, pack_documents, packed, plan, unpacked_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "  ", "Hello, World!", "It's WE'LL 'tis", "naïve ÑANDÚ straße ŒUVRE ǅ", "漢字 🙂 ΣΑΣ İx", "end<|endoftext|>x <|startoftext|>", "a\x1cb \x1d c\xa0d\x85e", "é é", "word " * 5000, "z" * 4000, "1234 x"]


def test_documents(spark):
    tok = Tokenizer.from_file(PATH)
    rows = [(k, t, -1) for k, t in enumerate(TEXTS)] + [(None, "null id", -1), (3, "Hello, World!", -1)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length int"), PATH, window=64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        ids = unpacked_ids(r.ids)
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_doc[r.doc_id, r.doc_tokens].append((r.start, ids))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for k, t, _ in rows:
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[k, len(want)])
        if k != 3:
            assert [i for _, ids in parts for i in ids] == want
    assert len(by_doc[3, 5]) == 2
    assert sorted(by_seq) == list(range(len(by_seq)))
    for places in by_seq.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64


def test_encoder_is_the_library(spark):
    tok = Tokenizer.from_file(PATH)
    texts = [t or "" for t in TEXTS] + [chr(a) + "b" + chr(a) + " Q" + chr(a) for a in range(1, 0x250)]
    assert [unpacked_ids(x) for x in WordEncoder(PATH).encode(pa.array(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(0, 4), max_size=6), st.integers(1, 20))
def test_fullest_is_best_with_the_longest(counts, capacity):
    got = fullest(counts, capacity)
    fits = [n for n, c in counts.items() if c and n <= capacity]
    if not fits:
        assert got == {}
        return
    assert all(k <= counts[n] for n, k in got.items()) and got[max(fits)] >= 1
    sums = {max(fits)}
    for n, c in counts.items():
        for _ in range(c - (n == max(fits))):
            sums |= {s + n for s in sums if s + n <= capacity}
    assert sum(n * k for n, k in got.items()) == max(sums)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 300), max_size=30))
def test_plan_places_every_piece_once(counts):
    seen, sequences = defaultdict(list), defaultdict(list)
    for length, first, n, sequence, each, offset in plan(counts, 50):
        for k in range(n):
            seen[length].append(first + k)
            sequences[sequence + k // each].append((offset + k % each * length, length))
    assert {n: sorted(r) for n, r in seen.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    for places in sequences.values():
        ends = np.cumsum([0, *(n for _, n in sorted(places))])
        assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 50
    if counts.get(1, 0) >= 50 * sum(c for n, c in counts.items() if n > 1):  # enough ones to fill every gap
        assert sum(50 - sum(n for _, n in p) for p in sequences.values()) < 50


def test_hot_length_and_empty(spark):
    cut = spark.range(5000).selectExpr("id as doc_id", "0L as start", "if(id % 3 = 0, 5L, id % 7 + 1) as length")
    rows = packed(cut, window=16).collect()
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert len(rows) == 5000 and max(used.values()) <= 16 and len(used) == -(-sum(r.length for r in rows) // 16)
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_columns_of_any_name_stay(spark):
    rows = [(k, 0, k % 5 + 1, k, "r", 3.5, None if k % 2 else k, "s") for k in range(50)]
    cut = spark.createDataFrame(rows, "doc_id long, start long, length long, __rank long, __row string, offset double, Sequence_id long, __part string")
    out = packed(cut, window=8, sequence="to", offset="at")
    assert out.columns == [*cut.columns, "to", "at"] and sorted((tuple(r)[:8] for r in out.collect())) == sorted(rows)
    replaced = packed(cut, window=8)
    assert sorted(c.lower() for c in replaced.columns) == sorted(c.lower() for c in cut.columns)
    assert {(r.doc_id, r.length, r.sequence_id, r.offset) for r in replaced.collect()} == {(r.doc_id, r.length, r.to, r.at) for r in out.collect()}
