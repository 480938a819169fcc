import base64
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings, strategies as st

from difftide.llm import byte_bpe
from difftide.llm.byte_bpe import Encoder, Ranks, decode, encode, merge_replay

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIB = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", None, " ", "  ", "a  b ", "\0nul \0x", "it's  we'll\n\n ok", "naïve ÑANDÚ 漢字 🙂", "<|endoftext|> x", "a" * 3000, "ab" * 500 + " " + "é" * 700, "word, " * 900, "x\x1c \x1d y", "͸ ՠ Ᲊ"]


def test_round_trip_and_library(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(2, "again", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = decode(encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got)
    want = sorted((-1 if k is None else k, len(ids := LIB.encode_ordinary(t or "")), ids, (t or "").encode()) for k, t, _ in rows)
    assert have == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert decode(encode(df, PATH, public_tokenizers.PATTERN), PATH).count() == 0


def ids_of(encoder, texts):
    ids, ends = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab c'sé\n\t1!", max_size=60), min_size=1, max_size=8))
def test_any_text(texts):
    encoder = Encoder(PATH, public_tokenizers.PATTERN)
    assert ids_of(encoder, texts) == [LIB.encode_ordinary(t) for t in texts]


def naive(word, ranks):
    if word in ranks:
        return [ranks[word]]
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min(((ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == 1 << 60:
            break
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=2, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=25), st.lists(st.binary(max_size=30).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=10), st.randoms())
def test_any_ranks(tokens, words, rnd):
    """Ranks in any order: a merge may make a pair of lower rank."""
    tokens = list(dict.fromkeys(tokens))
    rnd.shuffle(tokens)
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(tokens)}
    words = [w for w in words if w not in ranks]
    ids, ends = merge_replay(words, Ranks(ranks))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [naive(w, ranks) for w in words]


def test_known_runs_stay_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN", 10)
    encoder = Encoder(PATH, public_tokenizers.PATTERN)
    for k in range(20):
        text = " ".join(f"w{k}x{j}" for j in range(7)) + " " + "q" * 100
        assert ids_of(encoder, [text]) == [LIB.encode_ordinary(text)]
        assert len(encoder.runs.new) <= 10 and all(len(r) <= 32 for r in [*encoder.runs.new, *encoder.words.new])
    assert ids_of(encoder, [""]) == [[]]


def test_every_character():
    """Classes of all characters, by the library."""
    encoder = Encoder(PATH, public_tokenizers.PATTERN)
    codes = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{chr(c)}a{chr(c)}{chr(c)} 1{chr(c)}\n" for c in codes[k : k + 50]) for k in [*range(0, 0x3000, 50), *range(0x3000, len(codes), 2350)]]
    assert ids_of(encoder, texts) == [LIB.encode_ordinary(t) for t in texts]
