import public_tokenizers
import pytest
from tokenizers import Tokenizer

from difftide.llm.token_counts import RunCounter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")

TEXTS = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\n b", "a\t \nb\x1c c \x1f", "x   y    z  ", "it's we'll 'tis 's", "    nb sp", "naïve café ÑANDÚ straße",
    "日本語 テキスト 漢字", "🙂🙂 👩‍👩‍👧 flag", "end<|endoftext|> and  <|endoftext|>  more <|endoftext|>", "12345 3.14 1,000", "՘ ՘x ₏ Ᲊ", "z" * 5000, "ab " * 3000, "!!! --- ...", "é ́x",
]


def test_equals_the_library(spark):
    tok = Tokenizer.from_file(PATH)
    rows = [(k, t, 7) for k, t in enumerate(TEXTS)] + [(3, "  ", 7), (None, "null id here", 7)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    want = [(k, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for k, t, _ in rows]
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_caches_stay_bounded_and_right():
    tok = Tokenizer.from_file(PATH)
    counter = RunCounter(PATH, {})
    counter.lengths.limit = counter.pre_tokens.limit = 5
    text = " ".join(f"word{k % 17} Other{k}" for k in range(200))
    assert counter.count(text) == len(tok.encode(text, add_special_tokens=False).ids)
    assert len(counter.lengths) <= 5


@pytest.mark.parametrize("gap", [" ", "  ", "\n", " \n", "\t ", "\n ", " ", "  ", "\x1c", " \x1c ", "　 "])
def test_gaps(gap):
    tok = Tokenizer.from_file(PATH)
    counter = RunCounter(PATH, {})
    for text in (f"a{gap}b", f"{gap}a", f"a{gap}", f"1{gap}'s", f"!{gap}{gap}?"):
        assert counter.count(text) == len(tok.encode(text, add_special_tokens=False).ids), repr(text)
