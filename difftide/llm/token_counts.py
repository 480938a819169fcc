"""Token counts by a two-tier look-up of pre-token lengths.

A text is cut before every space that a visible character follows: byte-level patterns always start a
new pre-token there, so the pieces between are runs of whole pre-tokens. The number of tokens of a run is
looked up in two tiers. Tier one is a table of the most frequent runs, of fixed size, broadcast once. What
it misses is encoded by the tokenizer's own model and kept in a bounded cache of the Python worker, pre-token
by pre-token. No run or pre-token is ever shuffled; the tiers only save work and can't change a count.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difftide.llm.common import arrow_map, record_batch

FREQUENT = 32_768  # runs in the broadcast table
RUN_CHARS = 32  # longest run that the table or a cache holds: bounds the table to 32,768 * (32 * 4 + 1) bytes
SAMPLE_ROWS = 8_192  # rows that the table is learnt from, on average
SAMPLE_TASKS = 8
CACHED = 1 << 20  # runs and pre-tokens that a worker keeps

#: The pattern by which byte-level BPE cuts a text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_UNSAFE = re.compile(r" (?:\s|\Z)")
#: The same, and at the end of a text, for RE2: white space as Python has it.
_UNSAFE_RE2 = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|$)"
_CUT = re.compile(r" (?=\S)")
OTHER = re.compile(r"[^\x00-Ԁ]")  # beyond, libraries differ in the Unicode version of their classes


def runs(text: str) -> list[str]:
    """The text's runs; all but the first have lost the space before them."""
    return _CUT.split(text) if _UNSAFE.search(text) else text.split(" ")


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(edges of each text's runs, run numbers, the different runs) of texts without nulls; every text has a run."""
    split = pc.split_pattern(texts, " ")
    unsafe = pc.match_substring_regex(texts, _UNSAFE_RE2).to_numpy(zero_copy_only=False)
    if unsafe.any():
        by_hand = pa.array([runs(t) for t in texts.filter(pa.array(unsafe)).to_pylist()], split.type)
        order = np.empty(len(texts), np.int64)
        order[np.concatenate([np.flatnonzero(~unsafe), np.flatnonzero(unsafe)])] = np.arange(len(texts))
        split = pa.concat_arrays([split.filter(pa.array(~unsafe)), by_hand]).take(pa.array(order))
    flat = split.flatten().dictionary_encode()
    offsets = split.offsets.to_numpy()
    return offsets - offsets[0], flat.indices.to_numpy(), flat.dictionary.to_pylist()


def byte_characters() -> dict[int, int]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


class Bounded(dict):
    """Values by key, made when missing. Starts again from ``base`` when it is full; long keys are not kept."""

    def __init__(self, make: Callable[[str], object], base: dict, limit: int = CACHED, longest: int = RUN_CHARS) -> None:
        super().__init__(base)
        self.make, self.base, self.limit, self.longest = make, base, limit + len(base), longest

    def __missing__(self, key: str) -> object:
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.base)
            self[key] = value
        return value


class RunCounter:
    """Counts tokens of texts; one for each worker, tokenizer and table."""

    def __init__(self, path: str, table: dict[str, int]) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(PRE_TOKEN)
        self.characters = byte_characters()
        self.pre_tokens = Bounded(self._pre_token, {})
        self.lengths = Bounded(self._run, table)

    def _pre_token(self, piece: str) -> int:
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.characters)))

    def _run(self, run: str, space: str = " ") -> int:
        if OTHER.search(run):
            return self.whole(space + run)
        return sum(map(self.pre_tokens.__getitem__, self.pattern.findall(space + run)))

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = runs(text)
        return (self._run(first, "") if first else 0) + sum(map(self.lengths.__getitem__, rest))


_COUNTERS: dict[tuple[str, int], RunCounter] = {}


def _pack(table: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """The table as one text, the ends of its keys and its values: three flat buffers."""
    ends = np.cumsum([len(k) for k in table], dtype=np.uint32)
    return "".join(table).encode(), ends.tobytes(), np.array(list(table.values()), np.uint32).tobytes()


def _unpack(packed: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    text, ends = packed[0].decode(), np.frombuffer(packed[1], np.uint32).tolist()
    return dict(zip((text[a:b] for a, b in zip([0, *ends], ends)), np.frombuffer(packed[2], np.uint32).tolist()))


def _counter(path: str, table: Broadcast) -> RunCounter:
    key = (path, id(table.value))  # one object for each broadcast and worker
    if key not in _COUNTERS:
        _COUNTERS.clear()  # one table at a time
        _COUNTERS[key] = RunCounter(path, _unpack(table.value))
    return _COUNTERS[key]


def frequent_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> list[str]:
    """The most frequent runs of a sample: about SAMPLE_ROWS rows, chosen by a hash of their id.

    Each of SAMPLE_TASKS tasks sends its FREQUENT most frequent runs at most, so the driver gets a bounded
    number of rows. The sample decides how often tier one is hit and nothing else.
    """
    rows = docs.select(id_column).count()
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    chosen = F.pmod(F.xxhash64(id_column), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = docs.where(chosen & F.col(text).isNotNull()).select(text).repartition(SAMPLE_TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(runs(value)[1:])
                if len(seen) > 16 * FREQUENT:  # rare runs go; memory stays bounded
                    seen = Counter(dict(seen.most_common(4 * FREQUENT)))
        best = [(r, n) for r, n in seen.most_common(FREQUENT) if len(r) <= RUN_CHARS and n > 1]
        if best:
            yield record_batch(run=pa.array([r for r, _ in best], pa.string()), n=pa.array([n for _, n in best], pa.int64()))

    total: Counter[str] = Counter()
    for row in sample.mapInArrow(count, "run string, n bigint").toLocalIterator():
        total[row["run"]] += row["n"]
    return [r for r, _ in total.most_common(FREQUENT)]


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every whole text: ``id_column``, ``n_bytes`` (UTF-8), ``n_tokens``; one row per input row.

    ``path`` names a tokenizers file with a byte-level BPE that adds no space before the text. A null text
    counts as empty (0, 0). Strings of special tokens inside a text count as the library counts them. Null
    and repeated ids keep their rows; other columns of ``docs`` are not read. A very long text is counted whole, in one task.
    An empty table gives no rows.
    """
    first = RunCounter(path, {})
    table = docs.sparkSession.sparkContext.broadcast(_pack({r: first._run(r) for r in frequent_runs(docs, id_column, text)}))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _counter(path, table)
        counts = [counter.count(t) if t else 0 for t in batch.column(2).to_pylist()]
        return record_batch(**{id_column: batch.column(0), "n_bytes": batch.column(1), "n_tokens": pa.array(counts, pa.int64())})

    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(id_column, F.octet_length(body).cast("long").alias("n_bytes"), body.alias("body"))
    return arrow_map(slim, step, f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
