"""Packing of token sequences by minimum bin slack.

Every document is cut into full windows and one remainder. Remainders of one length are alike, so packing
needs only how many there are of each length: a histogram of at most ``window`` entries, whatever the
corpus. For one window after the other, a subset-sum dynamic programme over bitsets (bit s: the sum s can be
reached) picks the multiset of remaining lengths that comes closest to the capacity; going back through the
bitsets gives its counts. A pattern is repeated as often as the histogram allows. The plan says which
ranks within a length go where, so the pieces themselves never leave Spark's partitions.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difftide.llm.common import arrow_map, free_names, gathered, global_rank, record_batch, stored
from difftide.llm.token_counts import Bounded, byte_characters

WINDOW = 2_048

#: How the word-level vocabulary cuts a lower-case text.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

#: RE2: characters that only the library itself handles (beyond Latin, or separators that libraries class differently).
ODD = r"[^\x00-\x{17F}]|[\x1c-\x1f\x{85}\x{A0}\x{130}]"


class WordEncoder:
    """Ids of whole texts by a word-level vocabulary that drops white space: words are independent."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(WORD)
        self.characters = byte_characters()
        self.pieces = Bounded(self._piece, {})
        self.words = Bounded(self._word, {})

    def _piece(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.characters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(mapped)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(word)))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. Words of all texts are looked up once each."""
        odd = pc.match_substring_regex(texts, ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(pa.array(~odd))))
        words = plain.flatten().dictionary_encode()
        found = list(map(self.words.__getitem__, words.dictionary.to_pylist()))
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        ids, ends = gathered(np.frombuffer(b"".join(found), "<u4"), sizes, words.indices.to_numpy())
        edges = np.concatenate([[0], ends])[plain.offsets.to_numpy() - plain.offsets[0].as_py()]
        encoded = iter([ids[a:b].tobytes() for a, b in zip(edges, edges[1:])])
        return [self.whole(texts[k].as_py()) if o else next(encoded) for k, o in enumerate(odd)]


_ENCODERS: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, path: str, end: int = 1, window: int = WINDOW, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's ids and ``end``, cut into full windows and a remainder.

    One row per piece: the id, ``start``, ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens``. A null or empty
    text is the end id alone. Null and repeated ids keep their rows; other columns are not read.
    """
    close = np.array([end], "<u4").tobytes()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path)
        ids = [x + close for x in _ENCODERS[path].encode(batch.column(1))]
        row = [k for k, x in enumerate(ids) for _ in range(0, len(x), 4 * window)]
        start = [s for x in ids for s in range(0, len(x) // 4, window)]
        cut = [ids[k][4 * s : 4 * (s + window)] for k, s in zip(row, start)]
        return record_batch(
            **{id_column: batch.column(0).take(pa.array(row, pa.int64()))}, start=pa.array(start, pa.int64()), length=pa.array([len(c) // 4 for c in cut], pa.int64()),
            ids=pa.array(cut, pa.binary()), doc_tokens=pa.array([len(ids[k]) // 4 for k in row], pa.int64()), ids_crc32=pa.array([zlib.crc32(c) for c in cut], pa.int64()),
        )

    slim = docs.select(id_column, F.coalesce(F.col(text), F.lit("")).alias("body"))
    return arrow_map(slim, step, f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, ids_crc32 bigint")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of available lengths whose sum is as near below ``capacity`` as can be.

    The longest length that fits is always part of it (it would only get harder to place later). Lengths enter
    longest first and in powers of two, so each step is one shift of the bitset of reachable sums; the
    programme ends as soon as the capacity itself is reached.
    """
    longest = max((n for n, c in counts.items() if c and n <= capacity), default=0)
    if not longest:
        return {}
    gap, mask = capacity - longest, (1 << (capacity - longest + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= gap), reverse=True):
        left, chunk = min(counts[length] - (length == longest), gap // length), 1
        while left > 0 and not reach >> gap & 1:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            left, chunk = left - take, 2 * chunk
        if reach >> gap & 1:
            break
    total, used = reach.bit_length() - 1, {longest: 1}
    for length, take, earlier in reversed(steps):
        if not earlier >> total & 1:  # the sum needs this step
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go: (length, first rank, pieces, first sequence, pieces of that length in one sequence, offset).

    Pieces of a length are taken by rank. ``pieces`` of them from ``first rank`` on fill sequences from ``first
    sequence`` on, so many in each, side by side from ``offset`` on.
    """
    left, taken, out, sequence = {n: c for n, c in counts.items() if c}, dict.fromkeys(counts, 0), [], 0
    while left:
        pattern = fullest(left, window)
        times = min(left[n] // k for n, k in pattern.items())
        offset = 0
        for length, each in pattern.items():
            out.append((length, taken[length], times * each, sequence, each, offset))
            taken[length] += times * each
            offset += length * each
            left[length] -= times * each
            if not left[length]:
                del left[length]
        sequence += times
    return out


def packed(cut: DataFrame, window: int = WINDOW, order: tuple[str, ...] = ("doc_id", "start"), length: str = "length", sequence: str = "sequence_id", offset: str = "offset") -> DataFrame:
    """``cut`` (pieces of 1 to ``window`` tokens) with its sequence (gapless from 0) and the offset in it.

    ``order`` breaks ties among pieces of one length; pieces that are equal in it too may swap places. The
    driver gets the histogram of lengths (``window`` entries at most) and makes the plan from it. Columns of the caller stay,
    but for those called ``sequence`` or ``offset``, which the result replaces: name the new ones otherwise to keep both.
    An empty table gives no rows; repeated rows and nulls in other columns are pieces like any other.
    """
    rank_at, to_sequence, to_offset = free_names(cut.columns, "__rank", "__sequence", "__offset")
    ranked = stored(global_rank(stored(cut), [F.col(length).desc(), *order], rank_at))  # stored: ranges are sampled first
    counts = {r[length]: r["n"] for r in ranked.groupBy(length).agg(F.count("*").alias("n")).collect()}
    first = dict(zip(sorted(counts, reverse=True), np.cumsum([0, *(counts[n] for n in sorted(counts, reverse=True))])[:-1].tolist()))
    rows = sorted((first[n] + rank, each, turn, n, place) for n, rank, _, turn, each, place in plan(counts, window))
    table = ranked.sparkSession.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 5))
    at = ranked.schema.names.index(rank_at)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rank = batch.column(at).to_numpy()
        start, each, to, size, place = table.value[np.searchsorted(table.value[:, 0], rank, "right") - 1].T
        turn, slot = np.divmod(rank - start, each)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(to + turn), pa.array(place + slot * size)], names=[*batch.schema.names, to_sequence, to_offset])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)
    placed = arrow_map(ranked, step, f"{schema}, `{to_sequence}` bigint, `{to_offset}` bigint")
    return placed.drop(rank_at, sequence, offset).withColumnsRenamed({to_sequence: sequence, to_offset: offset})


def unpacked_ids(value: bytes) -> list[int]:
    """Ids of a piece, for readers outside Spark."""
    return np.frombuffer(value, "<u4").tolist()


def pack_documents(docs: DataFrame, path: str, end: int = 1, window: int = WINDOW, id_column: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places. Sequences not full to ``window`` are padded by the reader.

    With ``keep_ids`` false the ids themselves are left out after their checksum is taken, so that only
    numbers move. A null text counts as empty and is one piece, its end. Null and repeated ids keep their rows, and every
    row is packed; pieces equal in length, id and start may swap places. A very long text is tokenized whole and becomes as
    many pieces as it fills. An empty table gives no rows. Other columns are not read.
    """
    cut = pieces(docs, path, end, window, id_column, text)
    return packed(cut if keep_ids else cut.drop("ids"), window, (id_column, "start"))
