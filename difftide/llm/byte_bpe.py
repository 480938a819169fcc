"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

The corpus is replayed block by block: a block is the set of distinct pre-tokens of one Arrow batch that
the worker doesn't know yet. An inverted index leads from each token pair to the positions where the pair
stands in the block's words; pairs are taken in rank order, every position of a pair is merged, and only
the neighbours that a merge touched are indexed anew. Merges never cross a pre-token, so blocks are
independent, nothing is shuffled and a lost executor costs its own batches only.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difftide.llm.common import arrow_map, gathered, record_batch
from difftide.llm.token_counts import OTHER, PRE_TOKEN, cut

KNOWN = 1 << 17  # runs, and pre-tokens, whose ids a worker keeps, in each of two generations
RUN_CHARS = 32  # longest run that is kept
BLOCK = 6 << 20  # bytes of text that are replayed together, or one text
DECODED = 1 << 20  # bytes of ids that are decoded at once, or one text's


class Ranks:
    """A vocabulary of byte strings by rank, and the rank of the token that a pair of tokens makes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.rank = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: Rank of the joined token, by left << 32 | right: every token at every place where both halves are tokens.
        self.pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.bytes = np.array([[self.pairs.get(int(a) << 32 | int(b), -1) for b in self.byte] for a in self.byte], np.int64)

    @classmethod
    def read(cls, path: str) -> Ranks:
        """Lines of a base64 token, a blank and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def merge_replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, the ends of each): merges in rank order over all words at once.

    In a word the leftmost place comes first. A merge may make a pair of lower rank than the one being replayed; that
    pair then goes first, so each word sees exactly the order it would see alone.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(words), np.uint8)
    made = np.full(len(data), -1, np.int64)
    made[:-1] = ranks.bytes[data[:-1], data[1:]]
    made[ends[sizes > 0] - 1] = -1
    places = np.flatnonzero(made >= 0)[::-1]
    places = places[np.argsort(made[places], kind="stable")]  # by rank, last place first
    cuts = np.flatnonzero(np.diff(made[places], prepend=-1))
    #: The inverted index, by the pair's joined token: where the pair's left token stands.
    index: dict[int, list[int]] = {r: places[a:b].tolist() for r, a, b in zip(made[places[cuts]].tolist(), cuts, [*cuts[1:], len(places)])}
    after = np.arange(1, len(data) + 1)
    after[ends[sizes > 0] - 1] = -1
    before = np.arange(-1, len(data) - 1)
    before[(ends - sizes)[sizes > 0]] = -1
    ids, after, before, made, pair = ranks.byte[data].tolist(), after.tolist(), before.tolist(), made.tolist(), ranks.pairs.get
    waiting = list(index)
    heapq.heapify(waiting)
    while waiting:
        rank = heapq.heappop(waiting)
        places = index.get(rank)
        if places is None:
            continue
        places.sort(reverse=True)
        lower = False
        while places and not lower:
            at = places.pop()
            if made[at] != rank:
                continue  # an earlier merge took one of the two
            nxt = after[at]
            ids[at] = rank
            ids[nxt] = made[at] = made[nxt] = -1
            after[at] = beyond = after[nxt]
            left = before[at]
            if left >= 0:
                made[left] = new = pair(ids[left] << 32 | rank, -1)
                if new >= 0:
                    if new in index:
                        index[new].append(left)
                    else:
                        index[new] = [left]
                        heapq.heappush(waiting, new)
                    lower = new < rank
            if beyond >= 0:
                before[beyond] = at
                made[at] = new = pair(rank << 32 | ids[beyond], -1)
                if new >= 0:
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        heapq.heappush(waiting, new)
                    lower |= new < rank
        if places:
            heapq.heappush(waiting, rank)
        else:
            del index[rank]
    merged = np.array(ids, np.int64)
    return merged[merged >= 0], np.concatenate([[0], np.cumsum(merged >= 0)])[ends]


class Recent:
    """Values by key in two generations, so that what is used often stays when the rest has to go."""

    def __init__(self, limit: int) -> None:
        self.limit, self.new, self.old = limit, {}, {}

    def get(self, key: object) -> bytes | None:
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: object, value: bytes) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = value


class StandIns(dict):
    """For ``str.translate``: characters that the library's Unicode tables class otherwise than ours, as a
    common character of the library's class. Each character is tried out once, in the library itself."""

    LETTER, NUMBER, SPACE = map(regex.compile, (r"\p{L}", r"\p{N}", r"\s"))

    def __init__(self) -> None:
        super().__init__()
        pairs = [bytes([b]) for b in range(256)] + [p + bytes([b]) for p in (b"a", b"1", b"!") for b in range(256)]
        self.library = tiktoken.Encoding("classes", pat_str=PRE_TOKEN, mergeable_ranks={p: k for k, p in enumerate(pairs)}, special_tokens={})

    def __missing__(self, code: int) -> int:
        c = chr(code)
        ours = "a" if self.LETTER.match(c) else "1" if self.NUMBER.match(c) else "\n" if self.SPACE.match(c) else "!"
        theirs = next((x for x in "a1!" if self.library.encode_ordinary(x + c)[0] >= 256), "\n")  # joined: of one class
        self[code] = code if ours == theirs else ord(theirs)
        return self[code]


class Encoder:
    """Texts to ids; keeps what it knows of earlier blocks, within a bound."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = Ranks.read(path)
        self.pattern = regex.compile(pattern)
        self.stand_ins = StandIns()
        self.runs, self.words = Recent(KNOWN), Recent(KNOWN)

    def pre_tokens(self, text: str) -> list[str]:
        if not OTHER.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_ins))]

    def learn(self, texts: Iterable[str | tuple[str]], keep: set[str]) -> dict[str | tuple[str], bytes]:
        """Ids, as little-endian 32-bit integers, of runs; pre-tokens that no earlier block had are replayed as one block.

        A run that opens its text has no space before it and comes as a tuple. The pre-tokens of the runs ``keep`` are kept.
        """
        found = {r: self.pre_tokens(r[0] if isinstance(r, tuple) else " " + r) for r in texts}
        ids: dict[str, bytes] = {}
        block: dict[str, bytes] = {}
        for word in {w for pieces in found.values() for w in pieces}:
            known = self.words.get(word)
            if known is not None:
                ids[word] = known
                continue
            data = word.encode()
            whole = self.ranks.rank.get(data)
            if whole is None:
                block[word] = data
            else:
                ids[word] = whole.to_bytes(4, "little")
        merged, ends = merge_replay(list(block.values()), self.ranks)
        packed, at = merged.astype("<u4").tobytes(), 0
        for word, end in zip(block, ends.tolist()):
            ids[word] = packed[4 * at : 4 * end]
            at = end
        for run in keep:
            for word in found[run]:
                if word in block and len(word) <= RUN_CHARS:
                    self.words.put(word, ids[word])
        get = ids.__getitem__
        return {r: get(pieces[0]) if len(pieces) == 1 else b"".join(map(get, pieces)) for r, pieces in found.items()}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, the ends of each). The different runs of all texts are a block."""
        edges, at, different = cut(texts)
        first: dict[tuple[str], int] = {}
        at = at.astype(np.int64)
        for edge in edges[:-1].tolist():
            at[edge] = len(different) + first.setdefault((different[at[edge]],), len(first))
        block = [*different, *first]
        values = list(map(self.runs.get, block))
        # What stands once in a block is rarely seen again, and keeping it would drive out what is.
        often = set(map(different.__getitem__, np.flatnonzero(np.bincount(at, minlength=len(block))[: len(different)] > 1).tolist()))
        unknown = [r for r, v in zip(block, values) if v is None]
        keep = {r for r in unknown if r in often and len(r) <= RUN_CHARS}
        fresh = self.learn(unknown, keep)
        values = [fresh[r] if v is None else v for r, v in zip(block, values)]
        for r in keep:
            self.runs.put(r, fresh[r])
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids, ends = gathered(np.frombuffer(b"".join(values), "<u4"), sizes, at)
        return ids, ends[edges[1:] - 1]


_ENCODERS: dict[tuple[str, str], Encoder] = {}
_TOKENS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every whole text.

    ``path`` names a file of base64 tokens and ranks, ``pattern`` the pre-token pattern; it has to start a
    new match before a space that a visible character follows. A null or empty text has no ids. Null and
    repeated ids keep their rows; other columns are not read. A very long text is encoded whole, in one task. An empty table
    gives no rows.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if (path, pattern) not in _ENCODERS:
            _ENCODERS[path, pattern] = Encoder(path, pattern)
        ids, ends = _ENCODERS[path, pattern].encode(batch.column(1))
        edges = np.concatenate([[0], ends])
        packed = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((4 * edges).astype(np.int32)), pa.py_buffer(ids.tobytes())])
        return record_batch(**{id_column: batch.column(0), "n_tokens": pa.array(np.diff(edges)), "ids": packed})

    slim = docs.select(id_column, F.coalesce(F.col(text), F.lit("")).alias("body"))
    return arrow_map(slim, step, f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_tokens bigint, ids binary", BLOCK)


def _by_rank(token: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all tokens one after the other, the size of each) in order of rank; a rank without a token has size 0."""
    every = [token.get(r, b"") for r in range(max(token) + 1)]
    return np.frombuffer(b"".join(every), np.uint8), np.fromiter(map(len, every), np.int64, len(every))


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """The columns of ``encode`` and ``decoded``, the bytes that the ids stand for. Null ids stay null."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if path not in _TOKENS:
            _TOKENS[path] = _by_rank(Ranks.read(path).token)
        tokens, sizes = _TOKENS[path]
        packed = batch.column(2)
        _, edges, data = packed.fill_null(b"").cast(pa.large_binary()).buffers()
        edges = np.frombuffer(edges, np.int64, len(packed) + 1)
        ids = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]].view("<u4").astype(np.int64)
        if not sizes[ids].all():
            raise ValueError("an id is not in the vocabulary")
        flat, ends = gathered(tokens, sizes, ids)
        at = np.concatenate([[0], ends])[(edges - edges[0]) // 4]
        texts = pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat.tobytes())])
        texts = pc.if_else(packed.is_null(), pa.scalar(None, pa.binary()), texts) if packed.null_count else texts
        return pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    slim = encoded.select(id_column, "n_tokens", "ids")
    return arrow_map(slim, step, f"`{id_column}` {encoded.schema[id_column].dataType.simpleString()}, n_tokens bigint, ids binary, decoded binary", DECODED)
