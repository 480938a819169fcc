"""Language-model scores from a probabilistic suffix tree over words.

The tree's states are contexts of up to ``DEPTH`` words; the root is the smoothed word distribution. A context becomes
a state if the words that follow it diverge from what its longest shorter state expects: the training tokens are
coded by the state, each left out of the state's own counts, and the state must save ``GAIN`` nats. A state's
distribution is smoothed by the distribution of that shorter state, which stands for ``PRIOR`` (or a power of the context's
count) further observations, so every state gives a proper distribution over all words, the end and one unknown word. A
token is scored by the longest state that is a suffix of its history.

Neither vocabulary nor tree is ever in one place. The corpus is coded once into blocks of documents, each with a
dictionary of its own words. A round asks one thing of the whole corpus: a block sends its different keys (words, pairs of
context and word, contexts) with its own sums, packed by shard; a shard sums them over all blocks and answers every
block. Keys are dealt by their whole hash, so the pairs of a frequent context lie in all shards. A block that alone has
a word or a pair, in training or held out, is told so; what ends in it is counted there and not asked, unless it may
be a context. Blocks are replayed with the answers that they have so far, up to the next question.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from difftide.llm.common import record_batch, stored, whole_groups
from difftide.llm.words import LOWER, byte_class, flat, gathered_batches, spans

DEPTH = 2  # words in the longest context
LEAST = 8  # training occurrences that a context needs to be considered
PRIOR = 4.0  # weight of the shorter state: PRIOR * count of the context ** POWER
POWER = 0.75
GAIN = 2.0  # nats that a state has to save
UNIT = 1 << 16  # savings are summed as whole numbers of nats / UNIT, so their order can't matter
BLOCK = 4 << 20  # bytes of text in a block, or one document
SHARD = 2 << 20  # tokens of the corpus for each shard of a round
OWNER, SOLE = 1 << 62, 1 << 61  # added to a key's sum: this block has to count it once for all; no other block has it
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ZIP, UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

#: Words are runs of all bytes but 9 to 13 and 32.
WORD = byte_class((0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF))
END = b""  # the token after a text's last word


def zipped(parts: list[bytes]) -> bytes:
    """The parts one after the other, each compressed with a code of its own."""
    out = ZIP.compressobj(size=sum(map(len, parts)))
    return b"".join([x for part in parts for x in (out.compress(part), out.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK))] + [out.flush()])


def squeeze(values: np.ndarray) -> bytes:
    """64-bit values, the sign in the lowest bit, compressed byte by byte without the bytes that are zero in all."""
    signed = values.astype(np.int64)
    folded = (signed << 1) ^ (signed >> 63)
    some = int(np.bitwise_or.reduce(folded)) if len(values) else 0
    used = [k for k in range(8) if some >> 8 * k & 255]
    head = len(values).to_bytes(4, "little") + bytes([sum(1 << k for k in used)])
    return head + zipped([folded.view(np.uint8)[k::8].tobytes() for k in used])


def spread(packed: bytes) -> np.ndarray:
    n, used = int.from_bytes(packed[:4], "little"), [k for k in range(8) if packed[4] >> k & 1]
    folded = np.zeros(n, np.int64)
    for k, plane in zip(used, np.frombuffer(UNZIP.decompress(packed[5:]), np.uint8).reshape(len(used), n)):
        folded.view(np.uint8)[k::8] = plane
    return (folded >> 1 & (1 << 63) - 1) ^ -(folded & 1)


def pack_words(words: list[bytes]) -> bytes:
    """Words without spaces, each without what it shares (up to 255 bytes) with the one before it."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    data, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
    same = np.zeros(len(words), np.uint8)
    at = np.arange(1, len(words))
    for k in range(255):
        at = at[(size[at] > k) & (size[at - 1] > k)]
        at = at[data[start[at] + k] == data[start[at - 1] + k]]
        if not len(at):
            break
        same[at] += 1
    ends = b" ".join([w[k:] for w, k in zip(words, same.tolist())])
    return len(words).to_bytes(4, "little") + zipped([same.tobytes(), ends])


def unpack_words(packed: bytes) -> list[bytes]:
    n, raw = int.from_bytes(packed[:4], "little"), UNZIP.decompress(packed[4:])
    words, word = [], b""
    for k, end in zip(raw[:n], raw[n:].split(b" ")):
        word = word[:k] + end
        words.append(word)
    return words


def pack_keys(kind: str, keys: list[bytes] | tuple[np.ndarray, ...], at: np.ndarray) -> tuple[bytes, bytes]:
    """The keys at these places. First integers mostly ascend, and so do second ones of the same first: steps are small."""
    if kind == "word":
        return pack_words([keys[k] for k in at.tolist()]), b""
    first = np.diff(keys[0][at], prepend=0)
    if len(keys) == 1:
        return squeeze(first), b""
    second = keys[1][at]
    return squeeze(first), squeeze(np.where(first == 0, np.diff(second, prepend=0), second))


def unpack_keys(kind: str, first: bytes, second: bytes) -> list[bytes] | tuple[np.ndarray, ...]:
    if kind == "word":
        return unpack_words(first)
    steps = spread(first)
    if kind == "context":
        return (np.cumsum(steps),)
    values = spread(second)
    total = np.cumsum(values)
    new = steps != 0
    new[:1] = True
    return np.cumsum(steps), total - (total - values)[new][np.cumsum(new) - 1]


def pack_sums(kind: str, told: np.ndarray, asked: np.ndarray) -> bytes:
    """What all other blocks add to the sums asked about, and who is the owner; zero if no other block asks."""
    return squeeze(told if kind == "context" else np.where(told & SOLE > 0, 0, (((told & SOLE - 1) - asked) << 1) + (told & OWNER > 0) + 1))


def unpack_sums(kind: str, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if kind == "context":
        return values
    alone = asked + np.where(asked > 0, OWNER + SOLE, SOLE)
    return np.where(values == 0, alone, asked + (values - 1 >> 1) + (values - 1 & 1) * OWNER)


def pack_ids(kind: str, ids: np.ndarray) -> bytes:
    """Ids as they are for words, otherwise different and mostly ascending ones by their steps; zero for -1."""
    if kind == "word":
        return squeeze(ids + 1)
    steps = np.zeros(len(ids), np.int64)
    steps[ids >= 0] = np.diff(ids[ids >= 0], prepend=-1)
    return squeeze(steps)


def unpack_ids(kind: str, packed: bytes) -> np.ndarray:
    values = spread(packed)
    return np.where(values != 0, (values if kind == "word" else np.cumsum(values)) - 1, -1)


@dataclass
class Block:
    """Documents in token codes: ``words`` by code, ``codes`` of all tokens, ``sizes`` of documents, ``held`` out or not."""

    words: list[bytes]
    codes: np.ndarray
    sizes: np.ndarray
    held: np.ndarray


@dataclass
class Question:
    """Different keys of a block (words, or one or two integers each) and its own sum for each."""

    kind: str  # "word", "pair", "last" (pairs that are no contexts, as none are longer) or "context"
    keys: list[bytes] | tuple[np.ndarray, ...]
    sums: np.ndarray

    def shards(self, n: int) -> np.ndarray:
        if self.kind == "word":
            return np.fromiter(map(zlib.crc32, self.keys), np.int64, len(self.keys)) % n
        mixed = np.zeros(len(self.sums), np.uint64)
        for k in self.keys:
            mixed = (mixed ^ k.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return (mixed % np.uint64(n)).astype(np.int64)


def ranks(order: np.ndarray) -> np.ndarray:
    """The place of each index in ``order``."""
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def by_count(counts: np.ndarray) -> np.ndarray:
    """The order by falling count, equal ones as they lie."""
    return np.argsort((65535 - np.minimum(counts, 65535)).astype(np.uint16), kind="stable")


def by_shard(shard: np.ndarray) -> np.ndarray:
    """The order by shard, those of one shard as they lie; numbers of two bytes sort much faster."""
    return np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")


def by_id(ids: np.ndarray) -> np.ndarray:
    """The order by ids, all -1 first as they lie."""
    some = np.flatnonzero(ids >= 0)
    return np.concatenate([np.flatnonzero(ids < 0), some[np.argsort(ids[some])]])


def distinct(first: np.ndarray, second: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second) of the different pairs in order, and which of them each pair is; ``second`` lies below ``n``."""
    keys, bits = first * n + second, len(first).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 63:
        pairs, which = np.unique(keys, return_inverse=True)
    else:  # sorting values with their places in the low bits is much faster than sorting places
        both = np.sort(keys << bits | np.arange(len(keys)))
        new = np.diff(both >> bits, prepend=-1) > 0
        pairs, which = both[new] >> bits, np.empty(len(keys), np.int64)
        which[both & (1 << bits) - 1] = np.cumsum(new) - 1
    return pairs // n, pairs % n, which


def tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different words in order, the tokens' codes, tokens of each text); every text has an end."""
    data, edges = flat(texts)
    data = LOWER[data]
    starts, ends, first = spans(data, edges, WORD)
    length = np.insert(ends - starts, first[1:], 0)
    offsets = np.concatenate([[0], np.cumsum(length)])
    inside = data[WORD[data]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(inside)])
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    return coded.dictionary.take(order).to_pylist(), ranks(order.to_numpy())[coded.indices.to_numpy()], np.diff(first) + 1


def answer(kind: str, keys: Sequence, sums: np.ndarray, shard: int, gain: float = GAIN, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(sum, id) for every key of every block that asked a shard, in the order given.

    The id is unique over all shards; -1 for pairs too rare to be a context or of the last round, and for as rare words that
    one block alone has, as nothing more is asked about them. Within a shard, ids go by falling sum for words and by key
    for pairs, so a block's keys have small or near ids. ``OWNER`` is added
    for the first block that brings a key, so each key has one owner, and ``SOLE`` if no other asks about it. For contexts the sum is 1 if they become states.
    """
    if kind == "word":
        code = pa.array(keys, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    else:
        code = np.zeros(len(sums), np.int64)
        for k in keys:
            inner, values = pd.factorize(k)
            code = pd.factorize(code * len(values) + inner)[0]
    total = np.zeros(code.max() + 1 if len(code) else 0, np.int64)
    np.add.at(total, code, sums)
    if kind == "context":
        return (total > gain * UNIT).astype(np.int64)[code], np.full(len(code), -1)
    brought = np.flatnonzero(sums > 0)
    owner = np.zeros(len(sums), np.int64)
    first = np.full(len(total), -1)
    first[code[brought][::-1]] = brought[::-1]
    owner[first[first >= 0]] = OWNER
    owner[np.bincount(code, minlength=len(total))[code] == 1] += SOLE
    ids = np.full(len(total), -1)
    if kind == "word":
        often = np.argsort(-total, kind="stable")
        often = often[(total[often] >= least) | (np.bincount(code, minlength=len(total))[often] > 1)]
        ids[often] = (shard << 36) + np.arange(len(often))
    elif kind == "pair":
        often = np.flatnonzero(total >= least)
        at = np.empty(len(total), np.int64)
        at[code[::-1]] = np.arange(len(code))[::-1]
        ids[often[np.lexsort([k[at[often]] for k in keys[::-1]])]] = (shard << 36) + np.arange(len(often))
    return total[code] + owner, ids[code]


def replay(block: Block, all_tokens: int, all_words: int, depth: int = DEPTH, least: int = LEAST) -> Generator[Question | tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray], None]:
    """The block's questions in turn, and at last (known tokens, base score, score) of each document.

    Each question is to be answered by (sum, id) arrays in the order of its keys.
    """
    n_words, codes = len(block.words), block.codes
    training = np.repeat(~block.held, block.sizes)
    told, word_id = yield Question("word", block.words, np.bincount(codes[training], minlength=n_words))
    order = by_id(word_id)  # from here on, words and contexts lie by their ids, and so do the keys asked about
    codes, told, word_id = ranks(order)[codes], told[order], word_id[order]
    count = told & SOLE - 1
    sole = (told & SOLE > 0)[codes]  # no other block has the token's longest suffix asked about so far
    base = ((count + 1) / (all_tokens + all_words + 1))[codes]
    p = base.copy()
    first = np.zeros(len(codes), bool)
    first[np.cumsum(block.sizes)[:-1]] = True
    first[:1] = True
    before = np.where(first, -1, np.concatenate([[-1], codes[:-1]]))  # each token's context, as a place in the two arrays below
    context_id, context_n = word_id, count
    for longer in range(depth - 1, -1, -1):
        at = np.flatnonzero(before >= 0)
        at = at[context_n[before[at]] >= least]
        context, word, which = distinct(before[at], codes[at], n_words)
        told = np.bincount(which[training[at]], minlength=len(word))
        here = np.empty(len(word), bool)
        here[which] = sole[at]  # the same for all tokens of a pair
        ask = np.flatnonzero(~here | (told >= least if longer else False))
        pair_id = np.full(len(word), -1, np.int64)
        told += np.where(told > 0, OWNER + SOLE, SOLE)
        told[ask], pair_id[ask] = yield Question("pair" if longer else "last", (context_id[context[ask]], word_id[word[ask]]), told[ask] & SOLE - 1)
        mine, n = np.flatnonzero(told & OWNER), told & SOLE - 1
        sole[at] = (told & SOLE > 0)[which]
        shorter = np.empty(len(word))
        shorter[which] = p[at]  # the same for all tokens of a pair, as it depends on the context's own suffixes
        seen = context_n[context].astype(np.float64)
        weight = PRIOR * seen**POWER
        new = np.diff(context, prepend=-1) > 0  # pairs are sorted by context
        of, c = np.cumsum(new) - 1, n[mine]
        saved = c * np.log((c - 1 + weight[mine] * shorter[mine]) / ((seen[mine] - 1 + weight[mine]) * shorter[mine]))
        told, _ = yield Question("context", (context_id[context[new]],), np.bincount(of[mine], np.rint(saved * UNIT), int(new.sum())).astype(np.int64))
        p[at] = np.where(told[of] > 0, (n + weight * shorter) / (seen + weight), shorter)[which]
        own = np.full(len(codes), -1, np.int64)
        order = by_id(pair_id)
        own[at] = ranks(order)[which]
        before = np.where(first, -1, np.concatenate([[-1], own[:-1]]))
        context_id, context_n = pair_id[order], np.where(pair_id >= 0, n, 0)[order]
    starts = np.cumsum(block.sizes) - block.sizes
    sums = [np.add.reduceat(x, starts) for x in ((count > 0)[codes].astype(np.int64), np.log10(base), np.log10(p))]
    yield tuple(sums)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (id, held, text) rows."""
    number = TaskContext.get().partitionId() << 33
    for batch in gathered_batches(batches, BLOCK):
        words, codes, sizes = tokens(batch.column(2))
        held = batch.column(1).to_numpy(zero_copy_only=False)
        counts = np.bincount(codes)
        codes = ranks(by_count(counts))[codes]  # frequent words get small numbers
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), pa.array([len(codes)], pa.int64()), pa.array([int(sizes[~held].sum())], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)), pa.array([zipped([b" ".join(words)])], pa.binary()),
                *[pa.array([squeeze(x)], pa.binary()) for x in (counts, codes, sizes, held)],
            ],
            names=["block", "n", "trained", "ids", "words", "counts", "codes", "sizes", "held"],
        )
        number += 1


def _block(batch: pa.RecordBatch, row: int) -> Block:
    get = lambda name: batch.column(name)[row].as_py()
    codes = by_count(spread(get("counts")))[spread(get("codes"))]
    return Block(UNZIP.decompress(get("words")).split(b" "), codes, spread(get("sizes")), spread(get("held")) > 0)


def _answered(block: Block, batch: pa.RecordBatch, row: int, rounds: int, labels: np.ndarray, numbers: tuple[int, int], depth: int) -> Question | tuple[np.ndarray, ...]:
    """``replay`` with the answers of the row's columns ``answers0``, ``answers1`` ..."""
    shards, place = len(labels), {label: k for k, label in enumerate(labels.tolist())}
    turn = replay(block, *numbers, depth)
    asked = next(turn)
    for k in range(rounds):
        order = by_shard(asked.shards(shards))
        parts = sorted(batch.column(f"answers{k}")[row].as_py() or [], key=lambda x: place[x["shard"]])
        told, ids = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        told[order] = unpack_sums(asked.kind, np.concatenate([np.zeros(0, np.int64), *[spread(x["sums"]) for x in parts]]), asked.sums[order])
        known = [(unpack_ids(asked.kind, x["ids"]), place[x["shard"]]) for x in parts]
        ids[order] = np.concatenate([np.zeros(0, np.int64), *[np.where(x >= 0, x * shards + at, -1) for x, at in known]])
        asked = turn.send((told, ids))
    return asked


def even_labels(spark: SparkSession, n: int, parts: int) -> np.ndarray:
    """``n`` different numbers that hash partitioning deals evenly to ``parts`` partitions."""
    drawn = spark.range(0, 16 * n + 64 * parts).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("part"))
    turn = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return np.array([r["id"] for r in drawn.withColumn("turn", turn).orderBy("turn", "part").limit(n).collect()], np.int64)


def _ask(rounds: int, labels: np.ndarray, numbers: tuple[int, int], depth: int):
    """Step over blocks with the answers of ``rounds`` rounds: (shard, block, first, second, sums) of the next question."""
    shards = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked = _answered(_block(batch, row), batch, row, rounds, labels, numbers, depth)
                shard = asked.shards(shards)
                order = by_shard(shard)
                cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
                rows = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)])]
                if rows:
                    keys = list(zip(*[pack_keys(asked.kind, asked.keys, r) for r in rows]))
                    yield record_batch(shard=labels[shard[order[cuts]]], block=pa.array([batch.column("block")[row].as_py()] * len(rows), pa.int64()), first=pa.array(keys[0], pa.binary()), second=pa.array(keys[1], pa.binary()), sums=pa.array([squeeze(asked.sums[r]) for r in rows], pa.binary()))

    return run


def _tell(kind: str):
    """Step over questions sorted by shard: (block, shard, sums, ids, owned) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in whole_groups(batches):
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                part = batch.slice(start, end - start)
                sums = [spread(x) for x in part.column("sums").to_pylist()]
                packed = [unpack_keys(kind, *x) for x in zip(part.column("first").to_pylist(), part.column("second").to_pylist())]
                keys = [w for x in packed for w in x] if kind == "word" else [np.concatenate(k) for k in zip(*packed)]
                total, ids = answer(kind, keys, np.concatenate(sums), 0)
                ends = np.cumsum([len(s) for s in sums])
                pieces = list(zip(ends - [len(s) for s in sums], ends))
                yield record_batch(block=part.column("block"), shard=part.column("shard"), sums=pa.array([pack_sums(kind, total[a:b], s) for (a, b), s in zip(pieces, sums)], pa.binary()), ids=pa.array([pack_ids(kind, ids[a:b]) for a, b in pieces], pa.binary()), owned=pa.array([int((total[a:b] & OWNER > 0).sum()) for a, b in pieces], pa.int64()))

    return run


def scores(docs: DataFrame, held_out: str, id_column: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """Score every whole text by a tree learnt from the rows for which the SQL condition ``held_out`` is not true.

    Returns ``id_column``, ``held_out``, ``n_tokens`` (words and the end), ``n_known`` (those seen in training), ``train_tokens``,
    ``base_score`` (log10 by smoothed word counts) and ``score`` (log10 by the tree), one row per input row. A null text is empty
    and has its end only; a null id keeps its row; repeated rows and ids each count. Without training rows every token
    is unknown. A text of any length is one document in one block. Only the id, the text and the columns of
    ``held_out`` are read, so further columns and their names don't matter. An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_column].dataType.simpleString()
    names: list[str] = []
    cleaned = spark.conf.get(CLEANUP, None)

    def by_block(df: DataFrame) -> DataFrame:
        """Stored in buckets of blocks, so rounds join blocks and answers in place."""
        names.append(f"difftide_llm_{uuid.uuid4().hex}")
        df.repartition(parts, "block").write.option("compression", "uncompressed").bucketBy(parts, "block").format("parquet").saveAsTable(names[-1])
        return spark.table(names[-1])

    slim = docs.select(F.col(id_column).alias("id"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    try:
        spark.conf.set(CLEANUP, "true")  # every round ends in a stored table; shuffle files go then and don't pile up from round to round
        blocks = by_block(slim.mapInArrow(_encode, f"block bigint, n bigint, trained bigint, ids array<{kind}>, words binary, counts binary, codes binary, sizes binary, held binary"))
        size = blocks.agg(F.sum("n").alias("n"), F.sum("trained").alias("trained")).first()
        all_tokens, all_words = size["trained"] or 0, 0
        labels = even_labels(spark, max(parts, (size["n"] or 0) // SHARD), parts)
        known = blocks
        for k, question in enumerate(["word", *["pair", "context"] * (depth - 1), *["last", "context"][: 2 * depth]]):
            asked = known.mapInArrow(_ask(k, labels, (all_tokens, all_words), depth), "shard bigint, block bigint, first binary, second binary, sums binary")
            dealt = asked.repartition(parts, "shard").sortWithinPartitions("shard", "block")
            told = dealt.mapInArrow(_tell(question), "block bigint, shard bigint, sums binary, ids binary, owned bigint")
            table = by_block(told.groupBy("block").agg(F.collect_list(F.struct("shard", "sums", "ids")).alias(f"answers{k}"), F.sum("owned").alias(f"owned{k}")))
            if question == "word":
                all_words = table.agg(F.sum("owned0")).first()[0] or 0
            known = known.join(table.drop(f"owned{k}"), "block", "left")
        rounds, numbers = 1 + 2 * depth, (all_tokens, all_words)

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    block = _block(batch, row)
                    n_known, base, score = _answered(block, batch, row, rounds, labels, numbers, depth)
                    yield record_batch(**{id_column: batch.column("ids")[row].values, "held_out": block.held, "n_tokens": block.sizes, "n_known": n_known, "train_tokens": np.full(len(n_known), all_tokens), "base_score": base, "score": score})

        return stored(known.mapInArrow(finish, f"`{id_column}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"))
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.conf.unset(CLEANUP) if cleaned is None else spark.conf.set(CLEANUP, cleaned)
