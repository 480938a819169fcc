"""Removal of repeated passages by a distributed merge sort of suffixes with common prefixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of smaller id, or
earlier in the same document. The steps, of which each is exact:

1. Documents equal to an earlier one go whole (if long enough); the others are written once, bucketed by document, so
   that no later step shuffles text.
2. Every window of ``LENGTH`` bytes has an anchor: its smallest ``GRAM``-byte hash. Equal windows have equal anchors
   at the same place, so only anchors whose hash occurs twice in the corpus can lie in a repeated window. Grams
   that are very frequent are taken last, so a common passage's edges have anchors in each document's own text.
3. The suffixes at those anchors (with the bytes before them) are sorted within each task; equal ones become one. The
   sorted runs are front-coded (each suffix without the prefix it shares with its predecessor) and exchanged.
4. Each receiver merges its runs by a loser tree that knows common prefixes: a match is decided by the lengths
   shared with the last suffix put out, and characters are only compared beyond what is known to be equal. The merge
   gives the common prefixes of neighbours, so the suffixes equal to a depth are an interval; with classes
   of the bytes before the anchor, each window's first occurrence is known, and all others are removed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difftide.llm.common import free_names, record_batch, stored, whole_groups

LENGTH = 100
GRAM = 32
BEFORE = LENGTH - GRAM  # an anchor lies at most so far from its window's start
SEGMENT = 1 << 20  # bytes that are hashed at once
FREQUENT = 1e-3  # share of a task's anchors from which a gram counts as frequent: at most 1,000 a task
DEMOTED = 1 << 16  # frequent grams taken last, at most; more would only cost time
NO_ID = -(1 << 63)  # a null id comes first

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS = {1 << k: np.uint64(pow(int(_ODD), 1 << k, 1 << 64)) for k in range(GRAM.bit_length())}


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, by doubling."""
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < GRAM:
        h, size = h[:-size] * _POWERS[size] + h[size:], 2 * size
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def _window_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from prefix and suffix minima of blocks of that width."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all windows; each depends on its window's bytes alone."""
    width, places, found = BEFORE + 1, [], []
    for start in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        h = _gram_hashes(data[start : start + SEGMENT + LENGTH - 1])
        order = (h >> np.uint64(22)) << np.uint64(21)  # the last bits hold the place: of equal hashes the first is taken
        at = np.arange(len(h), dtype=np.uint64)
        least = np.unique(_window_least(order | at, width) & np.uint64((1 << 21) - 1))
        if frequent is not None and len(frequent) and np.isin(h[least], frequent).any():
            order |= np.isin(h, frequent).astype(np.uint64) << np.uint64(63)
            least = np.unique(_window_least(order | at, width) & np.uint64((1 << 21) - 1))
        least = least.astype(np.int64)
        places.append(least + start)
        found.append(h[least])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(found)[first]


def merge_runs(runs: list[tuple[list[bytes], list[int]]], length: int = LENGTH) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs of byte strings of one length: ((run, index) in order, common prefix with the one before).

    A run comes with the common prefix of each string with its predecessor. The tree keeps, for each loser, what it
    shares with the winner that beat it; of two, the one sharing more with the last output is the
    smaller, and only on a tie are bytes beyond that prefix compared.
    """
    count = len(runs)
    size = 1
    while size < count:
        size *= 2
    strings, shared = [r[0] for r in runs], [r[1] for r in runs]
    place = [0] * size
    done = [k >= count or not strings[k] for k in range(size)]
    known = [0] * size  # prefix that a run's next string shares with the last output (or with its winner)
    losers = [0] * size

    def play(a: int, b: int) -> int:
        """The winner of two runs; the loser's known prefix grows to what it shares with the winner."""
        if done[a] or done[b]:
            return b if done[a] else a
        ka, kb = known[a], known[b]
        if ka != kb:
            return a if ka > kb else b
        x, y = strings[a][place[a]], strings[b][place[b]]
        p, q = int.from_bytes(x[ka:]), int.from_bytes(y[ka:])
        same = length - (((p ^ q).bit_length() + 7) >> 3)
        if p < q or (p == q and a < b):
            known[b] = same
            return a
        known[a] = same
        return b

    winners = [0] * (2 * size)
    winners[size:] = range(size)
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node] = play(a, b)
        losers[node] = b if winners[node] == a else a
    best = winners[1] if size > 1 else 0
    order: list[tuple[int, int]] = []
    prefix: list[int] = []
    while not done[best]:
        at = place[best]
        order.append((best, at))
        prefix.append(known[best])
        at += 1
        place[best] = at
        if at < len(strings[best]):
            known[best] = shared[best][at]
        else:
            done[best] = True
        node = (best + size) >> 1
        while node:
            other = losers[node]
            winner = play(best, other)
            if winner != best:
                losers[node], best = best, winner
            node >>= 1
    return order, prefix


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """The bytes that each row of a sorted byte matrix shares with the row before it (none for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def repeated_windows(prefix: np.ndarray, before: np.ndarray, room: np.ndarray, reach: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance from anchor to window start among each suffix's repeated windows (-1: none).

    Suffixes are in sorted order; ``prefix`` is what each shares with the one before, ``before`` the bytes before the
    anchors (nearest first), of which ``room`` exist, ``reach`` the bytes from the anchor on that exist, ``rank`` the
    order of occurrence. A window that starts ``a`` before its anchor equals another if both suffixes lie in
    one interval of depth LENGTH - a and the ``a`` bytes before them are equal.
    """
    n = len(prefix)
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    active = np.arange(n)
    classes = np.cumsum(prefix < GRAM)
    for a in range(BEFORE + 1):
        if a:
            keep = room[active] >= a
            active = active[keep]
            classes = classes[keep] * 256 + before[active, a - 1]
        if not len(active):
            break
        _, classes, sizes = np.unique(classes, return_inverse=True, return_counts=True)
        keep = sizes[classes] > 1  # alone now, alone with more bytes too
        active, classes = active[keep], classes[keep]
        depth = LENGTH - a
        fit = reach[active] >= depth
        rows = active[fit]
        if not len(rows):
            continue
        interval = np.cumsum(prefix < depth)
        key = classes[fit] * (n + 1) + interval[rows]
        order = np.lexsort((rank[rows], key))
        later = np.zeros(len(rows), bool)
        later[order[1:]] = key[order][1:] == key[order][:-1]
        hit = rows[later]
        least[hit] = np.where(least[hit] < 0, a, least[hit])
        most[hit] = a
    return least, most


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays, as one compressed value."""
    parts = [a.tobytes() for a in arrays.values()]
    head = np.array([len(p) for p in parts], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpack(value: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    ends = np.cumsum(np.frombuffer(raw[: 8 * len(kinds)], np.int64)) + 8 * len(kinds)
    return [np.frombuffer(raw[a:b], kind) for kind, a, b in zip(kinds, [8 * len(kinds), *ends], ends)]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    for value in batch.column(column).to_pylist():
        yield np.frombuffer(value, np.uint8)


def _frequent_grams(texts: DataFrame) -> np.ndarray:
    """Grams that are frequent in some task, hence all that are frequent in the corpus; bounded in number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            fresh = [np.zeros(0, np.uint64)]
            for data in _texts(batch, 0):
                fresh.append(np.unique(anchors(data)[1]))  # once for each document
            h = np.concatenate(fresh)
            total += len(h)
            held, inverse = np.unique(np.concatenate([held, h]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, np.ones(len(h), np.int64)]), len(held)).astype(np.int64)
            some = counts > FREQUENT / 2 * total  # the rest can't matter enough; memory stays bounded
            held, counts = held[some], counts[some]
        often = counts > max(FREQUENT * total, 16)
        if often.any():
            yield record_batch(gram=pa.array(held[often].view(np.int64)), n=pa.array(counts[often]))

    rows = texts.mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "gram").limit(DEMOTED).collect()
    return np.sort(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))


def _repeated_anchors(texts: DataFrame, frequent: Broadcast, parts: int) -> DataFrame:
    """(id, h, places): anchors whose hash occurs more than once, as packed positions; several rows a document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(data, frequent.value) for data in _texts(batch, 2)]
            sizes = [len(p) for p, _ in found]
            if not sum(sizes):
                continue
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at, h = np.concatenate([p for p, _ in found]), np.concatenate([x for _, x in found])
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            part = (h % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
            rows = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)])]
            blobs = []
            for r in rows:
                docs, inside = np.unique(doc[r], return_inverse=True)
                blobs.append(_pack(hash=h[r], doc=np.diff(inside, prepend=0).astype(np.int32), at=at[r].astype(np.int64), keys=key[:, docs]))
            yield record_batch(part=pa.array(part[order[cuts]]), anchors=pa.array(blobs, pa.binary()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in whole_groups(batches):
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                packed = batch.column(1).slice(start, end - start).to_pylist()
                every = np.concatenate([_unpack(b, "u8", "i4", "i8", "i8")[0] for b in packed])
                every.sort()
                twice = np.unique(every[1:][every[1:] == every[:-1]])
                if not len(twice):
                    continue
                for b in packed:
                    h, step, at, keys = _unpack(b, "u8", "i4", "i8", "i8")
                    place = np.searchsorted(twice, h)
                    hit = twice[np.minimum(place, len(twice) - 1)] == h
                    if not hit.any():
                        continue
                    doc, at, keys = np.cumsum(step)[hit], at[hit], keys.reshape(2, -1)
                    docs, first = np.unique(doc, return_index=True)
                    yield record_batch(id=pa.array(keys[0, docs]), h=pa.array(keys[1, docs]), places=pa.array([at[x:y].tobytes() for x, y in zip(first, [*first[1:], len(at)])], pa.binary()))

    dealt = texts.mapInArrow(emit, "part bigint, anchors binary").repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(find, "id bigint, h bigint, places binary")


def _covered(least: np.ndarray, most: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the windows between two distances from the anchor: they overlap, so it is one span."""
    return at - most, at - least + LENGTH


def _runs(texts: DataFrame, parts: int) -> DataFrame:
    """(part, run): sorted, front-coded runs of suffixes, and spans that a task's own copies already give."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            key, at, room, reach = [], [], [], []
            for k, (data, places) in enumerate(zip(_texts(batch, 2), batch.column(3).to_pylist())):
                p = np.sort(np.concatenate([np.frombuffer(x, np.int64) for x in places]))
                padded = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
                rows.append(padded[p[:, None] + np.arange(BEFORE + LENGTH)])
                key.append(np.full(len(p), k))
                at.append(p)
                room.append(np.minimum(p, BEFORE))
                reach.append(np.minimum(len(data) - p, LENGTH))
            context, key, at, room, reach = (np.concatenate(x) for x in (rows, key, at, room, reach))
            whole = np.concatenate([context[:, BEFORE:], context[:, :BEFORE][:, ::-1], np.stack([room, reach], axis=1).astype(np.uint8)], axis=1)
            view = np.ascontiguousarray(whole).view(np.dtype((np.void, whole.shape[1]))).ravel()
            order = np.lexsort((at, hs[key], ids[key], np.unique(view, return_inverse=True)[1]))
            fresh = np.ones(len(order), bool)
            fresh[1:] = view[order][1:] != view[order][:-1]
            again = order[~fresh]  # in this task an equal one is earlier
            order = order[fresh]
            again = again[reach[again] + room[again] >= LENGTH]
            start, end = _covered(np.maximum(LENGTH - reach[again], 0), room[again], at[again])
            gram = np.ascontiguousarray(whole[order, :GRAM]).view(np.uint64)
            part = gram[:, 0] * _ODD
            for c in range(1, gram.shape[1]):
                part = (part ^ gram[:, c]) * _ODD
            part = ((part ^ (part >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)
            numbers, blobs = [], []
            for n in np.unique(part):
                r = order[part == n]
                suffix = whole[r, :LENGTH]
                shared = common_prefixes(suffix)
                tail = suffix[np.arange(LENGTH) >= shared[:, None]]
                numbers.append(n)
                blobs.append(_pack(shared=shared.astype(np.uint8), tail=tail, before=whole[r, LENGTH : LENGTH + BEFORE], room=room[r].astype(np.uint8), reach=reach[r].astype(np.uint8), id=ids[key[r]], h=hs[key[r]], at=at[r]))
            if numbers:
                yield record_batch(part=pa.array(np.array(numbers, np.int64)), run=pa.array(blobs, pa.binary()), spans=pa.array([None] * len(numbers), pa.binary()))
            if len(again):
                yield record_batch(part=pa.array([int(part[0]) if len(part) else 0], pa.int64()), run=pa.array([None], pa.binary()), spans=pa.array([_pack(id=ids[key[again]], h=hs[key[again]], start=start, end=end)], pa.binary()))

    return texts.mapInArrow(emit, "part bigint, run binary, spans binary")


def _merged(runs: DataFrame, parts: int) -> DataFrame:
    """(id, h, start, end): spans to remove, by merging each part's runs."""

    def spans(ids: np.ndarray, hs: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        return record_batch(id=pa.array(ids), h=pa.array(hs), start=pa.array(start), end=pa.array(end))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in whole_groups(batches):
            for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
                opened, columns = [], []
                for run, ready in zip(batch.column(1).slice(first, last - first).to_pylist(), batch.column(2).slice(first, last - first).to_pylist()):
                    if ready is not None:
                        yield spans(*_unpack(ready, "i8", "i8", "i8", "i8"))
                        continue
                    shared, tail, before, room, reach, ids, hs, at = _unpack(run, "u1", "u1", "u1", "u1", "u1", "i8", "i8", "i8")
                    ends = np.cumsum(LENGTH - shared.astype(np.int64)).tolist()
                    flat, strings, previous = tail.tobytes(), [], b""
                    for s, a, b in zip(shared.tolist(), [0, *ends], ends):
                        previous = previous[:s] + flat[a:b]
                        strings.append(previous)
                    opened.append((strings, shared.tolist()))
                    columns.append((before.reshape(-1, BEFORE), room, reach, ids, hs, at))
                if not opened:
                    continue
                order, prefix = merge_runs(opened)
                base = np.cumsum([0, *(len(c[1]) for c in columns)])
                place = np.array([base[r] + k for r, k in order], np.int64)
                before, room, reach, ids, hs, at = (np.concatenate(c)[place] for c in zip(*columns))
                rank = np.empty(len(at), np.int64)
                rank[np.lexsort((at, hs, ids))] = np.arange(len(at))
                least, most = repeated_windows(np.array(prefix, np.int64), before, room.astype(np.int64), reach.astype(np.int64), rank)
                hit = least >= 0
                if hit.any():
                    start, end = _covered(least[hit], most[hit], at[hit])
                    yield spans(ids[hit], hs[hit], start, end)

    return runs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge, "id bigint, h bigint, start bigint, end bigint")


def joined_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans as one, in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def whole_characters(data: bytes, starts: np.ndarray, ends: np.ndarray) -> str:
    """The text that stays if a character goes only when all its bytes go."""
    kept, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]]).decode()


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``id_column``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row; ``kept`` if asked for.

    ``kept`` is the text without the removed bytes; a character that is removed in part stays whole in it. A null text
    counts as empty (its ``kept`` is empty). A null id comes before all others. Rows of one id and text are
    one document and get the same result; of different texts under one id, one (always the same) comes first.
    A very long text is hashed in segments and judged whole. An empty table gives no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keyed = docs.select(F.col(id_column).cast("long").alias("doc"), body.alias("body"))
    keyed = keyed.select("doc", F.coalesce("doc", F.lit(NO_ID)).alias("id"), F.xxhash64("body").alias("h"), "body")
    base = stored(keyed.select("doc", "id", "h", F.unhex(F.sha2("body", 256)).alias("sha"), F.octet_length("body").cast("long").alias("n")))
    first = base.groupBy("sha").agg(F.min(F.struct("id", "h")).alias("first"))
    marked = stored(base.join(first, "sha").withColumn("copy", F.struct("id", "h") != F.col("first")).drop("first"))
    name = f"difftide_llm_{uuid.uuid4().hex}"
    unique = marked.where(~F.col("copy") & (F.col("n") >= LENGTH)).select("id", "h").distinct()
    long = keyed.where(F.octet_length("body") >= LENGTH).select("id", "h", "body")
    long.join(unique, ["id", "h"]).dropDuplicates(["id", "h"]).repartition(parts, "id", "h").write.option("compression", "zstd").bucketBy(parts, "id", "h").sortBy("id", "h").format("parquet").saveAsTable(name)
    try:
        texts = spark.table(name)
        frequent = spark.sparkContext.broadcast(_frequent_grams(texts.select("body")))
        places = _repeated_anchors(texts.select("id", "h", "body"), frequent, parts).groupBy("id", "h").agg(F.collect_list("places").alias("places"))
        runs = _runs(texts.join(places, ["id", "h"]).select("id", "h", "body", "places"), parts)
        spans = _merged(runs, parts).groupBy("id", "h").agg(F.collect_list("start").alias("start"), F.collect_list("end").alias("end"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                removed, count, sha, kept = [], [], [], []
                for data, s, e in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                    start, end = joined_spans(np.array(s, np.int64), np.array(e, np.int64))
                    removed.append(int((end - start).sum()))
                    count.append(len(start))
                    digest = hashlib.sha256()
                    for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)]):
                        digest.update(data[a:b])
                    sha.append(digest.digest())
                    kept.append(whole_characters(data, start, end) if with_text else None)
                yield record_batch(id=batch.column(0), h=batch.column(1), removed=pa.array(removed, pa.int64()), spans=pa.array(count, pa.int64()), kept_sha=pa.array(sha, pa.binary()), kept=pa.array(kept, pa.string()))

        result = stored(texts.join(spans, ["id", "h"]).select("id", "h", "body", "start", "end").mapInArrow(cut, "id bigint, h bigint, removed bigint, spans bigint, kept_sha binary, kept string"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    whole = F.col("copy") & (F.col("n") >= LENGTH)
    out = marked.join(result, ["id", "h"], "left").select(
        F.col("doc").alias(id_column), "h", F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
    return out if with_text else out.drop("h", "kept")


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each text cut down to what no earlier document or passage has; null texts stay null.

    All rows and columns stay, whatever the columns are called; ids, ties and repeated rows count as in ``remove_repeats``.
    """
    own, digest, rest = free_names(docs.columns, "__id", "__h", "__kept")
    key = [F.col(id_column).eqNullSafe(F.col(own)), F.xxhash64(F.col(text).cast("binary")) == F.col(digest)]
    changed = remove_repeats(docs, id_column, text, with_text=True).where("n_removed > 0")
    changed = changed.select(F.col(id_column).alias(own), F.col("h").alias(digest), F.col("kept").alias(rest)).dropDuplicates([own, digest])
    return docs.join(changed, key[0] & key[1], "left").withColumn(text, F.coalesce(rest, text)).select(docs.columns)
