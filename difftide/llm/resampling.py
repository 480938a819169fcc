"""Importance resampling towards a target distribution, over hashed word runs.

Every feature (a run of one to ``LONGEST`` words) falls into one of ``BUCKETS`` buckets. Each task folds its texts into
one array of bucket counts, so only arrays are summed. The gains of the buckets are an array too, sent with
the scoring step: a document's weight is the sum of its features' gains. CRCs of features are put together from the
CRCs of their words (appending n bytes to a text is a linear map of its CRC), so no feature is ever built as text.

The rows to draw are found by a distributed quickselect: random keys of the rows still in question are pivots, an exact
three-way count (before, equal, after each) narrows them to the k-th key, and only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from difftide.llm.common import arrow_map, global_rank, record_batch, slices, stored
from difftide.llm.words import LOWER, byte_class, flat, spans

BUCKETS = 10_000
LONGEST = 3  # words in a feature
PIVOTS = 15  # random keys of a round of the quickselect
_DIGIT = 64  # appended lengths are taken apart in this base

#: Words are runs of digits, letters a-z and bytes beyond ASCII; the reversed CRC-32 polynomial.
WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


_BYTE = _byte_table()


def _mapped(tables: np.ndarray, which: np.ndarray | int, c: np.ndarray) -> np.ndarray:
    """The linear maps ``which`` of ``tables`` (by map, byte of the value, value of that byte) applied to ``c``."""
    rows = tables.reshape(-1)
    base = np.asarray(which, np.int64) * 1024
    out = rows[base + (c & 255)]
    for k in (1, 2, 3):
        out = out ^ rows[base + (256 * k) + (c >> np.uint32(8 * k) & 255)]
    return out


def _powers(step: np.ndarray) -> np.ndarray:
    """Tables of a linear map applied 0 to 63 times, from the table of one application."""
    out = np.empty((_DIGIT, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, _DIGIT):
        out[n] = _mapped(step[None], 0, out[n - 1].reshape(-1)).reshape(4, 256)
    return out


def _one_zero() -> np.ndarray:
    unit = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    return _BYTE[unit & 255] ^ unit >> np.uint32(8)


_TABLES = [_powers(_one_zero())]  # by digit of the length: maps of 0..63, 64 * 0..63, ... zero bytes


def appended(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What remains of each CRC ``c`` after ``n`` more bytes; XOR with the CRC of those bytes gives the whole's."""
    out = _mapped(_TABLES[0], n % _DIGIT, c)
    digit, rest = 0, n // _DIGIT
    while rest.any():
        digit += 1
        if digit == len(_TABLES):
            last = _TABLES[-1]
            step = _mapped(last, 1, last[_DIGIT - 1].reshape(-1)).reshape(4, 256)
            _TABLES.append(_powers(step))
        some = np.flatnonzero(rest % _DIGIT)
        out[some] = _mapped(_TABLES[digit], rest[some] % _DIGIT, out[some])
        rest = rest // _DIGIT
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every word. Words of a length advance together; long ones go to zlib one by one."""
    length = ends - starts
    out = np.empty(len(starts), np.uint32)
    long = np.flatnonzero(length >= _DIGIT)
    raw = data.tobytes() if len(long) else b""
    for k in long.tolist():
        out[k] = zlib.crc32(raw[starts[k] : ends[k]])
    short = np.flatnonzero(length < _DIGIT)
    order = short[np.argsort(-length[short].astype(np.int16), kind="stable")]
    at, c = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    reach = np.searchsorted(-length[order], -np.arange(_DIGIT), side="left")  # words longer than j
    for j in range(_DIGIT):
        n = reach[j]
        if not n:
            break
        c[:n] = _BYTE[(c[:n] ^ data[at[:n] + j]) & 255] ^ c[:n] >> np.uint32(8)
    out[order] = ~c
    return out


def bucket_runs(texts: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, list[np.ndarray]]:
    """(first word of each text and the number of all, for each run length the bucket of the run that starts at a word).

    Runs that reach into the next text are in the arrays too; ``within`` tells where a text's own end.
    """
    data, edges = flat(texts)
    data = LOWER[data]
    starts, ends, first = spans(data, edges, WORD)
    crc = word_crcs(data, starts, ends)
    length = ends - starts
    after_space = appended(np.full(len(crc), zlib.crc32(b" "), np.uint32), length) ^ crc
    out, run = [(crc % np.uint32(buckets)).astype(np.int64)], crc
    for n in range(1, longest):
        run = appended(run[:-1], length[n:] + 1) ^ after_space[n:]
        out.append((run % np.uint32(buckets)).astype(np.int64))
    return first, out


def within(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the words at which runs of ``n`` words start, for each text."""
    return first[:-1], np.maximum(first[:-1], first[1:] - n + 1)


def bucket_counts(docs: DataFrame, text: str, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task sends one array; ``buckets`` sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                first, runs = bucket_runs(part.column(0), longest, buckets)
                for n, run in enumerate(runs, 1):
                    start, end = within(first, n)
                    step = np.zeros(len(run) + 1, np.int64)
                    np.add.at(step, np.minimum(start, len(run)), 1)
                    np.add.at(step, np.minimum(end, len(run)), -1)
                    total += np.bincount(run[np.cumsum(step[:-1]) > 0], minlength=buckets)
        some = np.flatnonzero(total)
        if len(some):
            yield record_batch(bucket=pa.array(some), n=pa.array(total[some]))

    rows = docs.select(text).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in rows:
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket, in doubles."""
    every, wanted, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(every + n) / (float(s + 1) * float(wanted + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_column: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, weight) of every row: the sum of the gains of the text's features."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, runs = bucket_runs(batch.column(1), longest, len(gains))
        features, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for n, run in enumerate(runs, 1):
            sums = np.concatenate([[0], np.cumsum(gains[run])])
            start, end = within(first, n)
            features += end - start
            weight += sums[np.minimum(end, len(run))] - sums[np.minimum(start, len(run))]
        return record_batch(id=batch.column(0), n_words=np.diff(first), n_features=features, weight=weight)

    return arrow_map(docs.select(F.col(id_column).alias("id"), text), step, f"id {docs.schema[id_column].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def kth_key(rows: DataFrame, key: Sequence[str], k: int, seed: int = 42, pivots: int = PIVOTS) -> Row:
    """The k-th smallest key (from 1) of ``rows``, whose first column has no nulls; in others nulls are smallest.

    The driver sees pivots and their counts only.
    Rows whose keys are equal are counted as equal, so any number of them is fine. Each round reads the rows between the
    nearest pivots (their first column is a filter that reaches the scan) and keeps a 16th of them on average.
    """
    whole = F.struct(*key)

    def lit(row: Row) -> Column:
        return F.struct(*[F.lit(row[c]).cast(rows.schema[c].dataType).alias(c) for c in key])

    low: Row | None = None
    high: Row | None = None
    before = turn = 0
    while True:
        live = rows
        if low is not None:
            live = live.where((F.col(key[0]) >= F.lit(low[key[0]])) & (whole > lit(low)))
        if high is not None:
            live = live.where((F.col(key[0]) <= F.lit(high[key[0]])) & (whole < lit(high)))
        drawn = live.select(*key).distinct().orderBy(F.xxhash64(F.lit(seed + turn), *key), *key).limit(pivots).collect()
        order = sorted(drawn, key=lambda r: [(r[c] is not None, r[c]) for c in key])
        place = F.lit(0)
        for row in order:
            place = place + F.when(whole > lit(row), 2).when(whole == lit(row), 1).otherwise(0)
        counts = {r["place"]: r["n"] for r in live.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}
        for at in range(2 * len(order) + 1):
            if before + counts.get(at, 0) >= k:
                break
            before += counts.get(at, 0)
        else:
            raise ValueError("fewer rows than k")
        if at % 2:
            return order[at // 2]
        low = order[at // 2 - 1] if at else low
        high = order[at // 2] if at // 2 < len(order) else high
        turn += 1


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Draw ``percent`` of the documents of ``least_words`` words or more, likelier the more they look like ``target``.

    Returns every row's id (named ``id_column``), ``n_features``, ``weight``, ``score`` (weight plus noise of a double exponential, made from
    sha256 of seed and id) and ``rank`` (1, 2, 3 ... by falling score, then id; null where it isn't drawn). A null text has
    no words, a text without words weighs 0; a word may be as long as its text. A null id is hashed as an empty id and comes
    first in ties. Repeated rows and ids stay rows of their own, told apart by where they are stored. An empty table gives
    no rows, an empty target a weight that only fits rarer buckets. Only the columns named are read.
    """
    gains = bucket_gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weights(docs, gains, id_column, text).withColumn("score", F.col("weight") + noise)
    rows = stored(scored.withColumns({"falling": -F.col("score"), "row": F.monotonically_increasing_id()}))
    fit = F.col("n_words") >= least_words
    drawn = percent * rows.where(fit).count() // 100
    out = [F.col("id").alias(id_column), "n_features", "weight", "score"]
    if not drawn:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    key = ["falling", "id", "row"]
    last = kth_key(rows.where(fit).select(*key), key, drawn, seed)
    won = fit & (F.struct(*key) <= F.struct(*[F.lit(last[c]).cast(rows.schema[c].dataType).alias(c) for c in key]))
    ranked = global_rank(rows.where(won), key, "rank")
    return ranked.select(*out, (F.col("rank") + 1).cast("long").alias("rank")).unionByName(rows.where(~won).select(*out, F.lit(None).cast("long").alias("rank")))
