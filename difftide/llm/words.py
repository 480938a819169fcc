"""Words of whole texts, found on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A-Z in lower case; all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """For each byte, whether it lies in one of the ranges, ends included."""
    inside = np.zeros(256, bool)
    for first, last in ranges:
        inside[first : last + 1] = True
    return inside


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts one after the other, the edges of each); a null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, edges, data = texts.buffers()
    at = np.frombuffer(edges, np.int64, len(texts) + 1, texts.offset * 8) if edges else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def spans(data: np.ndarray, edges: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the number of all words) of the longest runs of bytes ``inside``."""
    within = inside[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = within[:-1], within[1:]
    before[edges[:-1][edges[:-1] < len(data)]] = False
    after[edges[1:][edges[1:] > 0] - 1] = False
    starts = np.flatnonzero(within & ~before)
    return starts, np.flatnonzero(within & ~after) + 1, np.searchsorted(starts, edges)


def gathered_batches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes (or one row), small batches put together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            if held and size + part.nbytes > limit:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.concat_batches(held)
