"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is centred on the mean of all vectors, normalised and turned by one random rotation; its code is
the sign of each coordinate, in packed bits, with two correction scalars: the distance to the centre and the
inner product of the unit vector with its own code. A query's inner product with a code, divided by that scalar,
estimates its inner product with the vector; the error has a known bound, so estimates give a lower bound for
every distance. A query's threshold is the upper bound of its k-th best estimate in the block; only candidates
whose lower bound is within it are reranked with their original vectors.

Queries and candidates meet in blocks of bounded size (query block, candidate block). Each block gives at most k
rows per query, of which the k best stay. No vector passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from difftide.llm.common import stored, usable

QUERY_BLOCK = 1_024  # queries that meet a candidate block at once, on average
CANDIDATE_BLOCK = 8_192  # candidates in a block, on average
ERROR = 2.5  # standard errors that a bound allows for
SEED = 20


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of the rows of ``x`` about ``centre``."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> None:
        self.dims = x.shape[1]
        off = x - centre
        self.radius = np.linalg.norm(off, axis=1)
        unit = (off / np.maximum(self.radius, 1e-300)[:, None]) @ turn
        self.bits = np.packbits(unit > 0, axis=1)
        #: Inner product of a unit vector with its code, whose coordinates are +-1/sqrt(dims).
        self.with_code = np.abs(unit).sum(axis=1) / np.sqrt(self.dims)

    def estimate(self, query: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated distances of all rows from one query, and how far they may be off below."""
        off = query - centre
        length = np.linalg.norm(off)
        unit = (off / max(length, 1e-300)) @ turn
        # sums over the set bits of each byte, from a table of the 256 values that a byte can take
        padded = np.zeros(self.bits.shape[1] * 8)
        padded[: self.dims] = unit
        table = padded.reshape(-1, 8) @ _BYTES.T
        positive = table[np.arange(self.bits.shape[1]), self.bits].sum(axis=1)
        product = (2 * positive - unit.sum()) / np.sqrt(self.dims)
        safe = np.maximum(self.with_code, 1e-9)
        error = ERROR * np.sqrt(np.maximum(1 - safe**2, 0) / safe**2 / max(self.dims - 1, 1))
        both = self.radius * length
        square = self.radius**2 + length**2
        guess = square - 2 * both * np.clip(product / safe, -1, 1)
        low = square - 2 * both * np.minimum(product / safe + error, 1)
        high = square - 2 * both * np.maximum(product / safe - error, -1)
        return np.where(self.radius > 0, low, guess), np.where(self.radius > 0, high, guess)


#: Row b: the bits of byte b, highest first.
_BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def nearest_in_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, distances) of the k nearest of a block that the bounds can't rule out; ties to the smaller id."""
    codes = Codes(x, centre, turn)
    for query_id, query in zip(query_ids, queries):
        low, high = codes.estimate(query, centre, turn)
        other = ids != query_id
        if other.sum() > k:
            limit = np.partition(high[other], k - 1)[k - 1]
            other &= low <= limit
        chosen = np.flatnonzero(other)
        exact = np.sqrt(((x[chosen] - query) ** 2).sum(axis=1))
        best = np.lexsort((ids[chosen], exact))[:k]
        yield query_id, ids[chosen][best], exact[best]


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The ``k`` nearest rows of every query by Euclidean distance: ``query_id``, ``rank`` (from 1), id, ``score``.

    Nearest first, ties to the smaller id; the query's own id is no candidate. Null, zero and non-finite vectors
    take no part; vectors only meet others of their length. Null ids take no part; rows that repeat an
    id and its vector count once (of different vectors under one id the smallest counts). Fewer candidates
    than ``k`` give fewer rows.
    """
    x = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), x.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where(F.col("id").isNotNull() & usable("v"))
    rows = stored(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked")).withColumn("dims", F.size("v")))
    sizes = {r["dims"]: (r["n"], r["asked"]) for r in rows.groupBy("dims").agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("long")).alias("asked")).collect()}
    if not sizes:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, `{id_column}` long, score double")
    blocks = {d: (max(1, round(n / candidate_block)), max(1, round(asked / query_block))) for d, (n, asked) in sizes.items()}
    # the mean of each length's coordinates: one row for each length and coordinate
    mean = rows.select("dims", F.posexplode("v")).groupBy("dims", "pos").agg(F.avg("col").alias("mean")).collect()
    centres = {d: np.zeros(d) for d in sizes}
    for r in mean:
        centres[r["dims"]][r["pos"]] = r["mean"]
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def by_dims(n: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(y) for d, b in blocks.items() for y in (d, b[n])]), F.col("dims"))

    mixed = rows.withColumn("hash", F.xxhash64("id")).withColumn("blocks", by_dims(0)).withColumn("query_blocks", by_dims(1))
    own = F.pmod("hash", "blocks")
    candidates = mixed.select("dims", own.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks").cast("long") - 1)).alias("query_block"), F.lit(False).alias("is_query"), "id", "v")
    queries = mixed.where("asked").select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), F.pmod(F.shiftrightunsigned("hash", 20), "query_blocks").alias("query_block"), F.lit(True).alias("is_query"), "id", "v")

    def search(key: tuple[int, int, int], group: pd.DataFrame) -> pd.DataFrame:
        asked = group["is_query"].to_numpy()
        ids, x, centre = group["id"].to_numpy(), np.stack(group["v"].to_numpy()), shared.value[int(key[0])]
        found = list(nearest_in_block(ids[asked], x[asked], ids[~asked], x[~asked], centre, rotation(len(centre)), k))
        return pd.DataFrame(
            {
                "query_id": np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64),
                "id": np.concatenate([np.zeros(0, np.int64), *(i for _, i, _ in found)]),
                "score": np.concatenate([np.zeros(0), *(s for _, _, s in found)]),
            }
        )

    best = candidates.unionByName(queries).groupBy("dims", "block", "query_block").applyInPandas(search, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
