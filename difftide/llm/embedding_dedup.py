"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the vectors' principal components is learnt so that their signs lose as little as possible; the
signs are a balanced binary code, and random rotations lengthen it where it is too short. The code's substrings are
a multi-index: one hash table each, so two codes that differ in fewer bits than there are tables meet for certain, and
others often do. For each length of vectors, substrings are as many and as short as pairs at the threshold need on a
sample; where 64 of 8, 4 or 2 bits don't do, all vectors of a label meet. What meets is reranked with the original
vectors. Vectors only meet others of their label and length.

Pairs never leave the task that finds them: a pair counts in the first table in which its codes agree, and a task
returns link counts and one edge per vector of each connected set. Equal vectors are one class throughout. A table
entry above ``CHUNK`` vectors is dealt over pairs of chunks, so that no task holds more than two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difftide.llm.common import Forest, arrow_map, record_batch, stored, usable, whole_groups
from difftide.llm.graph import components

THRESHOLD = 0.93
SAMPLE = 16_384  # vectors that the rotation is learnt from, at most; every vector is indexed
ROUNDS = 50
BITS = 64
TABLES = 64  # at most
WIDTHS = (8, 4, 2)  # bits of a substring
RECALL = 0.99  # of pairs at the threshold itself, expected from the sample
PROBES = 4_096  # vectors of the sample that get a partner at the threshold
CHUNK = 2_048  # vectors of one table entry in one chunk, on average


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal components, turned so that the signs are near the values (iterative quantisation)."""
    mean = x.mean(axis=0)
    off = x - mean
    _, axes = np.linalg.eigh(off.T @ off)
    axes = axes[:, ::-1][:, : min(bits, x.shape[1])]
    low = off @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1], axes.shape[1])))[0]
    for _ in range(rounds):
        code = np.where(low @ turn > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(code.T @ low)
        turn = (u @ v).T
    return mean, axes @ turn


def _codes(x: np.ndarray, mean: np.ndarray, turn: np.ndarray, width: int) -> np.ndarray:
    """One byte for each table, of ``width`` bits; the same byte for all if ``width`` is zero."""
    if not width:
        return np.zeros((len(x), 1), np.uint8)
    return np.packbits(((x - mean) @ turn > 0).reshape(len(x), -1, width), axis=2)[:, :, 0]


def learn_tables(x: np.ndarray, threshold: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, projection, width) for ``_codes``: the fewest comparisons with which pairs at the threshold meet.

    Partners are as far from their vector as the threshold says and as far from the mean as it, once in any
    direction and once in those in which the sample's vectors differ; the worse of the two counts.
    """
    mean, turn = learn_rotation(x, seed=seed)
    rng = np.random.default_rng(seed)
    axes = turn
    while turn.shape[1] < TABLES * WIDTHS[0]:
        turn = np.concatenate([turn, axes @ np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))[0]], axis=1)
    off = x[:PROBES] - mean
    size = np.maximum((off * off).sum(axis=1, keepdims=True), 1e-12)
    cos = np.clip(1 - (1 - threshold) / size, -1, 1)
    near = []
    for way in (rng.standard_normal(off.shape), off[rng.permutation(len(off))] - off):
        way = way - (way * off).sum(axis=1, keepdims=True) / size * off
        way = way / np.maximum(np.sqrt((way * way).sum(axis=1, keepdims=True)), 1e-12)
        near.append(cos * off + np.sqrt((1 - cos * cos) * size) * way)
    best = (1.0, 0, 0)  # all pairs
    for width in WIDTHS:
        part = turn[:, : TABLES * width]
        own = _codes(off, 0, part, width)
        met = np.min([np.logical_or.accumulate(own == _codes(y, 0, part, width), axis=1).mean(axis=0) for y in near], axis=0)
        enough = np.flatnonzero(met >= RECALL)
        if len(enough):
            best = min(best, ((enough[0] + 1) / 2**width, width, int(enough[0]) + 1))
    return mean, turn[:, : best[1] * best[2]], best[1]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _entry_links(x: np.ndarray, code: np.ndarray, table: np.ndarray, label: np.ndarray, count: np.ndarray, side: np.ndarray, within: bool, threshold: float) -> tuple[np.ndarray, Forest]:
    """Links (copies included) of each vector of one table entry with others that first meet it here, and their sets."""
    unit = _unit(x)
    links, sets = np.zeros(len(x), np.int64), Forest(len(x))
    left = np.arange(len(x)) if within else np.flatnonzero(~side)
    right = left if within else np.flatnonzero(side)
    i, j = np.nonzero(unit[left] @ unit[right].T >= threshold)
    i, j = left[i], right[j]
    if within:
        i, j = i[i < j], j[i < j]
    t = table[i]
    agree = code[i] == code[j]
    first = agree.argmax(axis=1) if len(i) else t
    good = (label[i] == label[j]) & (table[j] == t) & (first == t) & agree[np.arange(len(i)), t]
    i, j = i[good], j[good]
    np.add.at(links, i, count[j])
    np.add.at(links, j, count[i])
    for a, b in zip(i.tolist(), j.tolist()):
        sets.join(a, b)
    return links, sets


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """``id_column``, ``n_links``, ``component_id``, ``kept`` of every row.

    Rows link if their labels are equal and not null and their cosine is ``threshold`` or more. Null, zero and
    non-finite vectors and rows with a null label or id link with nothing (a row without an id has no component and is
    not kept). Repeated rows are vectors of their own and link; rows of one id are in one component. Every link
    returned is exact; codes find 0.99 of the pairs at the threshold, as far as the sample tells, more of the nearer ones,
    and all whose codes differ in fewer bits than there are tables. Lengths that the sample lacks are compared in full.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v")).withColumn("ok", usable("v") & F.col("id").isNotNull() & F.col("label").isNotNull()))
    classes = stored(rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("dims", F.size("v")))
    chosen = classes.select("dims", "v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).toPandas()  # bounded: sample
    learnt = {int(d): learn_tables(_unit(np.stack(g["v"].to_numpy())), threshold) for d, g in chosen.groupby("dims")}
    shared = spark.sparkContext.broadcast(learnt)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = batch.column(0).to_numpy()
        codes = np.empty(len(dims), object)
        v = batch.column(1)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            x = _unit(v.take(pa.array(at)).flatten().to_numpy().reshape(-1, d))
            for k, row in zip(at, _codes(x, *shared.value.get(int(d), (0, None, 0)))):
                codes[k] = row.tobytes()
        return record_batch(dims=batch.column(0), v=v, id=batch.column(2), n=batch.column(3), label=batch.column(4), code=pa.array(codes, pa.binary()))

    coded = stored(arrow_map(classes.select("dims", "v", "id", "n", "label"), encode, "dims int, v array<double>, id bigint, n bigint, label string, code binary"))
    tables = F.sequence(F.lit(1), F.length("code"))
    entry = F.xxhash64("dims", "label", "table", F.substring("code", F.col("table"), F.lit(1)))
    entries = coded.withColumn("table", F.explode(tables)).withColumn("entry", entry)
    sizes = coded.select("dims", "label", "code", F.explode(tables).alias("table")).select(entry.alias("entry")).groupBy("entry").agg(F.count("*").alias("size"))
    large = stored(sizes.where(F.col("size") > chunk).select("entry", F.ceil(F.col("size") / chunk).cast("int").alias("chunks")))
    dealt = entries.join(large, "entry", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("entry", "dims", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("side"), (F.col("table") - 1).alias("table"), "label", "id", "n", "code", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in whole_groups(batches, 4):
            p, q, side, table, ids, count = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5, 7, 8))
            labels = batch.column(6).dictionary_encode().indices.to_numpy()
            out: tuple[list, list, list] = ([], [], [])
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if end - start < 2:
                    continue
                cut = slice(start, end)
                v, codes = batch.column(10).slice(start, end - start), batch.column(9).slice(start, end - start)
                dims = len(v[0])
                x = v.flatten().to_numpy().reshape(-1, dims)
                code = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(end - start, -1)
                links, sets = _entry_links(x, code, table[cut], labels[cut], count[cut], side[cut], p[start] == q[start], threshold)
                for k in np.flatnonzero(links).tolist():
                    out[0].append(ids[start + k])
                    out[1].append(links[k])
                    out[2].append(ids[start + sets.root(k)])
            if out[0]:
                yield record_batch(id=pa.array(out[0], pa.int64()), links=pa.array(out[1], pa.int64()), root=pa.array(out[2], pa.int64()))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(dealt.repartition(parts, "entry", "dims", "p", "q").sortWithinPartitions("entry", "dims", "p", "q").mapInArrow(search, "id bigint, links bigint, root bigint"))
    linked = components(found, "id", "root")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.drop("dims").join(counts, "id", "left").join(linked, "id", "left").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    whole = rows.join(of_class.withColumn("ok", F.lit(True)), ["ok", "label", "v"], "left")
    component = F.coalesce("component", "id")
    return whole.select(F.col("id").alias(id_column), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
