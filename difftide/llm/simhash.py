"""Near-duplicates by SimHash fingerprints and BK-trees.

Fingerprints are grouped first, so copies cost one row. Of four 16-bit blocks, two fingerprints that differ in
at most 3 bits share at least one; so each block value is a shard, and a shard's fingerprints form one BK-tree (a
child's key is its Hamming distance to its parent). A look-up follows only edges within the radius. Trees go to the
tasks by shard, not by one broadcast to all, as all trees together grow with the corpus. A shard above
``SHARD`` fingerprints is cut again by four blocks of its other 48 bits; what is still above it is dealt over
several trees of bounded size, and all its fingerprints visit each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from difftide.llm.common import Forest, arrow_map, free_names, record_batch, stored, whole_groups
from difftide.llm.graph import components

WORDS = 3  # of a shingle
RADIUS = 3
SEED = 42
SHARD = 4_096  # fingerprints of one tree
BLOCKS = 4  # more than RADIUS: one block at least is equal


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bit k is set if it is set in over half the hashes of the text's shingles, repeats included."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    else:
        joined = memoryview(b" ".join(parts))
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


class BKTree:
    """Fingerprints by Hamming distance to their parent."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.tag: list[int] = []
        self.child: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Tags of the fingerprints within ``radius``."""
        found, todo = [], [0] if self.value else []
        while todo:
            node = todo.pop()
            away = (self.value[node] ^ value).bit_count()
            if away <= radius:
                found.append(self.tag[node])
            for edge, child in self.child[node].items():
                if -radius <= edge - away <= radius:
                    todo.append(child)
        return found

    def add(self, value: int, tag: int) -> None:
        new = len(self.value)
        self.value.append(value)
        self.tag.append(tag)
        self.child.append({})
        if new:
            node = 0
            while True:
                away = (self.value[node] ^ value).bit_count()
                node, parent = self.child[node].setdefault(away, new), node
                if node == new:
                    return


def _tree_links(values: list[int], members: list[bool], radius: int) -> Forest:
    """Links of one tree's members with each other and with its visitors."""
    tree, sets = BKTree(), Forest(len(values))
    order = sorted(range(len(values)), key=lambda k: not members[k])
    for k in order:
        for other in tree.near(values[k], radius):
            sets.join(k, other)
        if members[k]:
            tree.add(values[k], k)
    return sets


def link_fingerprints(fingerprints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b) links that connect all ``fp`` (distinct, with their ``id``) within ``radius``; not every pair."""
    if radius >= BLOCKS:
        raise ValueError("blocks only find fingerprints that differ in fewer bits than there are blocks")
    fp = F.col("fp")
    first = F.array(*[F.struct(F.xxhash64(F.lit(k), F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))).alias("g"), F.lit(k).alias("block")) for k in range(BLOCKS)])
    one = fingerprints.select("id", "fp", F.explode(first).alias("s")).select("id", "fp", "s.g", "s.block")
    # the other 48 bits, moved together: above the block, and below it
    low = F.lit(1)
    for k in range(1, BLOCKS):
        low = F.when(F.col("block") == k, F.lit(1 << 16 * k)).otherwise(low)
    low = low.cast("long")
    above = F.when(F.col("block") == BLOCKS - 1, F.lit(0).cast("long"))
    for k in range(BLOCKS - 1):
        above = above.when(F.col("block") == k, F.shiftleft(F.shiftrightunsigned(fp, 16 * (k + 1)), 16 * k))
    rest = above.bitwiseOR(fp.bitwiseAND(low - 1))
    second = F.array(*[F.xxhash64("g", F.lit(k), F.shiftrightunsigned(F.col("rest"), 12 * k).bitwiseAND(F.lit(0xFFF))) for k in range(BLOCKS)])

    sizes = stored(one.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    small = one.join(sizes.where(F.col("n") <= shard), "g").select("g", F.lit(0).alias("tree"), F.lit(True).alias("member"), "id", "fp")
    two = one.join(sizes.where(F.col("n") > shard), "g").withColumn("rest", rest).select("id", "fp", F.explode(second).alias("g"))
    again = stored(two.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    dealt = two.join(again, "g").withColumn("trees", F.ceil(F.col("n") / shard).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), "trees").cast("int"))
    dealt = dealt.select("g", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), "own", "id", "fp").select("g", "tree", (F.col("tree") == F.col("own")).alias("member"), "id", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in whole_groups(batches, 2):
            member, ids, values = (batch.column(k).to_pylist() for k in (2, 3, 4))
            a, b = [], []
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if end - start == 2:
                    if ((values[start] ^ values[start + 1]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius:
                        a.append(ids[start])
                        b.append(ids[start + 1])
                elif end - start > 2:
                    sets = _tree_links([v & 0xFFFFFFFFFFFFFFFF for v in values[start:end]], member[start:end], radius)
                    for k in range(end - start):
                        if (root := sets.root(k)) != k:
                            a.append(ids[start + root])
                            b.append(ids[start + k])
            if a:
                yield record_batch(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return small.unionByName(dealt).repartition(parts, "g", "tree").sortWithinPartitions("g", "tree").mapInArrow(run, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``id_column``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest id reachable) of every row.

    A null text counts as empty; texts without words have fingerprint zero and link like any other. Rows with a null
    id get their fingerprint, and the component that it belongs to if another row has one, else null. Repeated
    rows stay; rows of one id with different texts link by their texts alone. A very long text gives all its shingles. An
    empty table gives no rows. Other columns are not read.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(t or "", words) for t in batch.column(1).to_pylist()]
        return record_batch(id=batch.column(0), fp=pa.array(np.array(prints, np.uint64).view(np.int64)))

    rows = stored(arrow_map(docs.select(F.col(id_column).cast("long"), text), step, "id bigint, fp bigint"))
    classes = stored(rows.groupBy("fp").agg(F.min("id").alias("id")).where("id is not null"))
    found = components(link_fingerprints(classes.select(F.col("fp").alias("id"), "fp"), radius)).withColumnRenamed("id", "fp")
    rooted = stored(classes.join(found, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("root")))
    of_class = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(of_class, "fp", "left").select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, groups: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` without the rows whose group has a smaller id; ``groups`` are their ``simhash_groups`` with equal ``words``.

    Of rows that repeat an id and a fingerprint one stays, that of the least hash of its text; other texts of the id are
    decided by their own group, and all stay whose group it leads. Of rows with a null id one stays for each fingerprint,
    also beside a row with an id. All columns stay, whatever they are called.
    """
    own, lead, mark, row = free_names(docs.columns, "__fingerprint", "__id", "__print", "__row")
    by_id = groups.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.count("*").alias("n"), F.min("component_id").alias("least"))
    other = stored(by_id.where((F.col("n") > 1) | (F.col(id_column) > F.col("least"))).select(id_column, "n"))
    repeated = stored(other.where("n > 1").select(id_column))
    single = docs.where(F.col(id_column).isNotNull()).join(other, id_column, "left_anti").select(docs.columns)
    rest = docs.join(repeated, id_column, "left_semi").select(docs.columns).unionByName(docs.where(F.col(id_column).isNull()))
    at = docs.columns.index(text)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [f"{fingerprint(t or '', words):016x}" for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], names=[*batch.schema.names, own])

    printed = arrow_map(rest, step, StructType(list(docs.schema.fields)).add(own, StringType()))
    leads = groups.where(F.col(id_column).isNull() | (F.col(id_column) == F.col("component_id"))).select(F.col(id_column).alias(lead), F.col("fingerprint").alias(mark)).distinct()
    leading = printed.join(leads, F.col(id_column).eqNullSafe(F.col(lead)) & (F.col(own) == F.col(mark)), "left_semi")
    one = leading.groupBy(id_column, own).agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64(text), text)).alias(row))
    return single.unionByName(one.select(*[F.col(row)[c].alias(c) for c in docs.columns]))
