"""What several operators share: stored intermediate tables, global ranks, Arrow helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE = 8 << 20  # bytes of a batch that Python works on at once
INDEX_BITS = 33  # monotonically_increasing_id() = partition << 33 | row within the partition


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a run in one process (tests) makes and sets a temporary folder; a cluster is refused, as its
    machines would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="difftide-llm-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, unless they have it on their path."""
    package = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="difftide-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet below the shared folder and read again.

    Cuts the lineage: lost executors cost only the tasks that run, and a value that depends on how rows
    met (a row number within a partition) can't change afterwards. Folders lie below
    ``spark.checkpoint.dir`` and are cleared with it.
    """
    path = f"{shared_folder(df.sparkSession)}/difftide-llm/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(taken: Sequence[str], *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``taken`` is called so (Spark compares names without case)."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out


def global_rank(df: DataFrame, order: Sequence[str | Column], out: str = "global_rank") -> DataFrame:
    """``df`` with its 0-based position in the order given, gapless over all partitions.

    Ranges of the whole order (hot values included, as the order goes on to a unique column) go to
    separate tasks; positions are offsets of partitions plus row numbers within them. Only one count for
    each partition meets in one place.
    """
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    row, at, ahead = free_names([*df.columns, out], "__row", "__part", "__before")
    ranged = df.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    numbered = stored(ranged.withColumn(row, F.monotonically_increasing_id()))
    part = F.shiftright(row, INDEX_BITS)
    counts = numbered.groupBy(part.alias(at)).agg(F.count("*").alias("__n"))
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(at, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(ahead))
    ranked = numbered.withColumn(at, part).join(F.broadcast(offsets), at)  # one row per partition
    return ranked.withColumn(out, F.col(ahead) + F.col(row).bitwiseAND(F.lit((1 << INDEX_BITS) - 1))).drop(row, at, ahead)


def counts_within(df: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` with a gapless 0-based number within each value of ``key``; a hot key is no task of its own.

    Rows are numbered inside (stored partition, key), and each such pair starts where the earlier
    partitions' rows of that key end. The pairs are as many as partitions times keys of a partition.
    """
    marked = stored(df.withColumn("__row", F.monotonically_increasing_id()))
    marked = marked.withColumn("__part", F.shiftright("__row", INDEX_BITS))
    sizes = marked.groupBy(key, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(key, "__part").orderBy("__row")) - 1
    return marked.withColumn("__local", local).join(offsets, [key, "__part"]).withColumn(out, F.col("__before") + F.col("__local")).drop("__row", "__part", "__before", "__local")


def slices(batch: pa.RecordBatch, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes (or one row), so that what is made of a slice stays small."""
    rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, limit: int = SLICE) -> DataFrame:
    """Map every slice (of about ``limit`` bytes) of every Arrow batch of ``df`` by ``step``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def gathered(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the values of pieces ``at`` one after the other, the ends of each), for pieces of ``sizes`` lying in ``values``."""
    starts = np.cumsum(sizes) - sizes
    length = sizes[at]
    ends = np.cumsum(length)
    return values[np.repeat(starts[at] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)], ends


def record_batch(**columns: object) -> pa.RecordBatch:
    """A record batch of arrays, numpy arrays or lists; its columns in the order given."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def vectors(column: pa.Array, dims: int) -> np.ndarray:
    """A list column without nulls as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dims)


def usable(column: str) -> Column:
    """True where a vector is not null, not empty, holds only finite components and is not zero."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of complete groups and the groups' edges, from batches sorted by their first ``keys`` integer columns.

    Only the group that a batch ends in waits for the next batch.
    """
    waiting: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is None or last != tuple(c[0] for c in columns)
        last = tuple(c[-1] for c in columns)
        cuts = np.flatnonzero(new)
        if not len(cuts):
            waiting.append(batch)
            continue
        if waiting:
            head = pa.concat_batches([*waiting, batch.slice(0, cuts[0])])
            yield head, np.array([0, head.num_rows])
        inner = batch.slice(cuts[0], cuts[-1] - cuts[0])
        if inner.num_rows:
            yield inner, cuts - cuts[0]
        waiting = [batch.slice(cuts[-1])]
    if waiting:
        head = pa.concat_batches(waiting)
        yield head, np.array([0, head.num_rows])


class Forest:
    """Union-find over 0..n-1; the root of a set is its least member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
