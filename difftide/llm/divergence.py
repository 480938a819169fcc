"""How far the sources of a language differ in their words, from stripes made in the mappers.

A task folds whole documents into hash stripes: for every term of a language its document frequency and its count in
each source. Full hashes are spilled as rows and begun anew; rows of a (language, term) meet by hash and merge into one
stripe. Merged stripes of a term that is frequent enough lie in blocks by language. Each block meets the totals of its
language's groups and directly emits what it adds to the divergence of any two sources, and its best terms by source.
All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from difftide.llm.common import record_batch, slices, stored
from difftide.llm.words import LOWER, byte_class

SCALE = 1_000_000_000
ENTRIES = 400_000  # (term, source) entries that a task holds before it spills
BLOCK = 2_048  # stripes in a block
CELLS = 1 << 20  # probabilities that are worked on at once; also sums of pairs that a task holds before it spills

#: Terms are runs of letters A-Z, a-z and characters beyond ASCII.
TERM = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_ONLY_TERMS = bytes(LOWER[b] if TERM[b] else 0x20 for b in range(256))
_STRIPE = "lang string, term binary, df bigint, sources array<string>, counts array<bigint>"


def terms(text: str) -> list[bytes]:
    """The text's terms in order, A-Z in lower case."""
    return text.encode().translate(_ONLY_TERMS).split()


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of (lang, source, text) rows without nulls."""
    stripes: dict[str, dict[bytes, list]] = {}
    entries = 0
    for batch in batches:
        for part in slices(batch):
            for lang, source, text in zip(*(c.to_pylist() for c in part.columns)):
                of_lang = stripes.setdefault(lang, {})
                for term, n in Counter(terms(text)).items():
                    stripe = of_lang.get(term)
                    if stripe is None:
                        of_lang[term] = [1, {source: n}]
                        entries += 2
                        continue
                    stripe[0] += 1
                    counts = stripe[1]
                    if source in counts:
                        counts[source] += n
                    else:
                        counts[source] = n
                        entries += 1
                if entries >= ENTRIES:
                    yield from _rows(stripes)
                    stripes, entries = {}, 0
    yield from _rows(stripes)


def _rows(stripes: dict[str, dict[bytes, list]], size: int = 8_192) -> Iterator[pa.RecordBatch]:
    for lang, of_lang in stripes.items():
        every = list(of_lang.items())
        for start in range(0, len(every), size):
            part = every[start : start + size]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(part), pa.string()), pa.array([t for t, _ in part], pa.binary()), pa.array([s[0] for _, s in part], pa.int64()),
                    pa.array([list(s[1]) for _, s in part], pa.list_(pa.string())), pa.array([list(s[1].values()) for _, s in part], pa.list_(pa.int64())),
                ],
                names=["lang", "term", "df", "sources", "counts"],
            )


def _same_as_before(column: pa.Array) -> np.ndarray:
    """For each value but the first, whether it equals the one before."""
    return np.asarray(pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False), bool)


def merge(least: int):
    """Step over stripe rows sorted by (lang, term): blocks of merged stripes whose term is in ``least`` documents or more."""

    def merged(part: pa.RecordBatch) -> pa.RecordBatch | None:
        """Blocks of a batch that holds whole (lang, term) groups."""
        lang, term, df, sources, counts = part.columns
        new = np.ones(part.num_rows, bool)
        new_lang = np.ones(part.num_rows, bool)
        new_lang[1:] = ~_same_as_before(lang)
        new[1:] = new_lang[1:] | ~_same_as_before(term)
        group = np.cumsum(new) - 1
        total = np.zeros(group[-1] + 1, np.int64)
        np.add.at(total, group, df.to_numpy())
        flat = sources.flatten().dictionary_encode()
        names, code = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
        cell = np.repeat(group, pc.list_value_length(sources).to_numpy()) * len(names) + code
        cells, inverse = np.unique(cell, return_inverse=True)
        n = np.zeros(len(cells), np.int64)
        np.add.at(n, inverse, counts.flatten().to_numpy())
        kept = total >= least
        if not kept.any():
            return None
        at = np.flatnonzero(new)
        keep_cell = kept[cells // len(names)]
        cells, n = cells[keep_cell], n[keep_cell]
        ends = np.searchsorted(cells // len(names), np.flatnonzero(kept), side="right")
        first, lang_of = at[kept], (np.cumsum(new_lang) - 1)[at[kept]]
        cuts = np.flatnonzero((np.arange(len(first)) - np.searchsorted(lang_of, lang_of)) % BLOCK == 0)
        edges = np.concatenate([[0], ends])
        cell_edges = np.concatenate([edges[cuts], edges[-1:]])
        whole = np.concatenate([cuts, [len(first)]])
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        return record_batch(
            lang=lang.take(pa.array(first[cuts])),
            terms=lists(whole, term.take(pa.array(first))),
            sizes=lists(whole, pa.array(np.diff(edges))),
            sources=lists(cell_edges, names.take(pa.array(cells % len(names)))),
            counts=lists(cell_edges, pa.array(n)),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 4 * BLOCK:
                continue
            every = pa.concat_batches(held)
            last = (every.column(0)[-1], every.column(1)[-1])
            same = pc.and_(pc.equal(every.column(0), last[0]), pc.equal(every.column(1), last[1]))
            open_ = pc.sum(same).as_py()  # the last group may go on in the next batch
            if open_ < every.num_rows and (out := merged(every.slice(0, every.num_rows - open_))) is not None:
                yield out
            tail = every.slice(every.num_rows - open_)
            held = [_squeezed(tail) if open_ > BLOCK else tail]
        if held and (out := merged(pa.concat_batches(held))) is not None:
            yield out

    return run


def _squeezed(group: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of one (lang, term) as one row, so a term of very many rows never piles up."""
    names = group.column(3).flatten().dictionary_encode()
    n = np.zeros(len(names.dictionary), np.int64)
    np.add.at(n, names.indices.to_numpy(), group.column(4).flatten().to_numpy())
    one = pa.array([0, len(n)], pa.int32())
    columns = [group.column(0)[:1], group.column(1)[:1], pa.array([pc.sum(group.column(2)).as_py()], pa.int64())]
    lists = [pa.ListArray.from_arrays(one, names.dictionary), pa.ListArray.from_arrays(one, pa.array(n))]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in [*columns, *lists]], names=group.schema.names)


def shares(counts: np.ndarray, total: np.ndarray, terms_kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms_kept)), by long division: no step leaves 64 bits."""
    rest, divisor, out = counts + 2, total + 2 * terms_kept, np.zeros(np.broadcast(counts, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // divisor
        rest = rest % divisor
    return out + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


def emit(ranks: int):
    """Step over blocks joined with their language's totals: partial (lang, source, part, item, value) rows."""

    def found(langs: list[str], sources: list[str], parts: list[str], items: pa.Array, values: list[int] | np.ndarray) -> pa.RecordBatch:
        return record_batch(lang=pa.array(langs, pa.string()), source=pa.array(sources, pa.string()), part=pa.array(parts, pa.string()), item=items, value=pa.array(values, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[list[str], dict[int, np.ndarray]]] = {}  # by language: sources, and by first source the sums to the later ones
        held = 0

        def spill() -> Iterator[pa.RecordBatch]:
            for lang, (names, by) in sums.items():
                for a, row in by.items():
                    later = names[a + 1 :]
                    yield found([lang] * len(row), [names[a]] * len(row), ["pair"] * len(row), pa.array(later, pa.string()), row)

        for batch in batches:
            for k in range(batch.num_rows):
                lang, block_terms, sizes, block_sources, counts, names, totals, kept = (batch.column(c)[k] for c in range(8))
                lang, names, kept = lang.as_py(), names.as_py(), kept.as_py()
                at = {s: g for g, s in enumerate(names)}
                total = totals.values.to_numpy()
                col = np.array([at[s] for s in block_sources.as_py()], np.int64)
                n = counts.values.to_numpy()
                edges = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())])
                best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                step = max(1, CELLS // len(names))
                for start in range(0, len(edges) - 1, step):
                    stop = min(start + step, len(edges) - 1)
                    cells = slice(edges[start], edges[stop])
                    row = np.repeat(np.arange(stop - start), np.diff(edges[start : stop + 1]))
                    dense = np.zeros((stop - start, len(names)), np.int64)
                    dense[row, col[cells]] = n[cells]
                    p = shares(dense, total[None, :], kept)
                    q = shares(dense.sum(1), total.sum()[None], kept)
                    by = sums.setdefault(lang, (names, {}))[1]
                    for a in range(len(names) - 1):
                        value = gaps(p[:, a : a + 1], p[:, a + 1 :]).sum(0)
                        if a in by:
                            by[a] += value
                        else:
                            by[a] = value
                            held += len(value)
                        if held >= CELLS:
                            yield from spill()
                            sums.clear()
                            by = sums.setdefault(lang, (names, {}))[1]
                            held = 0
                    for g in range(len(names)):
                        mine = np.flatnonzero((dense[:, g] > 0) & (p[:, g] > q))
                        value = gaps(p[mine, g], q[mine])
                        old = best.get(g)
                        if old is not None:
                            mine, value = np.concatenate([old[0], mine + start]), np.concatenate([old[1], value])
                        else:
                            mine = mine + start
                        top = np.lexsort((mine, -value))[:ranks]  # terms of a block lie in byte order
                        best[g] = mine[top], value[top]
                for g, (mine, value) in best.items():
                    if len(mine):
                        yield found([lang] * len(mine), [names[g]] * len(mine), ["term"] * len(mine), block_terms.values.take(pa.array(mine)).cast(pa.string()), value)
        yield from spill()

    return run


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, ranks: int = 10) -> DataFrame:
    """How the sources of each language differ: (lang, source, part, item, value, rank).

    Part ``pair`` has every other source of the language with the sum of the terms' gaps between both; part ``term`` the ``ranks``
    terms that a source uses more than its language does, by gap. Terms are kept that ``least`` documents of
    the language hold. Nulls in any column read count as empty texts, so a null language or source is a group. Repeated
    rows count as often as they occur, ties go to the item of smaller UTF-8 bytes; texts without terms still make their
    group, whose ``pair`` rows have value 0 if the language has no kept term. An empty table gives no rows. A text of any
    length is one document; other columns aren't read. Sums go up to 2^63.

    Rows of a language and term are as many as spills of tasks. The sources of one language are gathered with their
    totals, as the result has a row for every two of them.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    dealt = clean.mapInArrow(fold, _STRIPE).repartition(parts, "lang", "term").sortWithinPartitions("lang", "term")
    blocks = stored(dealt.mapInArrow(merge(least), "lang string, terms array<binary>, sizes array<bigint>, sources array<string>, counts array<bigint>"))
    kept = blocks.groupBy("lang").agg(F.sum(F.size("terms").cast("long")).alias("kept"))
    cells = blocks.select("lang", F.inline(F.arrays_zip("sources", "counts"))).groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("n"))
    groups = clean.select("lang", "source").distinct().join(cells, ["lang", "source"], "left")
    totals = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("groups"))
    totals = stored(totals.join(kept, "lang", "left").select("lang", F.col("groups.source").alias("names"), F.col("groups.n").alias("totals"), F.coalesce("kept", F.lit(0)).alias("kept")))
    partial = blocks.join(totals, "lang").select("lang", "terms", "sizes", "sources", "counts", "names", "totals", "kept").mapInArrow(emit(ranks), "lang string, source string, part string, item string, value bigint")
    other = F.transform(F.col("names"), lambda x: x)
    every = totals.select("lang", F.explode("names").alias("source"), other.alias("names")).select("lang", "source", F.lit("pair").alias("part"), F.explode("names").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    both = F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).otherwise(F.array(F.struct("source", "item")))
    mirrored = partial.select("lang", "part", "value", F.explode(both).alias("of")).select("lang", "of.source", "part", "of.item", "value")
    summed = mirrored.unionByName(every).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return summed.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= ranks))
