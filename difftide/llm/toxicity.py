"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A text's terms are its words, in lower case, and their first 4, 5 and 6 letters (``idio*``), so that inflected
forms meet. Terms enter the index by how much the examples' labels depend on them (chi-square), at most ``TERMS``; those that
say nothing about the label stay out. Postings are kept in blocks of ``BLOCK`` examples with each term's largest weight
in the block; blocks are scored in the order of their upper bounds until no bound can reach the k-th best any more, so
the neighbours are exact among these terms. They vote by squared cosine against the base rate and are returned as
evidence. The share of votes becomes a probability by a logistic curve, fitted to the votes that the examples
themselves get from all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difftide.llm.common import arrow_map, gathered, record_batch, slices, stored

EXAMPLES = 12_000  # labelled rows that the index is fitted on, at most (chosen by a hash of the id)
TERMS = 2_048  # terms of the index: with EXAMPLES it bounds the index to 12,000 * 2,048 postings
DEPENDENT = 6.0  # chi-square from which a term counts as dependent on the label (p < 0.015)
LEAST = 2  # examples that a term must occur in
PREFIXES = (4, 5, 6)
FIT_TASKS = 16  # tasks that read the fitting rows
BLOCK = 64
NEIGHBOURS = 15
PRIOR = 0.3  # weight of the base rate, in neighbours of cosine 1
REMEMBERED = 1 << 15  # scored term vectors that a worker keeps
DIGITS = 9  # of a cosine: sums in another order give equal ones
IDENTITY = 1.0  # weight that holds the curve to the plain share of votes where examples are few


def terms_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(edges of each text's words, word numbers, the different words) of lower-case runs of letters."""
    split = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\pL]+")
    words = split.flatten().dictionary_encode()
    offsets = split.offsets.to_numpy()
    return offsets - offsets[0], words.indices.to_numpy(), words.dictionary.to_pylist()


def _counts(texts: pa.Array, number: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(term numbers, counts) of each text, for the terms numbered."""
    edges, at, different = _words(texts)
    heads = {t.removesuffix("*")[: PREFIXES[0]] for t in number}  # all terms of a word begin like it
    known = [[n for t in terms_of(w) if (n := number.get(t)) is not None] if w and w[: PREFIXES[0]] in heads else [] for w in different]
    sizes = np.array([len(k) for k in known], np.int64)
    flat = np.array([n for k in known for n in k], np.int64)
    starts = np.cumsum(sizes) - sizes
    used = np.flatnonzero(sizes[at] > 0) if len(at) else np.zeros(0, np.int64)
    doc = np.searchsorted(edges, used, "right") - 1
    length = sizes[at[used]]
    ends = np.cumsum(length)
    term = flat[np.repeat(starts[at[used]] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
    pair, count = np.unique(np.repeat(doc, length) * (len(number) + 1) + term, return_counts=True)
    doc, term = np.divmod(pair, len(number) + 1)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(term[a:b], count[a:b]) for a, b in zip(cut, cut[1:])]


class BlockMaxIndex:
    """Postings of unit TF-IDF vectors in blocks with upper bounds. Equal vectors are one entry with a multiplicity."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], ids: list[int], inverse_frequency: np.ndarray) -> None:
        self.idf = inverse_frequency
        entries: dict[tuple[bytes, bytes], list[int]] = {}
        for k, (terms, counts) in enumerate(vectors):
            if len(terms):
                entries.setdefault((terms.tobytes(), counts.tobytes()), []).append(k)
        groups = list(entries.values())
        self.entry = {key: e for e, key in enumerate(entries)}
        self.slope, self.shift = 1.0, 0.0
        self.size = np.array([len(g) for g in groups], np.int64)
        self.toxic = np.array([sum(labels[k] for k in g) for g in groups], np.float64)
        self.example = np.array([min(ids[k] for k in g) for g in groups], np.int64)
        empty = [labels[k] for k, (terms, _) in enumerate(vectors) if not len(terms)]
        self.rate = (sum(labels) + 1) / (len(labels) + 2)
        self.rate_without = min(self.rate, (sum(empty) + self.rate) / (len(empty) + 1))
        weights = [self.weights(*vectors[g[0]]) for g in groups]
        term = np.concatenate([np.zeros(0, np.int64), *(vectors[g[0]][0] for g in groups)])
        entry = np.repeat(np.arange(len(groups)), [len(w) for w in weights])
        weight = np.concatenate([np.zeros(0), *weights])
        order = np.lexsort((entry, term))
        self.entries, self.entry_weights = entry[order], weight[order]
        self.blocks = max(1, -(-len(groups) // BLOCK))
        #: Where the postings of (term, block) start; one more at the end.
        self.starts = np.searchsorted(term[order] * self.blocks + self.entries // BLOCK, np.arange(len(inverse_frequency) * self.blocks + 1))
        self.block_max = np.zeros((len(inverse_frequency), self.blocks))
        np.maximum.at(self.block_max, (term, entry // BLOCK), weight)

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) nearest first, until they stand for ``k`` examples; ties to the smaller example id.

        Of entry ``leave`` one example takes no part.
        """
        size_of = self._sizes(leave)
        query = self.weights(terms, counts)
        bounds = query @ self.block_max[terms]
        todo = np.argsort(-bounds, kind="stable")
        todo = todo[bounds[todo] > 0]
        found, cosines = np.zeros(0, np.int64), np.zeros(0)
        done, width = 0, 4
        while done < len(todo):
            if len(found):
                best = self._order(found, cosines, k)
                last = np.searchsorted(np.cumsum(size_of[found[best]]), k)
                if last < len(best):  # only blocks that can hold an example as near go on
                    todo = todo[: np.searchsorted(-bounds[todo], 10.0**-DIGITS - cosines[best[last]], "right")]
                    if done >= len(todo):
                        break
            if done and 4 * (len(todo) - done) > self.blocks:  # many blocks are left: whole lists cost less than pieces of them
                found, cosines = self._scored(terms, query, np.zeros(len(terms), np.int64), np.full(len(terms), self.blocks))
                break
            part = todo[done : done + width]
            done, width = done + width, 2 * width
            of = np.repeat(np.arange(len(terms)), len(part))
            at = np.tile(part, len(terms))
            entry, cosine = self._scored(terms[of], query[of], at, at + 1)
            found, cosines = np.concatenate([found, entry]), np.concatenate([cosines, cosine])
        order = self._order(found, cosines, k)
        last = np.searchsorted(np.cumsum(size_of[found[order]]), k) + 1
        return found[order[:last]], cosines[order[:last]]

    def _order(self, found: np.ndarray, cosines: np.ndarray, k: int) -> np.ndarray:
        """Places of the nearest, in order: more than ``k`` and all of one cosine, so that they stand for ``k`` examples."""
        some = np.arange(len(found))
        if len(found) > k + 1:  # one entry may be left with no example
            some = np.flatnonzero(cosines >= np.partition(cosines, -(k + 1))[-(k + 1)])
        return some[np.lexsort((self.example[found[some]], -cosines[some]))]

    def _scored(self, terms: np.ndarray, query: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) from the postings of each term in blocks ``first`` up to ``last``."""
        edges = zip((terms * self.blocks + first).tolist(), (terms * self.blocks + last).tolist(), query.tolist())
        lists = [(a, b, q) for i, j, q in edges if (a := self.starts[i]) < (b := self.starts[j])]
        entries = np.concatenate([np.zeros(0, np.int64), *(self.entries[a:b] for a, b, _ in lists)])
        weights = np.concatenate([np.zeros(0), *(self.entry_weights[a:b] * q for a, b, q in lists)])
        scores = np.bincount(entries, weights)
        hit = np.flatnonzero(scores)
        return hit, scores[hit].round(DIGITS)

    def _sizes(self, leave: int) -> np.ndarray:
        if leave < 0:
            return self.size
        fewer = self.size.copy()
        fewer[leave] -= 1
        return fewer

    def votes(self, terms: np.ndarray, counts: np.ndarray, leave: int = -1, label: int = 0) -> tuple[float, np.ndarray]:
        """(share of toxic votes by squared cosine, with the base rate as ``PRIOR`` neighbours; entries).

        One example of entry ``leave``, with its ``label``, has no vote.
        """
        near, cosines = self.nearest(terms, counts, leave=leave)
        votes = np.minimum(cosines, 1.0) ** 2
        toxic = self.toxic[near] - label * (near == leave)
        total = (votes * self._sizes(leave)[near]).sum() + PRIOR
        return float(((votes * toxic).sum() + PRIOR * self.rate) / total), near

    def votes_of_others(self, terms: np.ndarray, counts: np.ndarray, label: int) -> float:
        """The share that an example gets from all other examples."""
        return self.votes(terms, counts, self.entry[terms.tobytes(), counts.tobytes()], label)[0]

    def calibrate(self, shares: np.ndarray, labels: np.ndarray) -> None:
        """Fit the curve from shares to probabilities: logistic regression on the log odds, by Newton steps."""
        x = np.stack([np.log(shares / (1 - shares)), np.ones(len(shares))], 1)
        start = np.array([1.0, 0.0])
        w = start.copy()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (p - labels) + IDENTITY * (w - start)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + IDENTITY * np.eye(2), slope)
            w = w - step * min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        if w[0] > 0:  # else votes and labels disagree: the plain share stays
            self.slope, self.shift = float(w[0]), float(w[1])

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        """(score, example ids): the calibrated share of votes and the nearest examples."""
        if not len(terms):
            return self.rate_without, []
        share, near = self.votes(terms, counts)
        odds = self.slope * np.log(share / (1 - share)) + self.shift
        return float(1 / (1 + np.exp(-odds))), self.example[near[:3]].tolist()


def _min_hash(words: np.ndarray) -> int:
    """The least hash of three neighbouring words' hashes."""
    if len(words) < 3:
        return int(words.min()) if len(words) else 0
    mixed = (words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + words[2:]
    mixed ^= mixed >> np.uint64(31)
    return int((mixed * np.uint64(0x94D049BB133111EB)).min())


def fit(examples: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[dict[str, int], BlockMaxIndex] | None:
    """Terms and index of at most EXAMPLES labelled rows; None if there is none.

    For the choice of terms, examples of one label and one min-hash of their word triples count once: the words of
    a text with many copies, equal or nearly so, would depend on the label as well and fill the index.
    """

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        edges, at, different = _words(batch.column(0))
        hashed = np.array([xxhash.xxh64_intdigest(w) for w in different], np.uint64)
        least = [_min_hash(hashed[at[a:b]]) for a, b in zip(edges, edges[1:])]
        return record_batch(text=batch.column(0), label=batch.column(1), sketch=pa.array(np.array(least, np.uint64).view(np.int64)))

    sketched = arrow_map(examples.select(text, F.col(label).cast("int")), sketch, "text string, label int, sketch bigint")
    once = sketched.groupBy("sketch", "label").agg(F.min("text").alias(text)).withColumnRenamed("label", label)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            edges, at, different = _words(batch.column(0))
            number: dict[str, int] = {}
            terms = [[number.setdefault(t, len(number)) for t in terms_of(w)] if w else [] for w in different]
            sizes = np.array([len(t) for t in terms], np.int64)
            pair = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(edges)) * (len(different) + 1) + at)
            doc, word = np.divmod(pair, len(different) + 1)
            term, _ = gathered(np.array([n for t in terms for n in t], np.int64), sizes, word)
            doc, term = np.divmod(np.unique(np.repeat(doc, sizes[word]) * (len(number) + 1) + term), len(number) + 1)
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            if number:
                n, with_label = np.bincount(term, minlength=len(number)), np.bincount(term, toxic[doc], len(number))
                yield record_batch(term=pa.array(list(number), pa.string()), n=pa.array(n.astype(np.int64)), toxic=pa.array(with_label.astype(np.int64)))

    totals = once.agg(F.count("*").alias("n"), F.sum(label).alias("toxic")).first()
    if not totals["n"]:
        return None
    n, toxic = float(totals["n"]), float(totals["toxic"] or 0)
    counted = once.select(text, label).mapInArrow(emit, "term string, n bigint, toxic bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= LEAST)
    cross = F.col("toxic") * (n - toxic) - (F.col("n") - F.col("toxic")) * toxic
    chi = F.lit(n) * cross * cross / (F.col("n") * (n - F.col("n")) * toxic * (n - toxic))
    chosen = counted.where(F.col("n") < n).withColumn("chi", chi).where(F.col("chi") >= DEPENDENT).orderBy(F.col("chi").desc(), "term").limit(TERMS).collect() if 0 < toxic < n else []
    number = {r["term"]: k for k, r in enumerate(chosen)}
    idf = np.array([np.log((1 + n) / (1 + r["n"])) + 1 for r in chosen])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = _counts(batch.column(2), number)
        return record_batch(id=batch.column(0), label=batch.column(1), terms=pa.array([r[0].tolist() for r in rows], pa.list_(pa.int32())), counts=pa.array([r[1].tolist() for r in rows], pa.list_(pa.int32())))

    slim = examples.select(F.coalesce(F.col(id_column).cast("long"), F.lit(-1)), F.col(label).cast("int"), text)
    counted_rows = stored(arrow_map(slim, count, "id bigint, label int, terms array<int>, counts array<int>"))
    rows = counted_rows.orderBy("id").toPandas()  # bounded: EXAMPLES, TERMS
    vectors = [(np.array(t, np.int64), np.array(c, np.int64)) for t, c in zip(rows["terms"], rows["counts"])]
    index = BlockMaxIndex(vectors, rows["label"].tolist(), rows["id"].tolist(), idf)
    shared = examples.sparkSession.sparkContext.broadcast(index)  # bounded like the rows

    def of_others(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*(batch.column(k).to_pylist() for k in range(3)))
        shares = [shared.value.votes_of_others(np.array(t, np.int64), np.array(c, np.int64), of) for of, t, c in rows]
        return record_batch(label=batch.column(0), share=pa.array(shares, pa.float64()))

    own = arrow_map(counted_rows.where(F.size("terms") > 0).select("label", "terms", "counts"), of_others, "label int, share double")
    judged = own.toPandas().sort_values(["share", "label"])  # EXAMPLES rows of two numbers; in order, so sums don't vary
    index.calibrate(judged["share"].to_numpy(), judged["label"].to_numpy(np.float64))
    return number, index


def labelled(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Texts of at most EXAMPLES labelled documents whose crc32(id) mod 5 is not 0: the fitting rows, stored."""
    own = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & ~held_out(id_column)).groupBy(id_column).agg(F.max(F.col(label).cast("int")).alias(label))
    chosen = own.orderBy(F.xxhash64(id_column), id_column).limit(EXAMPLES)
    slim = docs.select(id_column, F.coalesce(F.col(text), F.lit("")).alias(text))
    texts = slim.join(F.broadcast(chosen), id_column)  # EXAMPLES rows of two numbers
    return stored(texts.orderBy(F.xxhash64(id_column), text).limit(EXAMPLES).repartition(FIT_TASKS))


def held_out(id_column: str = "doc_id") -> Column:
    """True for ids that no label may be learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``id_column``, ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= 0.5), ``evidence`` of every row.

    ``evidence`` holds the ids of up to three nearest examples. A null text counts as empty; texts without any term of
    the index get the rate of such examples. Without any label to learn from every score is 0. Null and repeated ids keep
    their rows; a null label teaches nothing, of several labels the largest counts. Neighbours of one cosine go by the
    smaller id. A very long text is read whole; an empty table gives no rows. Other columns are not read.
    """
    scored = _scorer(docs, labels, id_column, text, label)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scored(batch.column(2))
        return record_batch(id=batch.column(0), held_out=batch.column(1), score=pa.array([s for s, _ in found], pa.float64()), evidence=pa.array([e for _, e in found], pa.list_(pa.int64())))

    slim = docs.select(id_column, held_out(id_column).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    kind = docs.schema[id_column].dataType.simpleString()
    out = arrow_map(slim, step, f"id {kind}, held_out boolean, score double, evidence array<bigint>")
    return out.select(F.col("id").alias(id_column), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def keep(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that ``toxicity`` scores below 0.5, with all their columns; decided where each row lies."""
    scored, at = _scorer(docs, labels, id_column, text, label), docs.columns.index(text)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([s < 0.5 for s, _ in scored(pc.fill_null(batch.column(at), ""))], pa.bool_()))

    return arrow_map(docs, clean, docs.schema)


def _scorer(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str) -> Callable[[pa.Array], list[tuple[float, list[int]]]]:
    """What scores texts inside tasks: fits the index, broadcasts it and remembers scored vectors."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled(docs, labels, id_column, text, label), id_column, text, label))
    memory: dict[tuple[bytes, bytes], tuple[float, list[int]]] = {}

    def scored(texts: pa.Array) -> list[tuple[float, list[int]]]:
        if shared.value is None:
            return [(0.0, [])] * len(texts)
        number, index = shared.value
        out = []
        for terms, counts in _counts(texts, number):
            key = (terms.tobytes(), counts.tobytes())
            if key not in memory:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[key] = index.score(terms, counts)
            out.append(memory[key])
        return out

    return scored
