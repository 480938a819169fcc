"""Quality by a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or not at all on every text. Expectation-maximisation estimates each
labeller's accuracy and the share of good texts from the counts of vote patterns alone: there are at most
3 ** labellers patterns, counted over all rows. The posterior of each pattern is a probabilistic label; a linear
model over hashed features of the text learns these labels on a bounded sample and scores every row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difftide.llm.common import arrow_map, record_batch, stored

FIT_ROWS = 6_000  # rows that the scorer is fitted on, at most (chosen by a hash); votes and accuracies use all rows
HASHED = 1 << 14  # features of the scorer
ROUNDS = 60
STEPS = 120
REJECT = 0.5  # rows scored below are rejected
HELD = 20.0  # texts that the starting accuracies count as
MISTAKES = 0.002  # share of good texts that a labeller calls bad, at most

LABELLERS = ("capitals", "symbols", "variety", "repeats", "lines", "punctuation", "word_length", "shouting")
MEASURES = ("capitals", "symbols", "variety", "repeats", "lines", "sentence", "word_length", "shouts", "words")
STEPS_OF = np.array([20, 50, 10, 30, 10, 0.2, 1, 10, 0.02])  # steps of a measure for the scorer

_GOOD, _BAD, _NONE = 1, 0, 2
_BYTE_KINDS = np.zeros(256, np.uint8)  # 0: letters, digits and bytes of longer characters
_BYTE_KINDS[[9, 10, 11, 12, 13, 32]] = 1
_BYTE_KINDS[list(b"#$%&*+<=>@[]^_`{|}~\\/")] = 2
_BYTE_KINDS[list(range(65, 91))] = 3
_BYTE_KINDS[list(b".,;:?'\"()-")] = 4
_BYTE_KINDS[list(b"!")] = 5
#: RE2: letter and digit runs of a word, and the sign that stands for them in its shape.
_SHAPE = ((r"\pN+", "1"), (r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]{7,}", "w"), (r"\p{Ll}+", "a"))


class Texts:
    """A batch of texts, cut into words once; what the labellers and the scorer read of them."""

    def __init__(self, texts: pa.Array) -> None:
        self.n = len(texts)
        split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
        offsets = split.offsets.to_numpy()
        words = split.flatten()
        # an empty text splits into one empty word
        full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        self.edges = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
        coded = words.filter(pa.array(full)).dictionary_encode()
        self.words, self.at = coded.dictionary, coded.indices.to_numpy()
        self.row = np.repeat(np.arange(self.n), np.diff(self.edges))
        lower = pc.utf8_lower(self.words).dictionary_encode()
        self.lower = lower.dictionary
        self.lower_at = lower.indices.to_numpy()[self.at]
        self.measures = self._measures(texts)

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, flags, self.n)

    def _measures(self, texts: pa.Array) -> np.ndarray:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + self.n + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        kinds = _BYTE_KINDS[data]
        edges = offsets - offsets[0]
        text_of = np.repeat(np.arange(self.n, dtype=np.int32) * 6, np.diff(edges))
        of = np.bincount(text_of + kinds, minlength=6 * self.n).reshape(-1, 6).T
        count = np.diff(self.edges)
        different = _different(self.row, self.lower_at, self.n)
        again = np.zeros(len(self.row))
        again[1:] = (self.lower_at[1:] == self.lower_at[:-1]) & (self.row[1:] == self.row[:-1])
        ends = pc.match_substring_regex(self.words, r"[.?!]\"?$").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, "\n")
        lines = split.flatten().dictionary_encode()
        line_row = np.repeat(np.arange(self.n), np.diff(split.offsets.to_numpy()))
        filled = pc.match_substring_regex(lines.dictionary, r"\S").to_numpy(zero_copy_only=False)[lines.indices.to_numpy()]
        line_row, line_at = line_row[filled], lines.indices.to_numpy()[filled]
        line_count = np.bincount(line_row, minlength=self.n)
        line_kinds = _different(line_row, line_at, self.n)
        visible = np.diff(edges) - of[1]
        n = np.maximum(count, 1)
        return np.stack(
            [
                of[3] / np.maximum(of[0] + of[3], 1), of[2] / np.maximum(visible, 1), different / n, self._per_text(again) / np.maximum(count - 1, 1), 1 - line_kinds / np.maximum(line_count, 1) * (line_count > 0) - (line_count == 0),
                count / np.maximum(self._per_text(ends[self.at]), 1), visible / n, of[5] / n, count,
            ],
            axis=1,
        )

    def votes(self) -> np.ndarray:
        """One vote per text and labeller: good, bad or none where the text says little."""
        capitals, symbols, variety, repeats, lines, sentence, length, shouts, n = self.measures.T
        some = n >= 8
        expected = np.minimum(1.0, 6 / np.sqrt(np.maximum(n, 1)))  # texts repeat more words the longer they are

        def vote(bad: np.ndarray, good: np.ndarray | bool, enough: np.ndarray) -> np.ndarray:
            return np.where(enough & bad, _BAD, np.where(enough & good, _GOOD, _NONE))

        return np.stack(
            [
                vote(capitals > 0.3, capitals < 0.12, some), vote(symbols > 0.06, symbols < 0.02, n > 0), vote(variety < 0.35 * expected + 0.05, variety > 0.5 * expected, some),
                vote(repeats > 0.15, repeats < 0.03, n >= 20), vote(lines > 0.4, lines < 0.05, n >= 30), vote(sentence > 60, (sentence >= 3) & (sentence <= 35), n >= 15),
                vote((length < 2.5) | (length > 14), (length >= 3.5) & (length <= 10), some), vote(shouts > 0.2, shouts < 0.05, some),
            ],
            axis=1,
        )

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, hashed feature, value): shares of word shapes and of words, and the measures in steps."""
        share = 1.0 / np.maximum(np.diff(self.edges), 1)
        shape = pc.utf8_slice_codeunits(_shapes(self.words), 0, 8).dictionary_encode()
        shapes = _hashed("shape ", shape.dictionary)[shape.indices.to_numpy()[self.at]]
        words = _hashed("word ", self.lower)[self.lower_at]
        steps = np.clip(np.round(self.measures * STEPS_OF), 0, 12).astype(np.int64)
        table = _hashed("measure ", pa.array([f"{m} {k}" for m in MEASURES for k in range(13)]))
        measured = table[np.arange(len(MEASURES)) * 13 + steps]
        return (
            np.concatenate([self.row, self.row, np.repeat(np.arange(self.n), len(MEASURES))]),
            np.concatenate([shapes, words, measured.ravel()]),
            np.concatenate([3 * share[self.row], share[self.row], np.ones(measured.size)]),
        )

    def scores(self, weights: np.ndarray) -> np.ndarray:
        row, index, value = self.features()
        return 1 / (1 + np.exp(-np.clip(np.bincount(row, value * weights[index], self.n) + weights[-1], -30, 30)))


def _different(row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """How many different values of ``at`` each of ``n`` rows has."""
    pair = np.sort(row.astype(np.int64) << 32 | at)
    return np.bincount(pair[np.diff(pair, prepend=-1) != 0] >> 32, minlength=n)


def _hashed(kind: str, names: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32((kind + n).encode()) % HASHED for n in names.to_pylist()], np.int64)


def _shapes(words: pa.Array) -> pa.Array:
    """Words with their letter and digit runs as single signs: ``ABC!!`` is ``A!!``, a long word ``w``, a short one ``a``."""
    for kind, sign in _SHAPE:
        words = pc.replace_substring_regex(words, kind, sign)
    return words


def pattern_of(votes: np.ndarray) -> np.ndarray:
    """Each row's votes as one number in base 3."""
    return votes @ 3 ** np.arange(len(LABELLERS) - 1, -1, -1)


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return np.asarray(patterns)[:, None] // 3 ** np.arange(len(LABELLERS) - 1, -1, -1) % 3


def expectation_maximisation(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], float, np.ndarray]:
    """(probability of good by pattern, share of good, how often each labeller that votes calls texts of a class bad).
    Abstentions say nothing. Labellers each see one kind of bad text, so most of them call any bad text good; what tells the
    classes apart is that they hardly ever call a good text bad, at most ``MISTAKES`` of them. Without that bound the
    largest kind of bad texts would become the class and the others count as good. The start counts as ``HELD`` texts."""
    patterns = np.array(list(counts), np.int64)
    v = votes_of(patterns)
    n = np.array(list(counts.values()), np.float64)
    share, calls_bad = 0.8, np.array([np.full(len(LABELLERS), 0.25), np.full(len(LABELLERS), MISTAKES)])  # by class: bad, good
    good = np.zeros(len(n))
    for _ in range(rounds):
        evidence = np.where(v == _BAD, np.log(calls_bad[_GOOD] / calls_bad[_BAD]), np.where(v == _GOOD, np.log((1 - calls_bad[_GOOD]) / (1 - calls_bad[_BAD])), 0.0))
        good = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + evidence.sum(axis=1), -50, 50)))
        share = (0.8 * HELD + (n * good).sum()) / (HELD + n.sum())
        for c, start, weight in ((_BAD, 0.25, n * (1 - good)), (_GOOD, MISTAKES, n * good)):
            voted = (weight[:, None] * (v != _NONE)).sum(axis=0)
            calls_bad[c] = (HELD * start + (weight[:, None] * (v == _BAD)).sum(axis=0)) / (HELD + voted)
        calls_bad[_GOOD] = np.clip(calls_bad[_GOOD], 1e-4, MISTAKES)
        calls_bad[_BAD] = np.clip(calls_bad[_BAD], 0.02, 0.98)
    return dict(zip(patterns.tolist(), good.tolist())), float(share), calls_bad


def fit_scorer(row: np.ndarray, index: np.ndarray, value: np.ndarray, target: np.ndarray, steps: int = STEPS, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic model for probabilistic targets, by gradient steps."""
    weights, square = np.zeros(HASHED + 1), np.full(HASHED + 1, 1e-6)
    n = len(target)
    for _ in range(steps if n else 0):
        score = np.bincount(row, value * weights[index], n) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
        slope = np.append(np.bincount(index, value * error[row], HASHED), error.sum()) / n + decay * weights
        square += slope * slope
        weights -= 0.3 * slope / np.sqrt(square)
    return weights


def fit(docs: DataFrame, id_column: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, dict[int, float]]:
    """(weights of the scorer, posterior of each vote pattern), from all rows' votes and a sample's features."""
    body = F.coalesce(F.col(text), F.lit(""))
    share = min(1.0, 2 * fit_rows / max(1, docs.select(id_column).count()))
    pick = F.xxhash64(F.col(id_column), F.length(body))
    chosen = F.pmod("pick", F.lit(1 << 20)) < int(share * (1 << 20)) + 1

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        pattern = pattern_of(Texts(batch.column(0)).votes())
        sampled = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
        row, feature, value = Texts(batch.column(0).take(pa.array(sampled))).features()
        pair, inverse = np.unique(row * HASHED + feature, return_inverse=True)
        value = np.bincount(inverse, value, len(pair))
        cut = np.searchsorted(pair // HASHED, np.arange(len(sampled) + 1))
        made = {k: (pair[a:b] % HASHED, value[a:b]) for k, a, b in zip(sampled.tolist(), cut, cut[1:])}
        return record_batch(
            pattern=pa.array(pattern, pa.int32()), pick=batch.column(1),
            index=pa.array([made[k][0].tolist() if k in made else None for k in range(batch.num_rows)], pa.list_(pa.int32())),
            value=pa.array([made[k][1].tolist() if k in made else None for k in range(batch.num_rows)], pa.list_(pa.float32())),
        )

    voted = stored(arrow_map(docs.select(body.alias("body"), pick.alias("pick")).withColumn("chosen", chosen).select("body", "pick", "chosen"), vote, "pattern int, pick bigint, index array<int>, value array<float>"))
    counts = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # 3 ** labellers at most
    posterior = expectation_maximisation(counts)[0] if counts else {}
    table = voted.where("index is not null").orderBy("pick", "pattern").limit(fit_rows).select("pattern", "index", "value").toArrow()  # bounded: fit_rows, HASHED
    lists = table.column("index").combine_chunks()
    row = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy())) if table.num_rows else np.zeros(0, np.int64)
    target = np.array([posterior[p] for p in table.column("pattern").to_pylist()])
    index, value = (lists.flatten().to_numpy().astype(np.int64), table.column("value").combine_chunks().flatten().to_numpy().astype(np.float64)) if table.num_rows else (row, row)
    return fit_scorer(row, index, value, target), posterior


def quality(docs: DataFrame, id_column: str = "doc_id", text: str = "text", reject: float = REJECT, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id_column``, ``votes`` (by labeller), ``weak_label`` (posterior), ``score`` (0 to 1), ``kept`` of every row.

    ``kept`` is score >= ``reject``. A null text counts as empty; nobody votes on a text without words, so its weak label is the
    share of good texts. Null and repeated ids keep their rows. A very long text is read whole and scored like any other; an empty table gives no
    rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_column, text, fit_rows))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights, posterior = shared.value
        texts = Texts(batch.column(1))
        cast = texts.votes()
        return record_batch(id=batch.column(0), votes=pa.array(cast.tolist(), pa.list_(pa.int32())), weak_label=pa.array([posterior[p] for p in pattern_of(cast).tolist()], pa.float64()), score=pa.array(texts.scores(weights)))

    slim = docs.select(id_column, F.coalesce(F.col(text), F.lit("")).alias("body"))
    out = arrow_map(slim, score, f"id {docs.schema[id_column].dataType.simpleString()}, votes array<int>, weak_label double, score double")
    return out.select(F.col("id").alias(id_column), "votes", "weak_label", "score", (F.col("score") >= reject).alias("kept"))


def keep(docs: DataFrame, id_column: str = "doc_id", text: str = "text", reject: float = REJECT, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns; decided where each row lies."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_column, text, fit_rows))
    at = docs.columns.index(text)

    def good(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(Texts(pc.fill_null(batch.column(at), "")).scores(shared.value[0]) >= reject))

    return arrow_map(docs, good, docs.schema)
