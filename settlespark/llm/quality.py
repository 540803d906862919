"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  An
expectation-maximisation estimates how often each of them is right from the way their
votes agree over the whole table, which needs only the counts of vote patterns.  The
posterior of a pattern is the soft label of its documents, and a linear model on
hashed features learns from a bounded sample of them; it scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlespark.llm.batches import map_batches, others, restore, text_or_empty
from settlespark.llm.columns import row_key

# Rows that the scorer learns from, in expectation.
SAMPLE_ROWS = 20_000
BUCKETS = 8_192
# Features of a text that the scorer learns from, the largest ones.
LEARNT_FEATURES = 1_024
# Words of a part of a text whose variety is measured.
PART_WORDS = 1_000
BAD, GOOD, NONE = 0, 1, 2

SPACE, UPPER, LOWER, DIGIT, STOP, SYMBOL, OTHER = range(7)


def _byte_classes() -> np.ndarray:
    classes = np.full(256, OTHER, np.uint8)
    classes[:128] = SYMBOL
    for class_, characters in (
        (SPACE, b" \t\n\r\x0b\x0c"), (UPPER, bytes(range(65, 91))), (LOWER, bytes(range(97, 123))),
        (DIGIT, bytes(range(48, 58))), (STOP, b".,;:'\"()-?"),
    ):
        classes[list(characters)] = class_
    return classes


CLASSES = _byte_classes()


# Shares are taken of at least so many words or bytes, so that one odd word does not
# decide on a short text.
LEAST_WORDS, LEAST_BYTES = 30, 200
SYMBOLS, CAPITALS, REPEATS, LONE, TRAILING, VARIED, LENGTH = range(7)


def _variety(words: list[bytes]) -> float:
    """Share of distinct words, the mean over equal parts of ``PART_WORDS`` words or more,
    so that it does not fall with the length of a text."""
    parts = max(1, len(words) // PART_WORDS)
    cuts = [len(words) * i // parts for i in range(parts + 1)]
    return sum(len(set(words[a:b])) / max(1, b - a) for a, b in zip(cuts, cuts[1:])) / parts


def _measure(text: bytes, codes: np.ndarray, words: list[bytes]) -> tuple[float, ...]:
    """Statistics of a text: shares of symbols, capitals, words that repeat the one
    before, lone symbols, words that end in a symbol, distinct words; bytes a word."""
    classes = CLASSES[codes]
    counts = np.bincount(classes, minlength=7)
    letters = counts[UPPER] + counts[LOWER] + counts[OTHER]
    space, symbol = classes == SPACE, classes == SYMBOL
    lone = np.count_nonzero(space[:-2] & symbol[1:-1] & space[2:]) if len(codes) > 2 else 0
    ending = np.count_nonzero(symbol[:-1] & space[1:]) - lone if len(codes) > 1 else 0
    n = max(LEAST_WORDS, len(words))
    return (
        counts[SYMBOL] / max(LEAST_BYTES, len(codes)), counts[UPPER] / max(LEAST_BYTES, letters),
        sum(map(eq, words, words[1:])) / n, lone / n, ending / n,
        _variety(words), len(text) / max(1, len(words)),
    )


@dataclass(frozen=True)
class Labeller:
    """Votes bad or good where a statistic lies in the (closed) range, else nothing."""

    name: str
    statistic: int
    bad: tuple[float, float]
    good: tuple[float, float] = (2.0, 1.0)

    def vote(self, measured: tuple[float, ...]) -> int:
        x = measured[self.statistic]
        if self.bad[0] <= x <= self.bad[1]:
            return BAD
        return GOOD if self.good[0] <= x <= self.good[1] else NONE


LABELLERS = (
    Labeller("symbols", SYMBOLS, (0.04, 1.0)),
    Labeller("capitals", CAPITALS, (0.25, 1.0), (0.002, 0.06)),
    Labeller("repeats", REPEATS, (0.10, 1.0)),
    Labeller("separators", LONE, (0.08, 1.0)),
    Labeller("decorations", TRAILING, (0.10, 1.0)),
    Labeller("variety", VARIED, (0.0, 0.15), (0.45, 1.0)),
    Labeller("word length", LENGTH, (14.0, float("inf")), (4.0, 7.5)),
)
PATTERNS = 3 ** len(LABELLERS)
POWERS = 3 ** np.arange(len(LABELLERS))
# Edges of the bins in which the scorer sees each statistic.
EDGES = tuple(np.array(e) for e in (
    (0.005, 0.01, 0.02, 0.04, 0.08, 0.15), (0.03, 0.06, 0.1, 0.2, 0.4, 0.7), (0.002, 0.01, 0.03, 0.1, 0.3, 0.6),
    (0.002, 0.01, 0.03, 0.1, 0.2, 0.3), (0.002, 0.01, 0.03, 0.1, 0.2, 0.5), (0.05, 0.15, 0.3, 0.5, 0.7, 0.9),
    (4.5, 5.5, 6.5, 7.5, 9, 12)))


def _vote(measured: tuple[float, ...]) -> int:
    """The votes of all labellers as one number to base three."""
    return int(sum(p * l.vote(measured) for p, l in zip(POWERS.tolist(), LABELLERS)))


def features(text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """The vote pattern, and the hashed features (buckets and values) of a text.

    Features are byte pairs, with root counts scaled to length one, and the bins of the
    statistics.
    """
    codes = np.frombuffer(text, np.uint8)
    measured = _measure(text, codes, text.split())
    pairs = codes[:-1].astype(np.uint32) * 256 + codes[1:]
    counts = np.bincount(pairs * np.uint32(2654435761) >> np.uint32(19), minlength=BUCKETS)
    buckets = np.flatnonzero(counts)
    values = np.sqrt(counts[buckets])
    values /= max(1e-9, np.sqrt((values ** 2).sum()))
    bins = np.array([
        (i * 16 + int(np.searchsorted(edges, x)) + 1) * 2654435761 % 2**32 >> 19
        for i, (x, edges) in enumerate(zip(measured, EDGES))])
    return _vote(measured), np.concatenate((buckets, bins)), np.concatenate((values, np.full(len(bins), 0.5)))


# What labellers are believed to do before any document is seen: the probabilities of
# votes (bad, good, none) on a bad and on a good document, and the weight of this belief.
BELIEF = np.array([[0.30, 0.10, 0.60], [0.005, 0.40, 0.595]])
BELIEF_SHARE = 0.05


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // POWERS % 3


@dataclass
class WeakModel:
    """Share of good documents, and per labeller the probability of each vote by class."""

    prior: float
    votes: np.ndarray  # labeller, class (bad, good), vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each pattern; votes are independent within a class."""
        log = np.log(np.array([1 - self.prior, self.prior]))[None, :] + sum(
            np.log(self.votes[j][:, v].T) for j, v in enumerate(votes_of(patterns).T))
        return 1 / (1 + np.exp(log[:, 0] - log[:, 1]))

    @property
    def accuracy(self) -> np.ndarray:
        """How often each labeller is right when it votes."""
        share = np.array([1 - self.prior, self.prior])
        right = sum(share[c] * self.votes[:, c, c] for c in (BAD, GOOD))
        cast = sum(share[c] * self.votes[:, c, v] for c in (BAD, GOOD) for v in (BAD, GOOD))
        return right / np.maximum(cast, 1e-12)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> WeakModel:
    """Fit to the counts of vote patterns, starting from the majority of the votes.

    ``BELIEF`` enters as votes cast beforehand, ``BELIEF_SHARE`` for each document, so
    that no labeller is taken for one that tells the classes the wrong way round.
    """
    votes = votes_of(patterns)
    good, bad = (votes == GOOD).sum(axis=1), (votes == BAD).sum(axis=1)
    # labellers know different faults, so one bad vote outweighs the good ones at first
    p = np.where(bad > 0, 0.1, np.where(good > 0, 0.9, 0.5))
    model = None
    for _ in range(steps):
        weight = np.stack([(1 - p) * counts, p * counts])
        table = np.repeat(1e-3 + BELIEF[None] * BELIEF_SHARE * counts.sum(), len(LABELLERS), axis=0)
        for j in range(len(LABELLERS)):
            for c in (BAD, GOOD):
                table[j, c] += np.bincount(votes[:, j], weights=weight[c], minlength=3)
        table /= table.sum(axis=2, keepdims=True)
        prior = (weight[GOOD].sum() + 1) / (weight.sum() + 2)
        model = WeakModel(float(prior), table)
        before, p = p, model.posterior(patterns)
        if np.abs(p - before).max(initial=0) < 1e-7:
            break
    return model


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on soft labels."""
    if not rows:
        return np.zeros(BUCKETS + 1)
    return _fit(
        np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]),
        np.array([len(r[0]) for r in rows]), label, steps)


def _fit(
    index: np.ndarray, value: np.ndarray, sizes: np.ndarray, label: np.ndarray, steps: int = 200
) -> np.ndarray:
    """The same from the features of all rows, one after another, and their numbers."""
    weights = np.zeros(BUCKETS + 1)
    starts = np.cumsum(sizes) - sizes
    # both classes weigh the same
    balance = np.where(label >= 0.5, 0.5 / max(1e-9, (label >= 0.5).mean()), 0.5 / max(1e-9, (label < 0.5).mean()))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        # one array of the length of all features at a time
        each = weights[index]
        each *= value
        z = np.add.reduceat(each, starts) + weights[-1]
        del each
        error = (1 / (1 + np.exp(-z)) - label) * balance / len(sizes)
        each = np.repeat(error, sizes)
        each *= value
        slope = np.append(np.bincount(index, weights=each, minlength=BUCKETS), error.sum())
        del each
        slope[:-1] += 1e-5 * weights[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope ** 2
        weights -= 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return weights


def _patterns(batches, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[int, int] = {}
        for text in batch["text"]:
            body = text.as_py()
            pattern = _vote(_measure(body, np.frombuffer(body, np.uint8), body.split()))
            counts[pattern] = counts.get(pattern, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], schema=schema)


def _train(batches, schema: pa.Schema, posterior: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, sizes, label = [], [], []
    for batch in batches:
        rows = []
        for text in batch["text"]:
            pattern, index, value = features(text.as_py())
            if len(index) > LEARNT_FEATURES:
                most = np.sort(np.argsort(-value, kind="stable")[:LEARNT_FEATURES])
                index, value = index[most], value[most]
            rows.append((index.astype(np.int32), value.astype(np.float32)))
            label.append(posterior[pattern])
        if rows:
            sizes += [len(index) for index, _ in rows]
            parts.append(tuple(map(np.concatenate, zip(*rows))))
    weights = np.zeros(BUCKETS + 1)
    if parts:
        index, value = map(np.concatenate, zip(*parts))
        # the fit holds the features once
        parts, rows = [], []
        weights = _fit(index, value, np.array(sizes), np.array(label))
    yield pa.RecordBatch.from_arrays([pa.array([weights], schema.field(0).type)], schema=schema)


def _score(batches, schema: pa.Schema, weights: np.ndarray, posterior: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores, labels = [], []
        for text in batch["text"]:
            pattern, index, value = features(text.as_py())
            z = float((weights[index] * value).sum() + weights[-1])
            scores.append(1 / (1 + np.exp(-z)))
            labels.append(float(posterior[pattern]))
        yield pa.RecordBatch.from_arrays([
            batch["id"], batch["rest"], batch["own"], pa.array(scores, pa.float64()),
            pa.array(labels, pa.float64())], schema=schema)


def _texts(df: DataFrame, id: str, text: str) -> DataFrame:
    body = text_or_empty(text)
    return df.select(
        F.col(f"`{id}`").alias("id"), body.cast("binary").alias("text"), F.col(f"`{text}`").alias("own"),
        others(df, id, text).alias("rest"), row_key(F.col(f"`{id}`"), body).alias("key"))


def fit_quality(df: DataFrame, id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS):
    """The weak model over all rows, and the scorer's weights from about ``sample_rows``.

    The one task that learns holds at most ``LEARNT_FEATURES`` numbers of each.
    Rows of the sample are chosen by a hash of id and text, and rows equal in both
    count once.  At most ``PATTERNS`` counts
    and one row of weights reach the driver.
    """
    held = _texts(df, id, text)
    counted = map_batches(held.select("text"), _patterns, T.StructType([
        T.StructField("pattern", T.IntegerType()), T.StructField("n", T.LongType())]))
    found = counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns = np.array([r.pattern for r in found], np.int64)
    counts = np.array([r.n for r in found], np.float64)
    model = expectation_maximisation(patterns, counts)
    posterior = model.posterior(np.arange(PATTERNS))
    share = min(1.0, sample_rows / max(1.0, counts.sum()))
    sample = held.filter(
        F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))
    ).select("key", "text").dropDuplicates(["key"]).select("text")
    learned = map_batches(sample.repartition(1), _train, T.StructType(
        [T.StructField("weights", T.ArrayType(T.DoubleType()))]), posterior)
    return model, posterior, np.array(learned.collect()[0].weights)


def _scored(df: DataFrame, id: str, text: str, sample_rows: int) -> DataFrame:
    _, posterior, weights = fit_quality(df, id, text, sample_rows)
    held = _texts(df, id, text).drop("key")
    return map_batches(held, _score, T.StructType([
        held.schema["id"], held.schema["rest"], held.schema["own"],
        T.StructField("score", T.DoubleType()), T.StructField("weak_label", T.DoubleType()),
    ]), weights, posterior)


def quality_scores(
    df: DataFrame, id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row per row of ``df``: id, ``score`` (probability of good), ``weak_label``
    (posterior of the labellers) and ``kept`` (a score of one half or more).

    A null text counts as empty, an empty text is judged like any other.  Rows may
    repeat; other columns are ignored; an empty table gives no row.
    """
    scored = _scored(df.select(F.col(f"`{id}`"), F.col(f"`{text}`")), id, text, sample_rows)
    return scored.select(
        F.col("id").alias(id), "score", "weak_label", (F.col("score") >= 0.5).alias("kept"))


def drop_low_quality(
    df: DataFrame, id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """The kept rows of ``df`` with all columns."""
    kept = _scored(df, id, text, sample_rows).filter("score >= 0.5")
    return restore(kept, df.columns, **{id: F.col("id"), text: F.col("own")})
