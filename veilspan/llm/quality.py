"""Quality classifier: a weak-label model over heuristic labellers, then a hashed linear scorer.

Heuristic labellers vote good (+1), bad (-1) or nothing (0) on every whole text. Their
accuracies and coverage are estimated without gold labels by expectation-maximisation over
the counts of vote patterns in all documents (at most 3 ** 10 patterns reach the driver), with a prior that bad
votes on good texts are rare. The
posterior of each pattern labels a bounded sample (SAMPLE rows and SAMPLE_BYTES of text as expected, by a
seeded hash of each row's id and place), on which a logistic scorer over hashed word shapes is trained; it then
scores every document.

A text without words, null or empty ones too, gets no vote and isn't trained on; it scores 0: rejected.
Repeated rows score alike; ties at the threshold are kept; an empty table gives an empty
one. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.tables import table
from veilspan.llm.words import Words, mix, slices

SAMPLE = 20_000
SAMPLE_BYTES = 64 << 20
DIMS = 1 << 14
THRESHOLD = 0.5
LABELLERS = ("symbols", "marks", "plain", "shouting", "bangs", "separators", "stutter", "chants", "variety", "sentences")
BELIEF = 0.05  # weight of the prior on votes, as a share of all rows
WRONG_ALARM = 0.01  # prior rate of a bad vote on a good text
_U = np.uint64
_BAR = np.zeros(256, bool)
_BAR[list(b"#$*%&|~^_=<>\\{}")] = True
_END = np.zeros(256, bool)
_END[list(b".?")] = True
#: classes of bytes in a word's shape: lower, upper, digit, beyond ASCII; other bytes stand for themselves
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97


def _share(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])[bounds]
    return np.diff(total) / np.maximum(1, np.diff(bounds))


def votes(words: Words) -> np.ndarray:
    """Votes of all labellers, texts x labellers."""
    data, n = words.data, words.count
    upper, letters = (data >= 65) & (data <= 90), _SHAPE[data]
    letters = (letters == 97) | (letters == 65)
    last = data[words.end - 1] if len(words.end) else data[:0]
    h = words.hashes()
    same_text = np.r_[False, words.text[1:] == words.text[:-1]] if len(h) else np.zeros(0, bool)
    again = same_text & np.r_[False, h[1:] == h[:-1]] if len(h) else same_text
    chant = again & np.r_[False, again[:-1]] if len(h) else again  # the third of a run, or a later one
    chants = _share(chant, words.first)
    order = np.lexsort((h, words.text))
    fresh = np.zeros(len(h), bool)
    if len(h):
        fresh[order] = np.r_[True, (h[order][1:] != h[order][:-1]) | (words.text[order][1:] != words.text[order][:-1])]
    cap = np.diff(np.concatenate([[0], np.cumsum(upper)])[words.bounds]) / np.maximum(1, np.diff(np.concatenate([[0], np.cumsum(letters)])[words.bounds]))
    lone = (words.end - words.start == 1) & ~letters[words.start] & ~((data[words.start] >= 48) & (data[words.start] <= 57)) if len(h) else fresh
    mark = words.end - words.start - np.diff(np.concatenate([[0], np.cumsum(letters)])[np.stack([words.start, words.end])], axis=0)[0] if len(h) else fresh
    plain = (mark == 0) | ((mark == 1) & ~letters[words.end - 1] & ~_BAR[last]) if len(h) else fresh
    marks = _share((data > 32) & (data < 127) & ~letters & ~((data >= 48) & (data <= 57)), words.bounds)
    plain = _share(plain & ~lone, words.first)
    symbols, bangs, stutter = _share(_BAR[last], words.first), _share(last == 33, words.first), _share(again, words.first)
    variety, ends, alone = _share(fresh, words.first), _share(_END[last], words.first), _share(lone, words.first)

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, -1, np.where(good, 1, 0))

    some, many = n >= 3, n >= 30
    out = [
        vote((symbols > 0.08) & some, (symbols < 0.02) & some),
        vote((marks > 0.15) & some, (marks < 0.08) & some),
        vote((plain < 0.6) & some, (plain > 0.85) & some),
        vote((cap > 0.5) & (n >= 8), (cap < 0.2) & some),
        vote((bangs > 0.1) & some, (bangs < 0.02) & some),
        vote((alone > 0.1) & some, (alone < 0.02) & some),
        vote((stutter > 0.2) & some, (stutter < 0.05) & some),
        vote((chants > 0.1) & some, (chants < 0.02) & some),
        vote((variety < 0.3) & many & (n < 400), (variety > 0.5) & many),
        vote((ends < 0.005) & many, (ends > 0.02) & (ends < 0.5) & many),
    ]
    return np.stack(out, 1) * (n > 0)[:, None]


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shapes of words, of pairs of words, and repeats; and where each text's start and the last end."""
    shape = _SHAPE[words.data]
    fresh = np.ones(len(shape), bool)
    fresh[1:] = shape[1:] != shape[:-1]
    fresh[words.bounds[words.bounds < len(shape)]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    shapes = Words(shape[fresh], kept[words.bounds])
    one, h = shapes.hashes(), words.hashes()
    if not len(one):
        return np.zeros(0, np.int64), np.zeros(len(words.bounds), np.int64)
    before = np.r_[_U(0), one[:-1]]
    first = np.r_[True, words.text[1:] != words.text[:-1]]
    before[first] = 0
    again = np.r_[False, h[1:] == h[:-1]] & ~first
    two = mix(one + _U(3) * before + again.astype(_U) * _U(0x9E3779B97F4A7C15))
    half = DIMS // 2
    out = np.stack([one % _U(half), _U(half) + two % _U(half)], 1).reshape(-1).astype(np.int64)
    return out, 2 * words.first


@dataclass
class WeakLabels:
    prior: float
    vote_given_good: np.ndarray  # labellers x (bad, none, good)
    vote_given_bad: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good; to abstain says nothing."""
        at, cast = np.arange(pattern.shape[1]), pattern != 0
        good = np.log(self.prior) + (cast * np.log(self.vote_given_good[at, pattern + 1])).sum(1)
        bad = np.log(1 - self.prior) + (cast * np.log(self.vote_given_bad[at, pattern + 1])).sum(1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """How often each labeller's votes are right, where it votes."""
        right = self.prior * self.vote_given_good[:, 2] + (1 - self.prior) * self.vote_given_bad[:, 0]
        wrong = self.prior * self.vote_given_good[:, 0] + (1 - self.prior) * self.vote_given_bad[:, 2]
        return dict(zip(LABELLERS, (right / (right + wrong)).tolist()))


def expectation_maximisation(pattern: np.ndarray, rows: np.ndarray, steps: int = 100) -> WeakLabels:
    """Fit to counts of vote patterns, starting from one bad vote outweighing the good ones."""
    good = np.where((pattern < 0).any(1), 0.1, 0.95)
    model = None
    seen = np.stack([(rows[:, None] * (pattern == v)).sum(0) for v in (-1, 0, 1)], 1) / rows.sum() + 1e-6
    cast = seen[:, [0, 2]].sum(1)
    expected = [BELIEF * rows.sum() * np.stack([rate * cast, seen[:, 1], (1 - rate) * cast], 1) for rate in (WRONG_ALARM, 0.4)]
    for _ in range(steps):
        tables = []
        for weight, prior_votes in zip((good * rows, (1 - good) * rows), expected):
            t = np.stack([(weight[:, None] * (pattern == v)).sum(0) for v in (-1, 0, 1)], 1) + prior_votes
            tables.append(t / t[:, [0, 2]].sum(1, keepdims=True))
        prior = float(np.clip((good * rows).sum() / max(1, rows.sum()), 0.01, 0.99))
        model = WeakLabels(prior, *tables)
        now = model.posterior(pattern)
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return model


def weak_labels(df: DataFrame, text_column: str) -> tuple[WeakLabels | None, int, int]:
    """The label model, and the rows and bytes of text that it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = (np.zeros(3 ** len(LABELLERS), np.int64) for _ in range(2))
        for batch in batches:
            for _, data, bounds in slices(batch, text_column):
                code = (votes(Words(data, bounds)) + 1) @ (3 ** np.arange(len(LABELLERS)))
                total += np.bincount(code, minlength=len(total))
                size += np.bincount(code, np.diff(bounds), len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(size[at])], ["pattern", "n", "bytes"])

    found = df.select(text_column).mapInArrow(run, "pattern long, n long, bytes long").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).toPandas()
    if found.empty:
        return None, 0, 0
    pattern = found["pattern"].to_numpy()[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    return expectation_maximisation(pattern, found["n"].to_numpy()), int(found["n"].sum()), int(found["bytes"].sum())


def _fit_linear(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, target: np.ndarray, steps: int = 300, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model with soft targets, by Adam on the whole sample."""
    w, m, v = np.zeros(DIMS + 1), np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    n = len(target)
    for step in range(1, steps + 1):
        margin = np.bincount(rows, values * w[columns], n) + w[-1]
        error = (1 / (1 + np.exp(-margin)) - target) / n
        g = np.append(np.bincount(columns, values * error[rows], DIMS), error.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def fit(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray | None:
    """Weights of the scorer, or None for an empty table. sample and sample_bytes bound what is trained on."""
    labels, rows, size = weak_labels(df, text_column)
    if labels is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in slices(batch, text_column):
                words = Words(data, bounds)
                target = labels.posterior(votes(words))
                some = words.count > 0
                idx, edge = features(words)
                found = [np.unique(idx[a:b], return_counts=True) for a, b in zip(edge[:-1][some], edge[1:][some])]
                yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x, _ in found], pa.list_(pa.int32())), pa.array([(c / max(1, c.sum())).tolist() for _, c in found], pa.list_(pa.float32())), pa.array(target[some])], ["idx", "share", "target"])

    unit = F.shiftrightunsigned(F.xxhash64(F.lit(13), id_column, F.monotonically_increasing_id()), 11) / F.lit(float(1 << 53))
    some = df.select(text_column, unit.alias("_unit")).where(F.col("_unit") < min(1.0, sample / max(1, rows), sample_bytes / max(1, size))).select(text_column)
    got = some.mapInArrow(run, "idx array<int>, share array<float>, target double").toArrow()
    if not len(got):
        return None
    sizes = pa.compute.list_value_length(got["idx"]).to_numpy()
    at = np.repeat(np.arange(len(got)), sizes)
    return _fit_linear(at, got["idx"].combine_chunks().flatten().to_numpy(), got["share"].combine_chunks().flatten().to_numpy().astype(float), got["target"].to_numpy())


def scores(weights: np.ndarray | None, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    words = Words(data, bounds)
    out = np.zeros(len(bounds) - 1)
    some = words.count > 0
    if weights is None or not some.any():
        return out
    idx, edge = features(words)
    margin = np.add.reduceat(weights[idx], edge[:-1][some]) / (2 * words.count[some]) + weights[-1]
    out[some] = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return out


def scored(df: DataFrame, weights: np.ndarray | None, columns: tuple[str, ...] = ("doc_id",), text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The named columns of each row, then quality_score and keep."""
    kinds = dict(df.dtypes)
    read = text_column if text_column in columns else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, read):
                found = scores(weights, data, bounds)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(columns)], pa.array(found), pa.array(found >= threshold)], [*columns, "quality_score", "keep"])

    shape = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", quality_score double, keep boolean"
    return df.select(*columns, *([] if text_column in columns else [F.col(text_column).alias("_text")])).mapInArrow(run, shape)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
ORACLE: dict[str, str] = {}
