"""Text quality by positive-unlabelled learning.

Only documents known to be good train as such; the others are web text of which an unknown
share is good. The classifier minimises the non-negative unbiased risk: the loss on positives
taken as negatives, times the class prior, is taken off the loss of unlabelled text as negative,
and where that difference falls below zero the step goes the other way. The class prior is the
least ratio, over regions of a first classifier's score, of the share of unlabelled text to that
of positives.

A text is described by shares of its letters, signs and repeated words; each share falls into one
of a few quantile ranges, and the classifier adds up a weight for each. Training fits on samples
of at most about ``SAMPLE`` positives and as many unlabelled texts, picked by hashes, on the
driver. Scoring goes over whole texts of all documents, in tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.llm.base import table
from ringwatch.llm.shingles import mix64, pieces, span_hashes, text_bytes, word_spans

SAMPLE = 15_000
RANGES = 16
THRESHOLD = 0.3
FEATURES = 16
_SIGN = np.zeros(256, dtype=np.int64)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_STOP = np.zeros(256, dtype=np.int64)
_STOP[[ord(c) for c in ".,;:'\"-"]] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1
_BAR = np.zeros(256, dtype=np.int64)
_BAR[[ord(c) for c in "|<>{}[]#&%$*@=_~^"]] = 1
_LINE = np.zeros(256, dtype=np.int64)
_LINE[10] = 1
_HIGH = np.zeros(256, dtype=np.int64)
_HIGH[128:] = 1


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each text's values."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]


def _repeats(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many of each text's items equal an earlier one."""
    keys = np.sort(mix64(hashes ^ mix64(text.astype(np.uint64))))
    if not len(keys):
        return np.zeros(n)
    _, first = np.unique(mix64(hashes ^ mix64(text.astype(np.uint64))), return_index=True)
    return np.bincount(text, minlength=n) - np.bincount(text[first], minlength=n)


def describe(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``FEATURES`` numbers for each text."""
    n = len(ends) - 1
    size = np.diff(ends)
    start, stop, text = word_spans(raw, ends)
    words = np.bincount(text, minlength=n)
    count, length = np.maximum(words, 1), np.maximum(size, 1)
    hashes = span_hashes(raw, start, stop) if len(start) else np.zeros(0, dtype=np.uint64)
    follows = (text[1:] == text[:-1]) if len(text) else np.zeros(0, dtype=bool)
    same = follows & (hashes[1:] == hashes[:-1]) if len(text) else follows
    two = mix64(hashes[:-1] + mix64(hashes[1:]))[follows] if len(text) else hashes
    pair = text[1:][follows] if len(text) else text
    ends_odd = np.bincount(text, (_SIGN - _STOP)[raw[stop - 1]] if len(stop) else None, n) if len(stop) else np.zeros(n)
    capital = np.bincount(text, _UPPER[raw[start]], n) if len(start) else np.zeros(n)
    signs, upper = _per_text(_SIGN[raw], ends), _per_text(_UPPER[raw], ends)
    columns = [
        np.log1p(words), size / count, signs / length, _per_text(_STOP[raw], ends) / count, upper / length,
        _per_text(_DIGIT[raw], ends) / length, _per_text(_BAR[raw], ends) / count, _per_text(_LINE[raw], ends) / count,
        _per_text(_HIGH[raw], ends) / length, ends_odd / count, capital / count, (upper - capital) / count,
        np.bincount(text[1:][same], minlength=n) / count if len(text) else np.zeros(n), _repeats(hashes, text, n) / np.sqrt(count),
        _repeats(hashes, text, n) / count, _repeats(two, pair, n) / count,
    ]
    return np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1)


@dataclass(frozen=True)
class QualityModel:
    """Bounds of the ranges of each feature, a weight for each range, and the class prior."""

    bounds: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def logit(self, rows: np.ndarray) -> np.ndarray:
        z = np.full(len(rows), self.bias)
        for k in range(rows.shape[1] if len(self.weights) else 0):
            z += self.weights[k][np.searchsorted(self.bounds[k], rows[:, k], side="right")]
        return z


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ranges(positive: np.ndarray, unlabelled: np.ndarray, slopes, ranges: int, rounds: int = 400, rate: float = 0.05,
               ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights by Adam; ``slopes`` gives the loss's slopes at the logits of both samples.

    The samples hold the number of the range of each feature.
    """
    features = positive.shape[1]
    shift = np.arange(features) * ranges
    p, u = positive + shift, unlabelled + shift
    weights = np.zeros(features * ranges + 1)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        dp, du = slopes(weights[p].sum(axis=1) + weights[-1], weights[u].sum(axis=1) + weights[-1])
        grad = np.append(
            np.bincount(p.ravel(), np.repeat(dp, features), features * ranges)
            + np.bincount(u.ravel(), np.repeat(du, features), features * ranges), dp.sum() + du.sum())
        grad[:-1] += ridge * weights[:-1]
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights[:-1].reshape(features, ranges), float(weights[-1])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """Least share of unlabelled scores above a bound, relative to that of positive scores.

    Bounds leave at least the share ``least`` of the positives above, so that the ratio is steady. The
    scores come from a classifier of other texts.
    """
    bounds = np.quantile(positive, np.linspace(0.0, 1 - least, 41))
    p, u = (1 - np.searchsorted(np.sort(x), bounds, side="left") / len(x) for x in (positive, unlabelled))
    return float(np.clip((u / np.maximum(p, 1e-9)).min(), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, ranges: int = RANGES) -> QualityModel:
    """A model from descriptions of positive and unlabelled texts."""
    if len(positive) < 2 or len(unlabelled) < 2:
        share = float(len(positive) > 0)
        return QualityModel(np.zeros((0, 0)), np.zeros((0, 0)), 30.0 * (2 * share - 1), share)
    bounds = np.quantile(np.concatenate((positive, unlabelled)), np.linspace(0, 1, ranges + 1)[1:-1], axis=0).T
    # outer ranges apart: junk lies beyond what good text shows
    low, high = np.quantile(positive, [0.002, 0.998], axis=0)
    bounds = np.sort(np.column_stack((bounds, low, high)), axis=1)
    place = lambda rows: np.stack([np.searchsorted(bounds[k], rows[:, k], side="right") for k in range(rows.shape[1])], axis=1)
    p, u = place(positive), place(unlabelled)
    count = bounds.shape[1] + 1

    def against(zp, zu):  # positives against unlabelled
        return -_sigmoid(-zp) / len(zp), _sigmoid(zu) / len(zu)

    rng = np.random.default_rng(5)
    half_p, half_u = (rng.permutation(len(x)) % 2 for x in (p, u))
    prior = 0.0
    for k in (0, 1):  # each half is judged by a classifier of the other
        first = QualityModel(bounds, *fit_ranges(p[half_p == k], u[half_u == k], against, count, rounds=200, ridge=2e-3), 0.5)
        prior += class_prior(first.logit(positive[half_p != k]), first.logit(unlabelled[half_u != k])) / 2

    def risk(zp, zu):  # non-negative unbiased risk with the logistic loss
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        good, taken, web = -prior * _sigmoid(-zp) / len(zp), prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
        return (good - taken, web) if negative >= 0 else (taken, -web)

    return QualityModel(bounds, *fit_ranges(p, u, risk, count, rounds=600, ridge=1e-4), prior)


_ROWS = "kind int, features array<double>"


def _described(batches):
    for batch in batches:
        column = batch.column("text")
        for first, last in pieces(column):
            rows = describe(*text_bytes(column.slice(first, last - first)))
            values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("kind").slice(first, last - first), values], names=["kind", "features"])


def _share_of(rows: DataFrame, sample: int, seed: int) -> DataFrame:
    """All rows, or those whose hash falls below the share that keeps about ``sample``."""
    n = rows.count()
    if n <= sample:
        return rows
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    return rows.where(place < max(1, int(1_000_000 * sample / n)))


def train(positives: DataFrame, unlabelled: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """A model from the ``text`` of trusted good documents and of web documents (``doc_id, text``)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    both = _share_of(positives, sample, 5).select(F.lit(1).alias("kind"), text).unionByName(
        _share_of(unlabelled, sample, 6).select(F.lit(0).alias("kind"), text))
    got = both.mapInArrow(_described, _ROWS).toArrow()
    kind = np.array(got.column("kind").to_pylist(), dtype=int)
    rows = np.array(got.column("features").to_pylist(), dtype=np.float64).reshape(-1, FEATURES)
    return fit(rows[kind == 1], rows[kind == 0])


def _scored(model: QualityModel, columns: list[str]):
    def run(batches):
        for batch in batches:
            column = batch.column("__text")
            for first, last in pieces(column):
                z = model.logit(describe(*text_bytes(column.slice(first, last - first))))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, last - first) for c in columns), pa.array(_sigmoid(z))], names=[*columns, "score"])

    return run


def score(docs: DataFrame, model: QualityModel, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's ``columns`` with ``score`` from 0 to 1, higher for better text.

    Null texts are scored as empty ones, whose features are all zero. Rows that repeat a doc_id all
    come back, each with its own score. Further columns are ignored.
    """
    own = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*columns).schema)
    return own.mapInArrow(_scored(model, list(columns)), f"{kinds}, score double")


def held_out():
    """The fold whose labels train nothing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """A model from the good documents outside the held-out fold, and all documents as web text."""
    good = labels.where(~held_out() & (F.col("quality") == 1)).select("doc_id").distinct()
    return train(docs.select("doc_id", "text").join(good, "doc_id", "left_semi"), docs.select("doc_id", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = train_on(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
