"""Toxic texts by multiple-instance learning over their sentences.

Labels stand at whole documents, the offence in single sentences. A sentence has a logistic
score from its words; a document is toxic if at least one sentence is, so its score is the
noisy-or of theirs. Only the documents' labels train the words' weights; the gradient of the
noisy-or reaches the sentences that explain a label. The scores then point at these.

Features of a sentence are its words and their first four bytes, which know inflected forms.
Only what stands in clearly more toxic documents than chance would have it takes part.

Training fits on a sample of the labelled documents of at most about ``SAMPLE`` rows, picked by a
hash, on the driver. Scoring goes over whole texts of all documents, in tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.llm.base import stored, table
from ringwatch.llm.shingles import pieces, span_hashes, text_bytes, word_spans

SAMPLE = 10_000
#: Training documents that a word must stand in to have a weight.
RARE = 5
#: Standard errors by which a word must stand in more toxic documents than by chance.
CLEAR = 4.0
#: Features with a weight at most, the clearest first.
WORDS = 20_000
THRESHOLD = 0.3

_BETWEEN = np.zeros(256, dtype=bool)  # bytes between words: blanks and ASCII signs, not letters or digits
_BETWEEN[:128] = True
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_ENDS = np.zeros(256, dtype=bool)  # bytes that end a sentence
_ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of word hashes, sorted by hash, and the logit of a sentence without known words."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def sentences_of(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and their beginnings, sentence by sentence, with the sentence each is in; for
    each sentence its text, begin and end."""
    start, stop, text = word_spans(raw, ends, _BETWEEN)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.int64),) * 4
    closed = np.cumsum(_ENDS[raw])
    mark = np.empty(len(start), dtype=bool)
    mark[0] = True
    mark[1:] = (closed[start[1:]] != closed[start[:-1]]) | (text[1:] != text[:-1])
    first = np.flatnonzero(mark)
    last = np.append(first[1:], len(start)) - 1
    both = np.empty(2 * len(start), dtype=np.uint64)
    both[::2] = span_hashes(raw, start, stop)
    both[1::2] = ~span_hashes(raw, start, np.minimum(start + 4, stop))
    return both, np.repeat(np.cumsum(mark) - 1, 2), text[first], start[first], stop[last]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def fit_noisy_or(word: np.ndarray, sentence: np.ndarray, text: np.ndarray, blank: np.ndarray, toxic: np.ndarray, features: int,
                 rounds: int = 300, rate: float = 0.1, lasso: float = 2e-4, least: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of the sentences' logits, by Adam on the documents' log loss.

    A word keeps a weight only if it explains more than the share ``lasso`` of all documents and
    ``least`` more of them; the penalty is linear but for weights near zero, which end as none.

    ``word`` numbers the features, ``sentence`` the sentences they stand in, ``text`` these sentences'
    documents; ``blank`` counts each document's sentences without a feature, ``toxic`` is its label.
    """
    weights = np.zeros(features + 1)
    weights[-1] = -9.0
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    n = len(toxic)
    penalty = lasso + least / n
    for step in range(1, rounds + 1):
        bias = weights[-1]
        z = np.bincount(sentence, weights[word], len(text)) + bias
        total = np.maximum(np.bincount(text, _softplus(z), n) + blank * _softplus(bias), 1e-12)
        slope = np.where(toxic, -1 / np.expm1(total), 1.0) / n
        dz = slope[text] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word, dz[sentence], features), dz.sum() + (slope * blank).sum() / (1 + np.exp(-bias)))
        grad[:-1] += penalty * np.tanh(weights[:-1] / 0.05)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-10)
    return np.where(np.abs(weights[:-1]) < 0.1, 0.0, weights[:-1]), float(weights[-1])


def _counted(batches):
    """For each feature of a few texts, in how many it stands, and in how many toxic ones."""
    for batch in batches:
        column, toxic = batch.column("text"), batch.column("toxic").to_numpy()
        for first, last in pieces(column):
            raw, ends = text_bytes(column.slice(first, last - first))
            word, sentence, text, _, _ = sentences_of(raw, ends)
            if not len(word):
                continue
            known, number = np.unique(word, return_inverse=True)
            once = np.unique(text[sentence] * len(known) + number)
            stand, own = once % len(known), toxic[first + once // len(known)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(known.view(np.int64)), pa.array(np.bincount(stand, minlength=len(known))),
                 pa.array(np.bincount(stand, own, len(known)).astype(np.int64))], names=["word", "n", "hits"])


def _bagged(known: np.ndarray):
    """Each labelled text's sentences that hold known features, and the number of the others."""

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            for first, last in pieces(column):
                raw, ends = text_bytes(column.slice(first, last - first))
                word, sentence, text, _, _ = sentences_of(raw, ends)
                at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                hit = np.flatnonzero(known[at] == word)
                rows = np.unique(sentence[hit] * np.int64(len(known)) + at[hit])  # a feature counts once in a sentence
                sentence, at = rows // len(known), rows % len(known)
                of = text[sentence] if len(text) else sentence
                bounds = np.searchsorted(of, np.arange(last - first + 1))
                total = np.bincount(text, minlength=last - first)
                held = np.bincount(text[np.unique(sentence)] if len(text) else text, minlength=last - first)
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int64())) for x in (at, sentence)]
                yield pa.RecordBatch.from_arrays(
                    [*lists, pa.array(total - held, pa.int64()), batch.column("toxic").slice(first, last - first)],
                    names=["words", "sentences", "blank", "toxic"])

    return run


def train(labelled: DataFrame, sample: int = SAMPLE, rare: int = RARE, clear: float = CLEAR, most: int = WORDS) -> ToxicityModel:
    """A model from rows ``doc_id, text, toxic`` (0 or 1; other rows are left out).

    With more than ``sample`` rows, those whose hash of doc_id falls below their share train. Without
    rows, or with one label only, every text gets the share of label 1 as its score.
    """
    rows = labelled.where("toxic IN (0, 1)").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if positive in (0, n):
        return ToxicityModel(np.zeros(0, dtype=np.uint64), np.zeros(0), 30.0 if positive else -30.0)
    if n > sample:
        place = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_000))
        rows = rows.where(place < int(1_000_000 * sample / n))
    rows = stored(rows, "toxicity-sample")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = positive / max(n, 1)
    counts = rows.mapInArrow(_counted, "word long, n long, hits long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    more = (F.col("hits") - share * F.col("n")) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
    best = counts.where((F.col("n") >= rare) & (more >= clear)).orderBy(more.desc(), "word").limit(most)
    known = np.sort(np.array([r["word"] for r in best.select("word").collect()], dtype=np.int64).view(np.uint64))
    if not len(known):
        known = np.zeros(1, dtype=np.uint64)
    got = rows.mapInArrow(_bagged(known), "words array<long>, sentences array<long>, blank long, toxic int").toArrow()
    lists = [got.column(c).combine_chunks() for c in ("words", "sentences")]
    word, sentence = (x.flatten().to_numpy() for x in lists)
    text = np.repeat(np.arange(got.num_rows), np.diff(lists[0].offsets.to_numpy()))
    ends, sentence = np.unique(text * np.int64(1 << 40) + sentence, return_inverse=True)
    weights, bias = fit_noisy_or(word, sentence, ends >> 40, got.column("blank").to_numpy(), got.column("toxic").to_numpy() == 1, len(known))
    heavy = weights != 0
    return ToxicityModel(known[heavy], weights[heavy], bias)


_SCORED = "score double, sentences array<struct<begin:int,end:int,score:double>>"


def _scored(model: ToxicityModel, threshold: float, columns: list[str]):
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        known, weights = model.words, model.weights
        maybe = np.zeros(1 << 20, dtype=bool)  # most words have no weight and need no search
        low = np.uint64((1 << 20) - 1)
        maybe[known & low] = True
        for batch in batches:
            column = batch.column("__text")
            for first, last in pieces(column):
                n = last - first
                raw, ends = text_bytes(column.slice(first, n))
                word, sentence, text, begin, end = sentences_of(raw, ends)
                hit = np.flatnonzero(maybe[word & low])
                at = np.minimum(np.searchsorted(known, word[hit]), max(len(known) - 1, 0))
                hit, at = (hit[known[at] == word[hit]], at[known[at] == word[hit]]) if len(known) else (hit[:0], at[:0])
                once = np.unique(sentence[hit] * np.int64(max(len(known), 1)) + at)
                z = np.bincount(once // max(len(known), 1), weights[once % max(len(known), 1)], len(text)) + model.bias
                score = -np.expm1(-np.bincount(text, _softplus(z), n))
                single = 1 / (1 + np.exp(-z))
                where: list[list[dict]] = [[] for _ in range(n)]
                for k in np.flatnonzero(single >= threshold):
                    doc = int(text[k])
                    where[doc].append({"begin": int(begin[k] - ends[doc]), "end": int(end[k] - ends[doc]), "score": float(single[k])})
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, n) for c in columns), pa.array(score), pa.array(where, kind)],
                    names=[*columns, "score", "sentences"])

    return run


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's ``columns`` with ``score`` from 0 to 1 and the ``sentences`` at or above ``threshold``.

    Sentences have begin and end in bytes of the text and a score of their own. Null and empty texts,
    and those without a word, have no sentence and score 0. Rows that repeat a doc_id all come back,
    each with its own score. Further columns are ignored.
    """
    own = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*columns).schema)
    return own.mapInArrow(_scored(model, threshold, list(columns)), f"{kinds}, {_SCORED}")


def held_out():
    """The fold whose labels train nothing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from the documents with a label outside the held-out fold."""
    marks = labels.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return train(docs.select("doc_id", "text").join(marks, "doc_id"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = train_on(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
