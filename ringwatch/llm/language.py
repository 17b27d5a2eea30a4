"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``WIDTH`` signs, drawn from a hash of its code point, so that
all workers have the same ones without exchanging them. The vector of three letters in a row is
the product of the first letter's vector rotated twice, the second's rotated once and the third's
(rotation marks the place, the product binds). A text's vector is the sum over its three-letter
sequences; a language's prototype is the sum over all texts of the language. A text gets the
language whose prototype has the largest cosine with its vector.

Letters are lower-cased; whatever is no letter counts as one blank, also before and after a text.
Texts are read in pieces whose sequences overlap, so that memory does not grow with their length.
All sums are of whole numbers, so that prototypes do not depend on how rows are dealt. Training
covers all documents of the learning folds: tasks add up their own texts' sequences by language
before Spark adds up one row per task, language and component.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.llm.base import table
from ringwatch.llm.shingles import mix64

WIDTH = 1024
#: Languages whose prototypes are kept, the ones with most texts; prototypes travel with the tasks.
LANGUAGES = 4000
#: Letters of which a worker remembers the vectors.
KNOWN = 4096
#: Characters read at a time.
PIECE = 1 << 18
UNKNOWN = "und"
_BLANK = 32


class Letters:
    """Vectors of letters, with those rotated once and twice; remembered for up to ``known`` letters."""

    def __init__(self, width: int = WIDTH, known: int = KNOWN):
        self.width, self.known = width, known
        self.place = np.full(0x110000, -1, dtype=np.int32)
        self.kind = np.zeros(0x110000, dtype=np.int8)  # 1 letter, -1 none, 0 not looked up yet
        self.rows = np.zeros((3, 0, width), dtype=np.int8)

    def is_letter(self, code: np.ndarray) -> np.ndarray:
        kind = self.kind[code]
        if not kind.all():
            new = np.unique(code[kind == 0])
            self.kind[new] = [1 if chr(c).isalpha() else -1 for c in new.tolist()]
            kind = self.kind[code]
        return kind > 0

    def places(self, letters: np.ndarray) -> np.ndarray:
        """Row of each of the given distinct letters, at most ``known`` at a time."""
        new = letters[self.place[letters] < 0]
        if len(new):
            if self.rows.shape[1] + len(new) > self.known:  # forget all
                self.place[:] = -1
                self.rows, new = self.rows[:, :0], letters
            bits = np.arange(self.width // 64, dtype=np.uint64) + np.uint64(1)
            words = mix64(mix64(new.astype(np.uint64))[:, None] + bits[None, :] * np.uint64(0x9E3779B97F4A7C15))
            signs = (np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * 2 - 1).reshape(len(new), self.width)
            self.place[new] = self.rows.shape[1] + np.arange(len(new))
            self.rows = np.concatenate((self.rows, np.stack([np.roll(signs, k, axis=1) for k in range(3)])), axis=1)
        return self.place[letters]

    def bundle(self, triples: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the vectors of three letters (rows of code points), each ``counts`` times."""
        total = np.zeros(self.width, dtype=np.int64)
        for at in range(0, len(triples), 1024):  # 3072 letters at most, fewer than are remembered
            some = triples[at : at + 1024]
            letters, which = np.unique(some, return_inverse=True)
            a, b, c = self.places(letters)[which.reshape(some.shape)].T
            bound = (self.rows[2, a] * self.rows[1, b] * self.rows[0, c]).astype(np.float32)
            weight = counts[at : at + 1024]
            exact = bool(weight.sum() < 2**24)  # of whole numbers that single precision holds
            total += np.rint(weight.astype(np.float32) @ bound if exact else weight.astype(np.float64) @ bound).astype(np.int64)
        return total


def sequences(text: str, letters: Letters, piece: int = PIECE):
    """Distinct three-letter sequences and their counts, for each piece of a text in turn.

    Nothing for texts without a letter. Sequences that hold no letter don't occur.
    """
    last = np.array([_BLANK], dtype=np.int64)
    for at in range(0, len(text), piece):
        code = np.frombuffer(text[at : at + piece].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        code = np.where(letters.is_letter(code), code, _BLANK)
        whole = np.concatenate((last, code, [_BLANK] if at + piece >= len(text) else []))
        whole = whole[np.append(True, (whole[1:] != _BLANK) | (whole[:-1] != _BLANK))].astype(np.int64)  # one blank
        last = whole[-2:]
        if len(whole) < 3:
            continue
        alphabet, which = np.unique(whole, return_inverse=True)
        size = len(alphabet)
        keys = (which[:-2] * size + which[1:-1]) * size + which[2:]
        found, count = np.unique(keys, return_counts=True)
        yield alphabet[np.stack((found // (size * size), found // size % size, found % size), axis=1)], count


def text_vector(text: str | None, letters: Letters) -> np.ndarray | None:
    """Sum of the vectors of a text's three-letter sequences; None without a letter."""
    total = None
    for triples, counts in sequences(text or "", letters):
        total = letters.bundle(triples, counts) + (0 if total is None else total)
    return total


def _profiles(width: int):
    """Sums over a task's texts by language: rows of language, number of texts, components."""

    def run(batches):
        letters, totals = Letters(width), {}

        def rows():
            for lang, (n, total) in totals.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (width + 1)), pa.array(np.arange(width + 1), pa.int32()), pa.array(np.append(total, n))],
                    names=["lang", "at", "total"])

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                vector = text_vector(text.as_py(), letters)
                if vector is not None:
                    n, total = totals.get(lang.as_py(), (0, 0))
                    totals[lang.as_py()] = n + 1, total + vector
            if len(totals) > 256:  # bounded, however many languages there are
                yield from rows()
                totals.clear()
        yield from rows()

    return run


@dataclass(frozen=True)
class Profiles:
    """Languages in order, and their prototypes scaled to length one."""

    languages: list[str]
    prototypes: np.ndarray


def train(docs: DataFrame, width: int = WIDTH, languages: int = LANGUAGES) -> Profiles:
    """Prototypes from the ``text`` and ``lang`` of all rows.

    Rows without a language or without a letter teach nothing. The ``languages`` with most texts
    (equally many: by name) are kept, so that what the driver and the tasks hold is bounded.
    """
    own = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = own.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).mapInArrow(_profiles(width), "lang string, at int, total long")
    cells = sums.groupBy("lang", "at").agg(F.sum("total").alias("total"))
    by_lang = cells.groupBy("lang").agg(
        F.max(F.when(F.col("at") == width, F.col("total"))).alias("texts"),
        F.sort_array(F.collect_list(F.struct("at", "total"))).getField("total").alias("cells"))
    rows = sorted(by_lang.orderBy(F.desc("texts"), "lang").limit(languages).collect(), key=lambda r: r["lang"])
    sums_ = np.array([r["cells"][:width] for r in rows], dtype=np.float64).reshape(len(rows), width)
    size = np.linalg.norm(sums_, axis=1, keepdims=True)
    return Profiles([r["lang"] for r in rows], sums_ / np.where(size > 0, size, 1))


def _told(model: Profiles, columns: list[str]):
    def run(batches):
        letters = Letters(model.prototypes.shape[1])
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("__text"):
                vector = text_vector(text.as_py(), letters) if model.languages else None
                if vector is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosine = model.prototypes @ vector / max(float(np.linalg.norm(vector)), 1.0)
                best = int(np.argmax(cosine))
                langs.append(model.languages[best])
                scores.append(min(max(float(cosine[best]), 0.0), 1.0))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*columns, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Profiles, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's ``columns`` with ``lang_pred`` and ``score``, the cosine held to 0 and 1.

    Texts that are null or have no letter, and all texts where no language was learned, get ``und`` and
    0. Equal cosines give the first language by name. Rows that repeat a doc_id all come back, each by
    its own text; further columns are ignored.
    """
    own = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*columns).schema)
    return own.mapInArrow(_told(model, list(columns)), f"{kinds}, lang_pred string, score double")


def held_out():
    """The fold whose languages teach nothing; rows without a doc_id belong to no fold and teach."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
