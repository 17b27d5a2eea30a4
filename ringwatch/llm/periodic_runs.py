"""Periodic runs of words, found with a suffix automaton and the access operation of link-cut trees.

A run is a stretch of words with smallest period q (words q apart are equal) that no neighbouring
word extends. Found are all runs that reach both a length and a number of periods.

Of a text's suffix automaton, every state stands for strings that end at the same places; its links
form a tree, and the path from the state of a prefix to the root holds all suffixes of the prefix.
Each state is coloured by the last place where its strings ended. Appending a word recolours the
path of the new prefix. As in a link-cut tree's ``access``, the path is gathered into one splay tree
from segments of one colour each, of which there are logarithmically many on average. Where a segment
ends at the earlier place j and its longest string has L words, the L words up to i stand d = i - j
places before as well, and nowhere nearer. With d <= L that is a square of period d which begins at
j - L + 1, and L + d words of it are seen; the rest of the run lies to the right and is compared word
by word. d is the smallest period of that stretch, since a smaller one would give a later j, and the
start is the run's own, since a longer string of the same places would lengthen L.

Words can lie in a wanted run only where they are part of a sequence of words that recurs within the
text: a run of at least ``least`` words and ``periods`` >= 2 periods has every sequence of
``least // 3`` words again one period on. Only the stretches that such sequences cover get an
automaton. Nothing is lost by it: a run lies in one stretch as a whole, with the words that end it.
Memory is about 1 kB for each word of a text's longest such stretch, and a few dozen bytes for each
word of the text.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.llm.base import table

#: Words of a run at least.
LEAST = 24
#: Periods that a run holds at least.
PERIODS = 3
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton of a list of words: longest string and link of each state, and the states of the prefixes.

    State 1 is the empty string's, 0 stands for none.
    """
    steps: list[dict] = [{}, {}]
    size, link, prefix = [0, 0], [0, 0], []
    last = 1
    for w in word:
        new = len(size)
        size.append(size[last] + 1)
        link.append(1)
        steps.append({})
        prefix.append(new)
        p = last
        while p and w not in steps[p]:
            steps[p][w] = new
            p = link[p]
        if p:
            q = steps[p][w]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(size)
                size.append(size[p] + 1)
                link.append(link[q])
                steps.append(dict(steps[q]))
                while p and steps[p].get(w) == q:
                    steps[p][w] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return size, link, prefix


class Paths:
    """Paths of a tree that are coloured as a whole, each kept in a splay tree by depth.

    ``up`` is the parent in the splay tree or, for its root, the parent of the path's upper end.
    """

    def __init__(self, parent: list[int]):
        n = len(parent)
        self.up, self.left, self.right = list(parent), [0] * n, [0] * n
        self.colour, self.given = [-1] * n, [False] * n

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[z] == y:
            left[z] = x
        elif right[z] == y:
            right[z] = x
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b:
            up[b] = y
        up[y], up[x] = x, z

    def _splay(self, x: int) -> None:
        """Make x the root of its splay tree; colours given to whole trees go down on the way."""
        up, left, right, colour, given = self.up, self.left, self.right, self.colour, self.given
        chain, y = [x], x
        z = up[y]
        while z and (left[z] == y or right[z] == y):
            chain.append(z)
            y, z = z, up[z]
        for y in reversed(chain):
            if given[y]:
                c, given[y] = colour[y], False
                for child in (left[y], right[y]):
                    if child:
                        colour[child], given[child] = c, True
        y = up[x]
        while y and (left[y] == x or right[y] == x):
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                self._rotate(y if (left[y] == x) == (left[z] == y) else x)
            self._rotate(x)
            y = up[x]

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Colour the path from x to the root; the lowest node and former colour of its segments, lowest first."""
        old, below = [], 0
        up, right = self.up, self.right
        while x:
            self._splay(x)
            if self.colour[x] >= 0:
                old.append((x, self.colour[x]))
            right[x] = below  # what lies lower keeps its colour and becomes a path of its own
            below = x
            x = up[x]
        self.colour[below], self.given[below] = colour, True
        return old


def _extended(word: np.ndarray, end: int, period: int) -> int:
    """First place from ``end`` on whose word differs from that ``period`` before."""
    block = 64
    while end < len(word):
        last = min(len(word), end + block)
        same = word[end:last] == word[end - period : last - period]
        if not same.all():
            return end + int(np.argmin(same))
        end, block = last, block * 2
    return end


def runs_of(word: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """Start, length and period of the runs of ``least`` words and ``periods`` periods or more, by start and period."""
    size, link, prefix = automaton(word.tolist())
    paths = Paths(link)
    found: dict[tuple[int, int], int] = {}
    for i, state in enumerate(prefix):
        for node, j in paths.access(state, i):
            d, length = i - j, size[node]
            if length >= (periods - 1) * d and length + d >= least:
                start = j - length + 1
                if (start, d) not in found:
                    found[start, d] = _extended(word, i + 1, d) - start
    return sorted((start, length, d) for (start, d), length in found.items())


def recurring(word: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Stretches (first, last + 1) covered by sequences of ``n`` words that stand more than once."""
    if len(word) <= n:
        return []
    # numbers of sequences of 1, 2, 4 ... words, from those of half the length; then of n
    rank, have = word.astype(np.int64), 1
    while have < n:
        step = min(have, n - have)
        rank = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        _, rank, count = np.unique(rank, return_inverse=True, return_counts=True)
        have += step
        if len(count) == len(rank):
            return []
    if have == 1:
        _, rank, count = np.unique(rank, return_inverse=True, return_counts=True)
    cover = np.zeros(len(word) + 1, dtype=np.int64)
    at = np.flatnonzero(count[rank] > 1)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of bytes other than space and 0x09 to 0x0D."""
    return (text or "").encode().split()


def text_runs(words: list[bytes], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """Runs of a list of words, see :func:`runs_of`."""
    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    word = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    out = []
    for first, last in recurring(word, max(1, least // 3)):
        if last - first >= least:
            out += [(first + start, length, period) for start, length, period in runs_of(word[first:last], least, periods)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words outside the runs and those of each run's first period, joined by blanks."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0) if runs else range(len(words))
    return (b" ".join(words) if not runs else b" ".join([words[k] for k in kept])).decode()


def strongest(runs: list[tuple[int, int, int]]) -> dict | None:
    """The run with most periods; of equal ones the first, then that of the smaller period."""
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return None if best is None else dict(zip(("start", "length", "period"), best))


def _found(columns: list[str], least: int, periods: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("__text")
            first = 0
            while first < len(batch):  # results hold whole texts; hand them on before they pile up
                last, size, rows = first, 0, []
                while last < len(batch) and size < 4_000_000:
                    words = words_of(texts[last].as_py())
                    runs = text_runs(words, least, periods)
                    rest = collapsed(words, runs)
                    rows.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], strongest(runs), rest))
                    size += len(rest)
                    last += 1
                n, runs, best, rest = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, last - first) for c in columns), pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)),
                     pa.array(best, _RUN), pa.array(rest, pa.string())],
                    names=[*columns, "n_words", "runs", "strongest", "collapsed"])
                first = last

    return run


def periodic_runs(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """Each row's ``columns`` with ``n_words``, ``runs``, the ``strongest`` of them and the ``collapsed`` text.

    ``runs`` are structs of ``start`` (a word's number), ``length`` and ``period``, ordered by start and
    period. ``collapsed`` keeps of every run its first period, its words joined by single blanks. Null
    texts are taken as empty: no words, no runs, an empty text. Rows that repeat a doc_id, or have none,
    all come back, each by its own text. Further columns are ignored, whatever their names.
    """
    if least < 1 or periods < 2:
        raise ValueError("least must be positive and periods at least 2")
    own = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*columns).schema)
    run = "struct<start:bigint,length:bigint,period:bigint>"
    return own.mapInArrow(_found(list(columns), least, periods), f"{kinds}, n_words long, runs {_RUNS}, strongest {run}, collapsed string")


def _as_asked(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten (by its id's checksum) repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.coalesce(F.col("h") % 10 == 0, F.lit(False)), words)
    rows = rows.select("*", words.alias("words")).select("*", F.size("words").alias("n"))
    rows = rows.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a"))
    rows = rows.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    again = F.transform(
        "words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, of which one in ten is made periodic."""
    found = periodic_runs(_as_asked(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
