"""Sums of Gaussian kernels over any number of scores, from bins and their moments.

The distribution of a kernel estimate at x is the mean of Phi((x - s) / h) over all scores s. Around
a few anchors the scores are put into bins of half a kernel width. A bin keeps its count and the sums
of the first powers of (s - c) / h about its centre c; the Taylor series of Phi about (x - c) / h then
gives the bin's share of the sum at every x near an anchor. With |s - c| <= h / 4 the terms left out
are below 1e-16 of a score each. Scores away from all anchors count as wholly below or above.

A table has at most ``ANCHORS`` x ``2 * (REACH + TAIL) / STEP`` bins a key, whatever the number and
spread of the scores, so one pass answers any number of candidates within ``REACH`` widths of an anchor.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a bin, in kernel widths.
STEP = 0.5
#: Powers kept besides the count.
POWERS = 16
#: Widths from an anchor within which candidates can be asked for.
REACH = 64
#: Widths beyond which a kernel's tail is below 1e-18.
TAIL = 9
ANCHORS = 5
_FACTORIAL = np.array([math.factorial(k) for k in range(POWERS + 1)], dtype=np.float64)


@dataclass
class KernelTable:
    """Bins of one key: centres, moments (count first), and the counts between the ranges of bins."""

    width: float
    ranges: list[tuple[int, int]]
    centre: np.ndarray
    moment: np.ndarray
    beside: list[float]  # scores that lie above so many ranges and in none

    @property
    def size(self) -> float:
        return float(self.moment[:, 0].sum()) + sum(self.beside)

    def _range_of(self, x: float) -> int | None:
        half = STEP * self.width
        for i, (lo, hi) in enumerate(self.ranges):
            if lo * half + TAIL * self.width <= x <= (hi + 1) * half - TAIL * self.width:
                return i
        return None

    def at(self, x: float) -> tuple[float, float] | None:
        """Distribution and density at x; None if x is too far from every anchor."""
        place = self._range_of(x)
        if place is None:
            return None
        u = (x - self.centre) / self.width
        below = u > 2 * TAIL  # other ranges and far bins count whole
        near = np.abs(u) <= 2 * TAIL
        u, moment = u[near], self.moment[near] / _FACTORIAL
        phi = np.exp(-0.5 * u * u) / math.sqrt(2 * math.pi)
        hermite = np.empty((len(u), POWERS + 1))  # He_k(u)
        hermite[:, 0] = 1
        hermite[:, 1] = u
        for k in range(2, POWERS + 1):
            hermite[:, k] = u * hermite[:, k - 1] - (k - 1) * hermite[:, k - 2]
        whole = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in u.tolist()])
        total = (moment[:, 0] * whole).sum() - (phi * (moment[:, 1:] * hermite[:, :-1]).sum(axis=1)).sum()
        total += self.moment[below, 0].sum() + sum(self.beside[: place + 1])
        density = (phi * (moment * hermite).sum(axis=1)).sum() / self.width
        return float(total) / self.size, float(density) / self.size


def ranges_around(anchors: list[float], width: float) -> list[tuple[int, int]]:
    """Ranges of bins around the anchors, in order; overlapping ones are joined."""
    out: list[list[int]] = []
    for a in sorted(anchors):
        lo = math.floor((a - (REACH + TAIL) * width) / (STEP * width))
        hi = math.floor((a + (REACH + TAIL) * width) / (STEP * width))
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def kernel_tables(scores: DataFrame, keys: list[str], score: str, asked: dict[tuple, tuple[float, list[float]]]) -> dict[tuple, KernelTable]:
    """Tables of the asked keys, ``{key: (width, anchors)}``, from one pass over the finite ``scores``.

    ``asked`` is held by the driver and travels with the tasks: its keys must be few.
    """
    spark = scores.sparkSession
    ranges = {key: ranges_around(anchors, width) for key, (width, anchors) in asked.items()}
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scores.select(*keys).schema)
    most = max(map(len, ranges.values()))
    filled = lambda rs: [x for k in range(most) for x in (rs[k] if k < len(rs) else (None, None))]
    bounds = ", ".join(f"_l{k} bigint, _h{k} bigint" for k in range(most))
    rows = [(*key, width, *filled(ranges[key])) for key, (width, _) in asked.items()]
    joined = scores.select(*keys, F.col(score).alias("_s")).join(F.broadcast(spark.createDataFrame(rows, f"{ddl}, _w double, {bounds}")), keys)
    first = F.least(*[F.col(f"_l{k}") for k in range(most)]) if most > 1 else F.col("_l0")
    last = F.greatest(*[F.col(f"_h{k}") for k in range(most)]) if most > 1 else F.col("_h0")
    half = F.lit(STEP) * F.col("_w")
    held = F.greatest(F.least(F.col("_s"), (last + 2).cast("double") * half), (first - 1).cast("double") * half)
    binned = joined.withColumn("_b", F.floor(held / half)).withColumn("_c", (F.col("_b").cast("double") + 0.5) * half)
    inside: Column = F.lit(False)
    above: Column = F.lit(0)
    for k in range(most):
        inside = inside | F.coalesce(F.col("_b").between(F.col(f"_l{k}"), F.col(f"_h{k}")), F.lit(False))
        above = above + F.when(F.col("_b") > F.col(f"_h{k}"), 1).otherwise(0)
    binned = binned.withColumns({"_in": inside, "_above": above, "_t1": (F.col("_s") - F.col("_c")) / F.col("_w")})
    for k in range(2, POWERS + 1):  # each power from the one before
        binned = binned.withColumn(f"_t{k}", F.col(f"_t{k - 1}") * F.col("_t1"))
    where = [*keys, F.when(F.col("_in"), F.col("_b")).alias("bin"), F.when(~F.col("_in"), F.col("_above")).alias("above")]
    sums = [F.sum(F.when(F.col("_in"), F.col(f"_t{k}"))).alias(f"m{k}") for k in range(1, POWERS + 1)]
    found: dict[tuple, list] = {}
    for r in binned.groupBy(*where).agg(F.count(F.lit(1)).cast("double").alias("m0"), *sums).collect():
        found.setdefault(tuple(r[k] for k in keys), []).append(r)
    out = {}
    for key, (width, _) in asked.items():
        cells = sorted((r for r in found.get(key, []) if r["bin"] is not None), key=lambda r: r["bin"])
        beside = [0.0] * (len(ranges[key]) + 1)
        for r in found.get(key, []):
            if r["bin"] is None:
                beside[r["above"]] += r["m0"]
        moment = np.array([[r[f"m{k}"] for k in range(POWERS + 1)] for r in cells], dtype=np.float64).reshape(len(cells), POWERS + 1)
        centre = np.array([(r["bin"] + 0.5) * (STEP * width) for r in cells], dtype=np.float64)
        out[key] = KernelTable(width, ranges[key], centre, moment, beside)
    return out
