"""Exact medians of window cells from counts in bins, refined around the wanted ranks.

A point of a ring lies in up to ``size / stride`` windows, at as many positions, and every (stratum,
feature, position) wants its median. Instead of copying points to their positions and shuffling them,
tasks count their own cells in bins with sketched bounds; a few counts per bin and task are added up.
The counts say which bin holds a wanted rank and how many cells lie below it. A second pass over the
points hands on only the values of these bins, and the exact quantiles of these few values, with the
counts below and above them as weights, are those of all cells. Bounds only balance the bins.

Everything held by the driver or a task is bounded by strata x features x positions x bins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringwatch.catalog import ModelConfig
from ringwatch.operators.quantiles import exact_percentiles

BINS = 256
#: Strata whose tables are held at a time.
MOST_STRATA = 100
KEYS = ["stratum", "feature", "pos"]
_COUNTED = "stratum string, feature string, pos int, bin int, many bigint"
_VALUES = "stratum string, feature string, pos int, value double, many bigint"


def _cells(batch: pa.RecordBatch, features: list[str], config: ModelConfig):
    """(stratum, feature, position, value) arrays of the measured cells of a batch's points, window by window."""
    size, stride = config.window_points, config.window_stride
    idx, n = (batch.column(c).to_numpy() for c in ("idx", "n"))
    strata = np.array(batch.column("stratum").to_pylist(), dtype=object)
    values = {f: (batch.column(f"{f}_s").to_numpy(zero_copy_only=False), batch.column(f"{f}_ok").to_numpy(zero_copy_only=False)) for f in features}
    for stratum in sorted({s for s in strata if s is not None}):
        # each point is looked at for its own stratum only
        own = np.flatnonzero(strata == stratum)
        at, last = idx[own], n[own] - size
        of_own = {f: (value[own], ok[own]) for f, (value, ok) in values.items()}
        for j in range(-(-size // stride)):
            start = (at // stride - j) * stride
            pos = at - start
            inside = (start >= 0) & (start <= last) & (pos < size)
            for f in features:
                value, ok = of_own[f]
                hit = inside & ok
                if hit.any():
                    yield stratum, f, pos[hit], value[hit].astype(np.float64)


def _measure(bounds: dict, middle: dict | None, stratum: str, feature: str, pos: np.ndarray, value: np.ndarray):
    """What is ranked, the value or its distance from the median of its position, and its bin."""
    if middle is not None:
        value = np.abs(value - middle[stratum, feature][pos])
    return value, np.searchsorted(bounds[stratum, feature], value, side="left")


def _counts(features: list[str], config: ModelConfig, bounds: dict, middle: dict | None):
    size = config.window_points

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for stratum, f, pos, value in _cells(batch, features, config):
                _, place = _measure(bounds, middle, stratum, f, pos, value)
                many = np.bincount(pos * BINS + place, minlength=size * BINS)
                total[stratum, f] = total[stratum, f] + many if (stratum, f) in total else many
        for (stratum, f), many in total.items():
            at = np.flatnonzero(many)
            yield pa.RecordBatch.from_arrays(
                [pa.array([stratum] * len(at)), pa.array([f] * len(at)), pa.array(at // BINS, pa.int32()), pa.array(at % BINS, pa.int32()), pa.array(many[at])],
                names=["stratum", "feature", "pos", "bin", "many"])

    return run


def _survivors(features: list[str], config: ModelConfig, bounds: dict, middle: dict | None, wanted: dict):
    def run(batches):
        for batch in batches:
            for stratum, f, pos, value in _cells(batch, features, config):
                value, place = _measure(bounds, middle, stratum, f, pos, value)
                first, last = wanted[stratum, f]
                hit = (place >= first[pos]) & (place <= last[pos])
                pos, value = pos[hit], value[hit]
                order = np.lexsort((value, pos))
                pos, value = pos[order], value[order]
                new = np.flatnonzero(np.append(True, (pos[1:] != pos[:-1]) | (value[1:] != value[:-1]))) if len(pos) else np.zeros(0, dtype=int)
                if len(new):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([stratum] * len(new)), pa.array([f] * len(new)), pa.array(pos[new], pa.int32()), pa.array(value[new]),
                         pa.array(np.diff(np.append(new, len(pos))))], names=["stratum", "feature", "pos", "value", "many"])

    return run


def _median(points: DataFrame, features: list[str], config: ModelConfig, bounds: dict, middle: dict | None) -> DataFrame:
    """``stratum, feature, pos, median`` of the cells, or of their distances from ``middle``."""
    counted = points.mapInArrow(_counts(features, config, bounds, middle), _COUNTED).groupBy(*KEYS, "bin").agg(F.sum("many").alias("many"))
    order = Window.partitionBy(*KEYS).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumns({"end": F.sum("many").over(order), "total": F.sum("many").over(Window.partitionBy(*KEYS))})
    holds = lambda rank: F.when((F.col("end") - F.col("many") <= rank) & (rank < F.col("end")), F.col("bin"))
    low = F.floor((F.col("total") - 1) / 2)
    high = F.least(low + 1, F.col("total") - 1)
    rows = counted.groupBy(*KEYS).agg(F.max(holds(low)).alias("first"), F.max(holds(high)).alias("last"), F.first("total").alias("total"),
                                      F.max(F.when(low < F.col("end"), None).otherwise(F.col("end"))).alias("below"),
                                      F.min(F.when(high < F.col("end"), F.col("end"))).alias("upto")).collect()
    wanted: dict[tuple, tuple] = {}
    rest = []
    for r in rows:
        first, last = wanted.setdefault((r["stratum"], r["feature"]), (np.full(config.window_points, BINS), np.full(config.window_points, -1)))
        first[r["pos"]], last[r["pos"]] = r["first"], r["last"]
        key = (r["stratum"], r["feature"], r["pos"])
        rest += [(*key, float("-inf"), r["below"] or 0), (*key, float("inf"), r["total"] - r["upto"])]
    near = points.mapInArrow(_survivors(features, config, bounds, middle, wanted), _VALUES)
    beside = points.sparkSession.createDataFrame(rest, _VALUES).filter("many > 0")
    return exact_percentiles(near.unionByName(beside), KEYS, "value", {"median": 0.5}, "many").drop("n")


def _sketch(points: DataFrame, features: list[str], value) -> dict[tuple, np.ndarray]:
    """Bounds of the bins of each stratum and feature."""
    grid = [k / BINS for k in range(1, BINS)]
    rows = points.groupBy("stratum").agg(
        *[F.percentile_approx(F.when(F.col(f"{f}_ok"), value(f)), grid, 10000).alias(f) for f in features]).filter("stratum IS NOT NULL").collect()
    return {(r["stratum"], f): np.array(r[f] or [], dtype=np.float64) for r in rows for f in features}


def cell_medians(points: DataFrame, features: list[str], config: ModelConfig = ModelConfig()) -> tuple[DataFrame, DataFrame]:
    """Median of the measured cells of all full windows, and of their distances from it.

    ``points``: stratum, idx (position in the ring), n (points of the ring) and, per feature, ``<f>_s`` and
    ``<f>_ok``; read six times, so it should be a written table. Both results have stratum, feature, pos and
    ``median``, and no rows for positions without cells. Rows without a stratum are left out.
    """
    points = points.filter(F.col("n") >= config.window_points)
    strata = points.select("stratum").distinct().limit(MOST_STRATA + 1).count()
    if strata > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata")
    bounds = _sketch(points, features, lambda f: F.col(f"{f}_s"))
    medians = _median(points, features, config, bounds, None)
    rows = medians.collect()  # a few thousand at most
    middle: dict[tuple, np.ndarray] = {}
    for r in rows:
        middle.setdefault((r["stratum"], r["feature"]), np.zeros(config.window_points))[r["pos"]] = r["median"]
    medians = points.sparkSession.createDataFrame(rows, medians.schema)
    # the median at one position is close to the others'; it only places the bounds
    centre = {f: F.create_map(*[x for (s, g), m in middle.items() if g == f for x in (F.lit(s), F.lit(float(m[len(m) // 2])))]) for f in features
              if any(g == f for _, g in middle)}
    off = lambda f: F.abs(F.col(f"{f}_s") - centre[f][F.col("stratum")]) if f in centre else F.lit(None).cast("double")
    bounds = _sketch(points, features, off)
    return medians, _median(points, features, config, bounds, middle)
