"""Isolation forest over sequence vectors (Liu, Ting and Zhou, 2008), one forest per stratum.

Each tree grows from its own bounded sample in its own task; a forest is therefore of a
fixed greatest size (trees times twice the sample size), whatever the data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch.catalog import ModelConfig
from ringwatch.operators.quantiles import exact_percentiles

#: Cells that a tree draws.
CELLS = 32
MOST_STRATA = 100
TREE_SCHEMA = (
    "stratum string, tree int, sample_size int, feature array<int>, threshold array<double>, "
    "left array<int>, right array<int>, path array<double>"
)


def mean_path(n):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m, out)


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> dict:
    """Grow one tree level by level: random varying feature, uniform cut between its extremes."""
    n = len(x)
    depth_limit = math.ceil(math.log2(max(n, 2)))
    feature, threshold, left, right, path = [-1], [0.0], [-1], [-1], [0.0]
    frontier = [(0, np.arange(n))]
    for depth in range(depth_limit + 1):
        following = []
        for node, rows in frontier:
            part = x[rows]
            low, high = part.min(axis=0), part.max(axis=0)
            varying = np.flatnonzero(high > low)
            if depth == depth_limit or len(rows) <= 1 or len(varying) == 0:
                path[node] = depth + float(mean_path(len(rows)))
                continue
            f = int(rng.choice(varying))
            # rounding may reach the upper end, which would leave the right side empty
            cut = float(min(rng.uniform(low[f], high[f]), np.nextafter(high[f], low[f])))
            goes_left = part[:, f] <= cut
            feature[node], threshold[node] = f, cut
            for side, chosen in ((left, goes_left), (right, ~goes_left)):
                side[node] = len(feature)
                feature.append(-1)
                threshold.append(0.0)
                left.append(-1)
                right.append(-1)
                path.append(0.0)
                following.append((side[node], rows[chosen]))
        frontier = following
    return {"feature": feature, "threshold": threshold, "left": left, "right": right, "path": path}


def fit_forest(rows: DataFrame, id_cols: list[str], config: ModelConfig = ModelConfig()) -> DataFrame:
    """Trees per stratum from ``(stratum, id columns, vec)``.

    ``samples_per_tree`` is the subsampling of the algorithm itself; trees draw from all rows.

    Rows fall into cells by a hash of their ids, so many that ``CELLS`` cells hold slightly more than the
    wanted sample. A tree draws its cells and keeps the rows of smallest tickets from them. A row costs one
    hash and one look-up, however many trees there are; only drawn rows move.
    """
    wanted, seed = config.samples_per_tree, config.seed
    spark = rows.sparkSession
    sizes = rows.filter("stratum IS NOT NULL").groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).limit(MOST_STRATA + 1).collect()
    if len(sizes) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata")
    drawn_cells = []
    for r in sorted(sizes, key=lambda r: r["stratum"]):
        want = min(r["n"], wanted)
        cells = max(CELLS, int(CELLS * r["n"] / (want + 8 * math.sqrt(want) + 16)))
        for tree in range(config.trees):
            rng = np.random.default_rng([seed, 1, tree, *r["stratum"].encode()])
            drawn_cells += [(r["stratum"], cells, int(c), tree) for c in rng.choice(cells, CELLS, replace=False)]
    plan = spark.createDataFrame(drawn_cells, "stratum string, cells bigint, cell bigint, tree int")
    many = plan.select("stratum", "cells").distinct()
    trees = plan.groupBy("stratum", "cell").agg(F.collect_list("tree").alias("trees"))
    others = [c for c in id_cols if c != "stratum"]
    # both sides of a fixed size: one row per stratum, and strata x trees x cells of a tree
    placed = rows.join(F.broadcast(many), "stratum").select(
        "stratum", "vec", *others, F.pmod(F.xxhash64(*[F.col(c) for c in id_cols], F.lit(seed)), F.col("cells")).alias("cell"))
    drawn = placed.join(F.broadcast(trees), ["stratum", "cell"]).select("stratum", "vec", *others, F.explode("trees").alias("tree"))
    ticket = F.xxhash64(*[F.col(c) for c in id_cols], "tree", F.lit(seed + 1))
    drawn = drawn.select("stratum", "tree", "vec", ticket.alias("ticket"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ticket", kind="stable").head(wanted)
        tree = int(pdf["tree"].iloc[0])
        stratum = pdf["stratum"].iloc[0]
        rng = np.random.default_rng([seed, tree, *stratum.encode()])
        grown = grow_tree(np.stack(pdf["vec"].to_numpy()), rng)
        return pd.DataFrame([{"stratum": stratum, "tree": tree, "sample_size": len(pdf), **grown}])

    return drawn.groupBy("stratum", "tree").applyInPandas(grow, TREE_SCHEMA)


def pack_forest(trees: DataFrame, config: ModelConfig = ModelConfig()) -> dict:
    """Forests as padded arrays per stratum, for use inside tasks.

    Size bound: strata x trees x (2 * sample - 1) nodes; checked.
    """
    table = trees.toPandas()
    limit = 2 * config.samples_per_tree
    forests = {}
    for stratum, part in table.groupby("stratum"):
        part = part.sort_values("tree")
        width = int(part["feature"].map(len).max())
        if len(part) > config.trees or width > limit:
            raise ValueError("forest larger than its configured bound")

        def pad(name: str, fill, dtype, part=part, width=width):
            out = np.full((len(part), width), fill, dtype=dtype)
            for i, values in enumerate(part[name]):
                out[i, : len(values)] = values
            return out

        forests[stratum] = {
            "feature": pad("feature", -1, np.int32),
            "threshold": pad("threshold", 0.0, np.float64),
            "left": pad("left", 0, np.int32),
            "right": pad("right", 0, np.int32),
            "path": pad("path", 0.0, np.float64),
            "norm": float(mean_path(int(part["sample_size"].iloc[0]))),
        }
    return forests


def raw_scores(forest: dict, x: np.ndarray) -> np.ndarray:
    """Anomaly score in (0, 1] of each row: 2 ** (-mean path / expected path)."""
    feature = forest["feature"]
    trees = np.arange(len(feature))[:, None]
    at = np.zeros((len(feature), len(x)), dtype=np.int32)
    rows = np.arange(len(x))[None, :]
    while True:
        f = feature[trees, at]
        inner = f >= 0
        if not inner.any():
            break
        below = x[rows, np.maximum(f, 0)] <= forest["threshold"][trees, at]
        step = np.where(below, forest["left"][trees, at], forest["right"][trees, at])
        at = np.where(inner, step, at)
    mean = forest["path"][trees, at].mean(axis=0)
    return 2.0 ** (-mean / forest["norm"]) if forest["norm"] > 0 else np.full(len(x), 0.5)


def score_forest(rows: DataFrame, forests: dict) -> DataFrame:
    """Add ``if_raw`` to rows with ``stratum`` and ``vec``; NULL where no forest exists."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)
    schema = rows.drop("vec").schema.add("if_raw", "double")

    def score(batches):
        for pdf in batches:
            out = np.full(len(pdf), np.nan)
            strata = pdf["stratum"].to_numpy()
            for stratum in set(strata):
                if stratum in shared.value:
                    hit = np.flatnonzero(strata == stratum)
                    out[hit] = raw_scores(shared.value[stratum], np.stack(pdf["vec"].to_numpy()[hit]))
            yield pdf.drop(columns="vec").assign(if_raw=out)

    scored = rows.mapInPandas(score, schema)
    return scored.withColumn("if_raw", F.nanvl("if_raw", F.lit(None).cast("double")))


def anomaly_offset(fit_scores: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """Score above which the configured share of the fit rows lies, per stratum."""
    return exact_percentiles(fit_scores, ["stratum"], "if_raw", {"if_offset": 1.0 - config.contamination}).drop("n")
