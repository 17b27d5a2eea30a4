"""Nearest neighbours by multiprobe p-stable hashing and exact distances.

A table hashes a vector to the cells ``floor((a . x + b) / width)`` of a few random directions
``a``. A neighbour at distance ``r`` differs from the query by a normal deviate of scale ``r`` in
each direction, so the probability that it lies in a perturbed cell is a product of differences
of the normal distribution function. A query visits cells in order of that probability, from its
own cell on, until they add up to what each table has to contribute to the wished success.

The radius is the upper quartile of the k-th distances within a sample of at most ``SAMPLE``
vectors; a sample's neighbours lie farther away than those in the whole table, so it errs on the
safe side. The sample only sets the width; every vector is indexed. Queries that find fewer than ``k``
vectors, or the last of them farther than the radius, are held against all vectors in blocks.

Cells are dealt to blocks, and blocks of many vectors to chunks. A query goes to a block once,
with the cells it visits there, and comes back with the nearest vectors of it; so neither
candidates nor probes become rows, and no cell lands in one task.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringwatch.llm.base import stored, table
from ringwatch.llm.vectors import matrix, usable

TABLES = 4
SUCCESS = 0.97
SAMPLE = 4000
#: Vectors that a block, and a chunk of it, holds about.
BLOCK = 2048
#: Vectors that a cell holds about.
CELL = 256
#: Vectors and queries that stand in a block where all of them are compared, about.
WHOLE = 32768
ASKED = 4096


def _phi(x: np.ndarray) -> np.ndarray:
    """Normal distribution function."""
    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


class Hashing:
    """The directions and cells of all tables."""

    def __init__(self, dims: int, functions: int, tables: int, width: float, radius: float, seed: int):
        rng = np.random.default_rng([seed, dims])
        self.directions = rng.standard_normal((dims, tables * functions))
        self.offsets = rng.uniform(0, width, tables * functions)
        self.mix = rng.integers(1, 2**62, functions, dtype=np.int64) | 1
        self.functions, self.tables, self.width, self.radius = functions, tables, width, radius

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Coordinates in cell widths: rows x tables x functions."""
        flat = (rows @ self.directions + self.offsets) / self.width
        return flat.reshape(len(rows), self.tables, self.functions)

    def cells(self, steps: np.ndarray) -> np.ndarray:
        """One number for each cell, from its steps along the functions."""
        return (steps.astype(np.int64) * self.mix).sum(axis=-1)

    def probes(self, place: np.ndarray, wished: float) -> np.ndarray:
        """Steps of the cells of one table that a query at ``place`` visits, likeliest first."""
        home = np.floor(place).astype(np.int64)
        reach = max(2, math.ceil(4 * self.radius / self.width))
        shifts = np.arange(-reach, reach + 1)
        edges = (home[:, None] + np.append(shifts, reach + 1)[None, :] - place[:, None]) * (self.width / self.radius)
        chance = np.maximum(np.diff(_phi(edges), axis=1), 1e-300)
        order = np.argsort(-chance, axis=1, kind="stable")
        cost = -np.log(np.take_along_axis(chance, order, axis=1))
        # best-first over ranks of each function's cells; a successor raises a rank at or after the last raised one
        ranks = (0,) * self.functions
        heap = [(float(cost[:, 0].sum()), 0, ranks)]
        found, total = [], 0.0
        while heap and total < wished:
            now, last, ranks = heapq.heappop(heap)
            found.append([home[f] + shifts[order[f, r]] for f, r in enumerate(ranks)])
            total += math.exp(-now)
            for f in range(last, self.functions):
                if ranks[f] + 1 < len(shifts):
                    more = now - cost[f, ranks[f]] + cost[f, ranks[f] + 1]
                    heapq.heappush(heap, (float(more), f, (*ranks[:f], ranks[f] + 1, *ranks[f + 1 :])))
        return np.array(found)


def _blocks_of(cells: np.ndarray, blocks: int) -> np.ndarray:
    """The block that a cell belongs to."""
    mixed = cells.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def _indexed(hashing: Hashing, blocks: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = hashing.cells(np.floor(hashing.places(matrix(batch.column("vector")))))
            for t in range(hashing.tables):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(batch.num_rows, t)), pa.array(_blocks_of(cells[:, t], blocks)), pa.array(cells[:, t])],
                    names=[*batch.schema.names, "turn", "block", "cell"])

    return run


def _probed(hashing: Hashing, blocks: int, success: float):
    wished = 1 - (1 - success) ** (1 / hashing.tables)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            places = hashing.places(matrix(batch.column("vector")))
            rows, turns, where, cells = [], [], [], []
            for n in range(batch.num_rows):
                for t in range(hashing.tables):
                    visited = hashing.cells(hashing.probes(places[n, t], wished))
                    block = _blocks_of(visited, blocks)
                    for b in np.unique(block):
                        rows.append(n)
                        turns.append(t)
                        where.append(int(b))
                        cells.append(visited[block == b])
                if len(rows) > 2000 or n == batch.num_rows - 1:
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id").take(at), batch.column("vector").take(at), pa.array(turns, pa.int64()),
                         pa.array(where, pa.int64()), pa.array(cells, pa.list_(pa.int64()))],
                        names=["vec_id", "vector", "turn", "block", "cells"])
                    rows, turns, where, cells = [], [], [], []

    return run


_NEAR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _nearest(k: int):
    """The ``k`` nearest vectors of one chunk for each query, of the cells that it visits."""

    def run(key, queries, rows):
        if not queries.num_rows or not rows.num_rows:
            return _NEAR.empty_table()
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], matrix(rows.column("vector"))[order]
        cells = rows.column("cell").to_numpy()[order]
        own, points = queries.column("vec_id").to_numpy(), matrix(queries.column("vector"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n, visited in enumerate(queries.column("cells")):
            at = np.flatnonzero(np.isin(cells, visited.values.to_numpy()) & (ids != own[n]))
            if not len(at):
                continue
            far = np.sqrt(((vectors[at] - points[n]) ** 2).sum(axis=1))
            best = np.argsort(far, kind="stable")[:k]  # ids ascend, so ties go to the smaller
            out.append((np.full(len(best), own[n]), ids[at[best]], far[best]))
        if not out:
            return _NEAR.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_NEAR)

    return run


def _exact(k: int):
    """The ``k`` nearest vectors of a whole block for each query."""

    def run(key, queries, rows):
        if not queries.num_rows or not rows.num_rows:
            return _NEAR.empty_table()
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], matrix(rows.column("vector"))[order]
        own, points = queries.column("vec_id").to_numpy(), matrix(queries.column("vector"))
        norms = (vectors**2).sum(axis=1)
        single = len(np.unique(ids)) == len(ids)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n, point in enumerate(points):
            at = np.flatnonzero(ids != own[n])
            if not len(at):
                continue
            if single and len(at) > k:  # a screen with room for its rounding; the distances follow
                rough = norms[at] - 2 * (vectors[at] @ point)
                bound = np.partition(rough, k - 1)[k - 1] + 1e-9 * (norms.max() + point @ point)
                at = at[~(rough > bound)]
            far = np.sqrt(((vectors[at] - point) ** 2).sum(axis=1))
            best = np.argsort(far, kind="stable")
            _, first = np.unique(ids[at[best]], return_index=True)  # an id counts once, at its nearest
            best = best[np.sort(first)[:k]]
            out.append((np.full(len(best), own[n]), ids[at[best]], far[best]))
        if not out:
            return _NEAR.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_NEAR)

    return run


def _radius(rows: np.ndarray, k: int) -> float:
    """Upper quartile of the distances to the k-th nearest other row."""
    if len(rows) < 2:
        return 1.0
    picks = rows[: min(len(rows), 500)]
    far = (picks**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None] - 2 * picks @ rows.T
    far = np.sqrt(np.maximum(np.sort(far, axis=1)[:, min(k, len(rows) - 1)], 0))
    return float(np.quantile(far, 0.75)) or 1e-9


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, success: float = SUCCESS, seed: int = 3) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries``: ``query_id, rank, vec_id, score``.

    Both have ``vec_id, embedding``; a query's own id is no candidate. ``score`` is the Euclidean
    distance in doubles; ties go to the smaller vec_id. Vectors that are null, empty, zero or hold null
    or non-finite components take no part, nor do rows without an id, nor those of another length than
    most have. Rows that repeat an id count once, at the nearest. Queries without candidates have no row. Further
    columns are ignored.
    """
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(
        usable(F.col("vector")) & F.col("vec_id").isNotNull())
    base, asked = clean(vectors), clean(queries)
    sizes = base.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    dims, n = (sizes["dims"], sizes["n"]) if sizes else (1, 0)
    base, asked = (df.where(F.size("vector") == dims) for df in (base, asked))
    place = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000_000))
    sample = base.where(place < int(1_000_000_000 * min(1.0, SAMPLE / max(n, 1)))).select("vector").toArrow()
    rows = matrix(sample.column("vector")) if sample.num_rows else np.zeros((0, dims))
    spread = float(np.sqrt(rows.var(axis=0).sum())) if len(rows) else 1.0
    radius = _radius(rows, k)
    # a direction has about three cells within two deviations of the vectors to either side
    width = max(4 * spread / 3, 1e-9)
    functions = max(2, round(math.log(max(n, 1) / CELL, 3)))
    blocks = max(1, math.ceil(n / BLOCK))
    hashing = Hashing(dims, functions, tables, width, radius, seed)

    kind = base.schema["vector"].dataType.simpleString()
    index = base.mapInArrow(_indexed(hashing, blocks), f"vec_id long, vector {kind}, turn long, block long, cell long")
    probes = asked.mapInArrow(_probed(hashing, blocks, success), f"vec_id long, vector {kind}, turn long, block long, cells array<long>")
    chunks = base.select("vec_id", "vector").mapInArrow(_cells_only(hashing, blocks), "turn long, block long").groupBy("turn", "block").agg(
        F.ceil(F.count("*") / F.lit(2 * BLOCK)).alias("chunks"))
    chunks = stored(chunks, "nearest-chunks")
    index = index.join(chunks, ["turn", "block"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id", "turn"), F.col("chunks"))).drop("chunks")
    probes = probes.join(chunks, ["turn", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    keys = ["turn", "block", "chunk"]
    found = probes.groupBy(*keys).cogroup(index.alias("i").groupBy(*keys)).applyInArrow(_nearest(k), "query_id long, vec_id long, score double")

    def first(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    near = stored(first(found), "nearest-probed")
    done = near.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("far")).where((F.col("n") >= k) & (F.col("far") <= radius))
    rest = stored(asked.join(done.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"), "nearest-rest")
    left = rest.count()
    if not left:
        return near
    # every part of these queries meets every block of the vectors
    parts, blocks = math.ceil(left / ASKED), max(1, math.ceil(n / WHOLE))
    all_of = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    deal = lambda count: F.pmod(F.xxhash64("vec_id", "vector", F.lit(seed)), F.lit(count).cast("long"))
    rest = rest.withColumn("part", deal(parts)).withColumn("block", all_of(blocks))
    whole = base.withColumn("block", deal(blocks)).withColumn("part", all_of(parts))
    more = rest.groupBy("part", "block").cogroup(whole.alias("i").groupBy("part", "block")).applyInArrow(_exact(k), "query_id long, vec_id long, score double")
    return first(near.select("query_id", "vec_id", "score").unionByName(more))


def _cells_only(hashing: Hashing, blocks: int):
    def run(batches):
        for batch in _indexed(hashing, blocks)(batches):
            yield batch.select(["turn", "block"])

    return run


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)
