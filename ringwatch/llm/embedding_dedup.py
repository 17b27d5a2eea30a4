"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, components.

A table hashes a vector to the signs of its products with random hyperplanes. The number of
planes follows the number of vectors so that a bucket holds about ``OCCUPANCY`` of them, and
the number of tables follows from it so that a pair at the threshold shares no bucket with
probability ``MISS`` at most.

Equal vectors are one class with a size. Buckets are compared as blocks: a bucket of many
classes is dealt into chunks, and each pair of chunks is one small matrix product. A block
returns a row per vector, its number of links and the first vector it hangs together with, never
the pairs. A pair that shares several buckets counts in the first table only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.llm.base import stored, table
from ringwatch.llm.components import components
from ringwatch.llm.vectors import matrix, plain, unit, usable

OCCUPANCY = 1024
CHUNK = 2048
MISS = 1e-6


def plan(vectors: int, threshold: float) -> tuple[int, int]:
    """Planes of a table and number of tables for so many vectors."""
    planes = max(4, math.ceil(math.log2(max(1, vectors) / OCCUPANCY)))
    same = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(MISS) / math.log1p(-same))


def _coded(planes: int, tables: int, seed: int):
    """Bucket numbers of each vector, one per table."""

    def run(batches):
        normals: dict[int, np.ndarray] = {}
        bits = 1 << np.arange(planes, dtype=np.int64)
        for batch in batches:
            vectors = batch.column("vector")
            sizes = np.array(pc.list_value_length(vectors))
            codes = np.zeros((len(sizes), tables), dtype=np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                if size not in normals:
                    normals[size] = np.random.default_rng([seed, int(size)]).standard_normal((int(size), planes * tables))
                signs = unit(matrix(vectors.take(pa.array(at)))) @ normals[size] > 0
                codes[at] = signs.reshape(len(at), tables, planes) @ bits
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*batch.schema.names, "codes"])

    return run


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each element's component under the links ``i - j``."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


_BLOCK = pa.schema([("node", pa.binary()), ("hub", pa.binary()), ("links", pa.int64())])


def _block(threshold: float):
    """Links within a chunk, or across two."""

    def run(key, rows):
        turn, lo, hi = key[0].as_py(), key[3].as_py(), key[4].as_py()
        rows = rows.combine_chunks()
        vectors = unit(matrix(rows.column("vector")))
        codes = matrix(rows.column("codes")).astype(np.int64)
        sizes = rows.column("size").to_numpy()
        chunk = rows.column("chunk").to_numpy()
        left = np.flatnonzero(chunk == lo)
        right = left if lo == hi else np.flatnonzero(chunk == hi)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(left), 256):
            own = left[at : at + 256]
            near = vectors[own] @ vectors[right].T >= threshold
            if lo == hi:
                near &= own[:, None] < right[None, :]
            a, b = np.nonzero(near)
            a, b = own[a], right[b]
            if turn:
                earlier = np.zeros(len(a), dtype=bool)
                for t in range(turn):
                    earlier |= codes[a, t] == codes[b, t]
                a, b = a[~earlier], b[~earlier]
            ends.append((a, b))
        a, b = (np.concatenate(x) if ends else np.zeros(0, dtype=np.int64) for x in zip(*ends)) if ends else (np.zeros(0, dtype=np.int64),) * 2
        n = len(sizes)
        links = np.bincount(a, sizes[b], n) + np.bincount(b, sizes[a], n)
        root = _local_roots(n, a, b)
        at = np.flatnonzero(links)
        nodes = rows.column("node").combine_chunks()
        return pa.Table.from_arrays(
            [nodes.take(pa.array(at)), nodes.take(pa.array(root[at])), pa.array(links[at].astype(np.int64))], schema=_BLOCK)

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, seed: int = 9,
                           key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Two vectors of equal length link if their cosine in doubles is at least ``threshold``.
    ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is the
    smallest id reachable, ``kept`` marks the row that bears it. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing and keep their own id. Rows that repeat
    an id all come back, each by its own vector. Rows without an id link as any other; a component
    of such rows alone has a null id, and none of them is kept. Further columns are ignored.
    """
    base = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("vector"))
    node = F.when(usable(F.col("vector")), F.unhex(F.md5(plain(F.col("vector")).cast("string"))))
    base = base.withColumn("node", node)
    classes = stored(
        base.where("node IS NOT NULL").groupBy("node").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.min("vector").alias("vector")), "vector-classes")
    planes, tables = plan(classes.count(), threshold)
    kind = classes.schema["vector"].dataType.simpleString()
    coded = stored(classes.select("node", "size", "vector").mapInArrow(
        _coded(planes, tables, seed), f"node binary, size long, vector {kind}, codes array<long>"), "vector-codes")

    length = F.size("vector").alias("dims")
    spread = coded.select(F.posexplode("codes").alias("turn", "code"), length, "node")
    counts = spread.groupBy("turn", "code", "dims").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("chunks"))
    rows = coded.select("*", length, F.posexplode("codes").alias("turn", "code"))
    rows = rows.join(counts.where("chunks > 1"), ["turn", "code", "dims"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node", "turn"), F.col("chunks")))
    rows = rows.withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.select("turn", "code", "dims", F.least("chunk", "mate").alias("lo"), F.greatest("chunk", "mate").alias("hi"),
                       "chunk", "node", "size", "vector", "codes")
    found = rows.groupBy("turn", "code", "dims", "lo", "hi").applyInArrow(_block(threshold), "node binary, hub binary, links long")
    found = stored(found, "vector-links")

    places = components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    named = classes.select("node", "rep", "size").join(places, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = named.join(smallest, "root").join(links, "node", "left").select(
        "node", "component", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"))
    result = base.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return result.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings at cosine 0.95."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.95)


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (
  SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0
  AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (
  SELECT vec_id, vec_id AS other FROM v
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, c.component_id,
       v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (vec_id)
"""
