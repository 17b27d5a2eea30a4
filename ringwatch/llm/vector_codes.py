"""Vector code compression: product codes whose entries are found by equal-average search.

Vectors become integers and are cut into equal parts; each part is replaced by the number of the
nearest entry of its position's codebook. Codebooks are refined by a fixed number of rounds of
assignment and averaging, all in integers, so that results do not depend on how rows are dealt.

The entries of a codebook are sorted by the sum of their components. For two parts of ``d``
components, the squared distance is at least the squared difference of their sums over ``d``. A
search therefore starts at the part's own sum, goes outward on both sides, nearer sums first, and
ends when the squared gap over ``d`` strictly exceeds the best distance so far; a tie in distance
is then never missed. A batch of parts goes outward together, and the settled ones drop out.

Codebooks have a fixed size (parts x entries x components) and travel with the tasks; a round
sends back one sum and count for each of their cells and task, joined by Spark before the driver
sees one row per cell.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.llm.base import stored, table
from ringwatch.llm.vectors import matrix

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Labels up to which their totals are broadcast; beyond it both sides are joined by a salted shuffle.
FEW_LABELS = 100_000
SALTS = 64


def finite(vector):
    """True for vectors without a component that is null or not finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each part's nearest entry and its squared distance, ties to the smaller number.

    ``parts`` is (n, d), ``entries`` (k, d), both integers of at most 2**30 / d in size.
    """
    n, width = parts.shape
    order = np.argsort(entries.sum(axis=1), kind="stable")
    sums = entries.sum(axis=1)[order]
    own = parts.sum(axis=1)
    high = np.searchsorted(sums, own)
    low = high - 1
    best = np.full(n, np.iinfo(np.int64).max)
    chosen = np.full(n, len(entries))
    far = np.int64(2**40)  # beyond any gap
    todo = np.arange(n)
    while len(todo):
        below = np.where(low[todo] >= 0, own[todo] - sums[np.maximum(low[todo], 0)], far)
        above = np.where(high[todo] < len(sums), sums[np.minimum(high[todo], len(sums) - 1)] - own[todo], far)
        gap = np.minimum(below, above)
        # gap**2 / d > best, in integers; before the first entry there is no best
        going = gap < far
        seen = chosen[todo] < len(entries)
        going[seen] &= gap[seen] ** 2 <= best[todo[seen]] * width
        todo, down = todo[going], (below <= above)[going]
        place = np.where(down, low[todo], high[todo])
        entry = order[place]
        gaps = parts[todo] - entries[entry]
        distance = (gaps * gaps).sum(axis=1)
        better = (distance < best[todo]) | ((distance == best[todo]) & (entry < chosen[todo]))
        best[todo[better]], chosen[todo[better]] = distance[better], entry[better]
        low[todo[down]] -= 1
        high[todo[~down]] += 1
    return chosen, best


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    rows = matrix(column).astype(np.int64)
    return rows.reshape(len(rows), parts, -1)


def _sums(books: np.ndarray):
    """Count and component sums of the parts that fall to each entry, once for a task."""
    parts, entries, width = books.shape

    def run(batches):
        total = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            rows = _parts(batch.column("ints"), parts)
            for p in range(parts if len(rows) else 0):
                chosen, _ = nearest_entries(rows[:, p], books[p])
                by = np.argsort(chosen, kind="stable")
                found, first = np.unique(chosen[by], return_index=True)
                total[p, found, :width] += np.add.reduceat(rows[by, p], first, axis=0)
                total[p, found, width] += np.diff(np.append(first, len(by)))
        p, e, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(at, pa.int32()), pa.array(total[p, e, at])],
            names=["part", "entry", "position", "total"])

    return run


def _coded(books: np.ndarray, columns: list[str]):
    parts = len(books)

    def run(batches):
        for batch in batches:
            rows = _parts(batch.column("ints"), parts)
            found = [nearest_entries(rows[:, p], books[p]) for p in range(parts)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8) if len(rows) else np.zeros((0, parts), np.uint8)
            error = sum((e for _, e in found), np.zeros(len(rows), dtype=np.int64))
            code = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                names=[*columns, "code", "error"])

    return run


@dataclass(frozen=True)
class Codebooks:
    """Integer entries by part, entry and position within the part."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, columns: list[str], vector: str, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """Rows that take part, their ``columns`` with ``ints``, and the components of a part.

    ``ints`` is floor(scale * x) of each component, held within +-2**30 / (components of a part) so that
    squares fit 64 bits. Vectors that are null or hold null or non-finite components take no part, nor
    do those of another length than the commonest (of equally common ones the longest; never none).
    Lengths that do not divide into equal parts are filled up with zeros.
    """
    rows = vectors.select(*columns, F.col(vector).cast("array<double>").alias("__v")).where(finite(F.col("__v")) & (F.size("__v") > 0))
    lengths = rows.groupBy(F.size("__v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    length = lengths[0]["length"] if lengths else 0
    width = -(-length // parts)
    most = 2**30 // max(width, 1)
    whole = F.transform("__v", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(1e12)), F.lit(-1e12)) * scale), F.lit(most)), F.lit(-most)).cast("int"))
    if width * parts > length:
        whole = F.concat(whole, F.array_repeat(F.lit(0), width * parts - length))
    return rows.where(F.size("__v") == length).select(*columns, whole.alias("ints")), width


def train(rows: DataFrame, width: int, order: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks from all ``rows`` (``order``, ``ints``).

    They start with the parts of the rows of the smallest ``order`` (null last, repeated values by their
    vectors), as many as there are up to ``entries``. An entry to which no part falls stays as it is.
    """
    first = rows.select("ints", order).orderBy(F.col(order).asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    books = np.array([r["ints"] for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        sums = rows.select("ints").mapInArrow(_sums(books), "part int, entry int, position int, total long")
        total = np.zeros((*books.shape[:2], width + 1), dtype=np.int64)
        for r in sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total")).collect():
            total[r["part"], r["entry"], r["position"]] = r["total"]
        used = total[:, :, width] > 0
        books[used] = total[used][:, :width] // total[used][:, width:]  # floors, below zero as well
    return Codebooks(books)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """The columns of ``rows`` but ``ints``, with ``code`` (two hex digits a part) and ``error``.

    ``error`` is the squared distance between the integers and the entries that stand for them.
    """
    columns = [c for c in rows.columns if c != "ints"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
    return rows.mapInArrow(_coded(books.entries, columns), f"{kinds}, code string, error long")


def compress(vectors: DataFrame, order: str = "vec_id", vector: str = "embedding", columns: tuple[str, ...] = ()) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors that take part (see :func:`integers`), and their codebooks.

    An empty table gives empty codebooks and no rows. Rows that repeat an id are coded one by one.
    Further columns than ``order`` and ``columns`` are ignored, whatever their names.
    """
    ints, width = integers(vectors, [order, *columns], vector)
    rows = stored(ints, "vector_ints")
    books = train(rows, width, order)
    return encode(rows, books), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Each row with ``label_error``: the errors of all rows of its label, null labels together."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = stored(totals, "label_errors").withColumnRenamed("label", "__label")
    few = totals.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    same = F.col("label").eqNullSafe(F.col("__label"))
    if few:
        return coded.join(F.broadcast(totals), same).drop("__label")
    salted = coded.withColumn("__salt", (F.rand(7) * SALTS).cast("int"))
    copies = totals.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, same & (F.col("__salt") == F.col("__turn"))).drop("__label", "__salt", "__turn")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings."""
    coded, books = compress(table(spark, sf_dir, "embeddings"), columns=("label",))
    rows = with_label_error(stored(coded, "vector_codes"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    parts = [
        "ints AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v"
        " FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0"
        " AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v"
        f" FROM ints CROSS JOIN (SELECT unnest(range({PARTS})) AS p))",
        f"firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM ints ORDER BY vec_id LIMIT {ENTRIES})",
        "book0 AS MATERIALIZED (SELECT p, e, v AS c FROM parts JOIN firsts USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        # the smallest distance and, of equal ones, the smallest entry
        parts.append(
            f"near{k} AS MATERIALIZED (SELECT vec_id, label, p, v,"
            f" min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {ENTRIES} + e) AS m"
            f" FROM parts JOIN book{k} USING (p) GROUP BY vec_id, label, p, v)")
        if k == ROUNDS:
            break
        parts.append(
            f"sum{k} AS (SELECT p, e, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p, m % {ENTRIES} AS e, unnest(v) AS x,"
            f" generate_subscripts(v, 1) AS pos FROM near{k}) GROUP BY p, e, pos)")
        parts.append(f"mean{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM sum{k} GROUP BY p, e)")
        parts.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)")
    parts += [
        f"coded AS (SELECT vec_id, label, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error"
        f" FROM near{ROUNDS} GROUP BY vec_id, label)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})",
    ]
    return ("WITH " + ",\n".join(parts) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256"
            " FROM coded CROSS JOIN digest")


OP11_SQL = _sql()
