"""Packing of token sequences by minimum bin slack.

Documents longer than a window give full windows; what is left of each is one piece. A plan
fills windows from the number of pieces of each length alone, at most ``window`` numbers
whatever the corpus: a window takes the longest piece left, and a bitset subset-sum programme
finds the multiset of remaining lengths that comes closest to its end. The counts are read back
from the bitsets, and the window is repeated as often as the remaining pieces allow, so that the
plan has few more entries than there are lengths.

Pieces are then numbered within their length, in slices so that no length lands in one task,
and look their places up in the plan, a table of bounded size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ringwatch.llm.base import stored, table
from ringwatch.llm.tokens import KEPT, word_tokens

WINDOW = 2048
#: Pieces that one task numbers.
SLICE = 50_000
END = 1


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of lengths, within their counts, whose sum comes closest to ``room`` from below.

    Bit ``s`` of a bitset says that sum ``s`` can be had from the lengths so far. A length of which
    ``c`` can be used enters as 1, 2, 4, ... and the rest, so in a few shifts.
    """
    mask = (1 << (room + 1)) - 1
    reached = 1
    steps: list[tuple[int, int, int]] = []  # length, copies, bitset before
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reached))
            reached |= reached << (length * copies) & mask
            left -= copies
            copies *= 2
        if reached >> room:
            break
    total = reached.bit_length() - 1
    used: dict[int, int] = {}
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + copies
            total -= length * copies
    return used


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``length, first, last, each, sequence, offset`` that say where pieces go.

    The pieces of ``length`` numbered from ``first`` up to before ``last`` fill, ``each`` at a time,
    the sequences from ``sequence`` on, side by side from ``offset``.
    """
    left = {k: v for k, v in counts.items() if v}
    taken = dict.fromkeys(left, 0)
    rows = []
    sequence = 0
    while left:
        longest = max(left)
        left[longest] -= 1
        fill = best_fill(left, window - longest)
        left[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[x] // k for x, k in fill.items())
        offset = 0
        for length in sorted(fill, reverse=True):
            each = fill[length]
            rows.append((length, taken[length], taken[length] + each * times, each, sequence, offset))
            offset += length * each
            taken[length] += each * times
            left[length] -= each * times
            if not left[length]:
                del left[length]
        sequence += times
    return rows


_PIECES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.list_(pa.uint32()))])
_PIECE_ROWS = "doc_id long, text_key long, start long, length long, ids_crc32 long, doc_tokens long, ids array<long>"


def _cut(path: str, window: int, end: int, with_ids: bool, kept: int):
    """Full windows and one rest of each document's tokens, with the closing id."""

    def run(batches):
        tokens = word_tokens(path, kept)
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            doc, key = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
            out: list[tuple] = []
            size = 0
            texts = (t.as_py() or "" for t in batch.column("text"))
            for n, ids in enumerate(tokens.encode_all(texts)):
                ids += tail
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    out.append((doc[n], key[n], start, len(piece) // 4, zlib.crc32(piece), total,
                                np.frombuffer(piece, dtype="<u4") if with_ids else None))
                size += total
                if size > 500_000:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], _PIECES.field(k).type) for k in range(7)], schema=_PIECES).cast(
        _PIECES.set(6, pa.field("ids", pa.list_(pa.int64()))))


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, with_ids: bool = True, kept: int = KEPT) -> DataFrame:
    """Place every token of every document in a sequence of at most ``window`` tokens.

    Returns a row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``
    (``ids`` is null without ``with_ids``). A document's tokens are those of the tokenizer file at
    ``path``, which every executor must have, and the id ``end``. A null or empty text has that id
    alone. Rows that repeat a doc_id or a text are packed as any other. Within a sequence the pieces
    stand without gaps from offset 0. An empty table gives no rows. Further columns are ignored.
    ``kept`` is the number of words whose ids a worker remembers, about 500 bytes each.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("text_key", F.coalesce(F.xxhash64("text"), F.lit(0)))
    pieces = stored(own.mapInArrow(_cut(path, window, end, with_ids, kept), _PIECE_ROWS), "packing-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(counts, window)
    spark = docs.sparkSession
    places = spark.createDataFrame(rows, T.StructType([T.StructField(c, T.LongType()) for c in (
        "length", "first", "last", "each", "sequence", "at")]))

    slices = max(1, -(-sum(counts.values()) // SLICE))
    order = ["doc_id", "start", "text_key"]
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    sizes = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "slice", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "slice").orderBy(*order)) - 1
    numbered = sliced.withColumn("number", number).join(sizes, ["length", "slice"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("before")).drop("before", "slice")
    placed = numbered.join(F.broadcast(places), "length").where("number >= first AND number < last")
    turn = F.col("number") - F.col("first")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(turn / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + turn % F.col("each") * F.col("length")).alias("offset"), "ids")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in windows of 2048 tokens."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(table(spark, sf_dir, "documents"), path, 2048, with_ids=False).drop("ids")
