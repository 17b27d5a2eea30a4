"""Byte-pair encoding of whole texts by tree concatenation, and decoding.

Long texts, also those without any blank, are cut into halves down to leaves that tasks encode
in parallel. The ids of neighbouring halves are then joined up the tree; around each seam a
growing window is encoded anew until its ends agree with both sides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.llm.base import table
from ringwatch.llm.tokens import ByteTokens, byte_tokens

LEAF = 32_768
_RESULT = pa.schema([("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                     ("decoded", pa.string()), ("decoded_sha256", pa.string())])
_RESULT_SQL = "ids array<int>, n_tokens long, ids_sha256 string, decoded string, decoded_sha256 string"


class _Results:
    """Collects result columns of one batch."""

    def __init__(self, tokens: ByteTokens, keep: bool):
        self.tokens, self.keep = tokens, keep
        self.names = [str(i) for i in range(len(tokens.bytes))]
        self.rows: list[tuple] = []

    def add(self, ids: list[int]) -> None:
        decoded = self.tokens.decode(ids)
        digest = hashlib.sha256(",".join(map(self.names.__getitem__, ids)).encode()).hexdigest()
        self.rows.append((ids if self.keep else None, len(ids), digest, decoded if self.keep else None,
                          hashlib.sha256(decoded.encode()).hexdigest()))

    def take(self) -> list[pa.Array]:
        rows, self.rows = self.rows, []
        return [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_RESULT)]


def _whole(path: str, keep: bool):
    """Results of texts that one task encodes."""

    def run(batches):
        tokens = byte_tokens(path)
        results = _Results(tokens, keep)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for ids in tokens.encode_all([t or "" for t in part.column("text").to_pylist()]):
                    results.add(np.frombuffer(ids, dtype="<u4").tolist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *results.take()], names=["doc_id", *_RESULT.names])

    return run


def _leaves(path: str, most: int):
    """A row per leaf of each text."""

    def run(batches):
        tokens = byte_tokens(path)
        for batch in batches:
            for n in range(batch.num_rows):
                leaves = tokens.halves(batch.column("text")[n].as_py(), most)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("text_key")[n].as_py()] * len(leaves), pa.string()),
                     pa.array(range(len(leaves)), pa.int64()), pa.array(leaves)], names=["text_key", "leaf", "text"])

    return run


def _encoded(path: str):
    """Ids of each leaf."""

    def run(batches):
        tokens = byte_tokens(path)
        for batch in batches:
            ids = [tokens.encode(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key"), batch.column("leaf"), pa.array(ids, pa.list_(pa.int32()))], names=["text_key", "leaf", "ids"])

    return run


def _joined(path: str, keep: bool):
    """Results of texts from the ids of their leaves; one row each, leaves in order."""

    def run(batches):
        tokens = byte_tokens(path)
        results = _Results(tokens, keep)
        for batch in batches:
            for at in range(batch.num_rows):
                leaves = batch.column("leaves")[at].as_py()
                results.add(tokens.join_all([leaf["ids"] for leaf in leaves]))
                yield pa.RecordBatch.from_arrays([batch.column("text_key").slice(at, 1), *results.take()], names=["text_key", *_RESULT.names])

    return run


def encode_decode(docs: DataFrame, path: str, leaf: int = LEAF, keep: bool = True) -> DataFrame:
    """Ids of every text and the text decoded from them again.

    Returns ``doc_id, ids, n_tokens, ids_sha256, decoded, decoded_sha256``; without ``keep``, ``ids`` and
    ``decoded`` are null. ``path`` is a byte-level tokenizer file that every executor has. Ids equal
    those of the library without special tokens added; a marker written in a text gets its id, as
    there. Null and empty texts have no ids. Texts above ``leaf`` characters are encoded in parallel,
    equal ones once. Rows that repeat others all come back. Further columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.length("text") > leaf, F.lit(False))
    short = own.where(~long).mapInArrow(_whole(path, keep), f"doc_id long, {_RESULT_SQL}")
    tall = own.where(long).withColumn("text_key", F.concat(F.md5("text"), F.length("text")))
    texts = tall.select("text_key", "text").dropDuplicates(["text_key"])
    leaves = texts.mapInArrow(_leaves(path, leaf), "text_key string, leaf long, text string")
    parts = leaves.repartition("text_key", "leaf").mapInArrow(_encoded(path), "text_key string, leaf long, ids array<int>")
    whole = parts.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("leaf", "ids"))).alias("leaves"))
    joined = whole.mapInArrow(_joined(path, keep), f"text_key string, {_RESULT_SQL}")
    return short.unionByName(tall.select("doc_id", "text_key").join(joined, "text_key").drop("text_key"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of the texts decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return encode_decode(table(spark, sf_dir, "documents"), path, keep=False).drop("ids", "decoded")
