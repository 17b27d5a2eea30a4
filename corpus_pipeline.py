"""The cleaning pipeline of a text corpus, stage after stage.

Every stage takes all documents that the one before kept; what it decides takes effect in its
result. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.llm import quality, toxicity
from ringwatch.llm.base import small_batches, stored, table
from ringwatch.llm.minhash import near_duplicates
from ringwatch.llm.packing import pack
from ringwatch.llm.suffix_dedup import remove_repeats

#: Bytes from which a passage that stands twice is a repeat.
PASSAGE = 256
#: Words from which it is one in fewer bytes, too: over fifty.
WORDS = 51
#: Words that a worker of the last stage remembers; it shares its memory with the stages before.
KEPT = 100_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; each row by its own text."""
    small_batches(spark)
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, columns=tuple(COLUMNS))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(COLUMNS)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; each row by its own text."""
    small_batches(spark)
    model = quality.train_on(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, columns=tuple(COLUMNS))
    return scored.where(F.col("score") >= quality.THRESHOLD).select(COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays: that of the smallest doc_id.

    Sets are of five-word shingles, similar from 0.8 on. Of several texts with the doc_id that stays, one
    is left, and of rows that repeat it as well. Texts without words resemble nothing and stay. A null
    doc_id counts as the largest.
    """
    small_batches(spark)
    found = near_duplicates(docs, words=5, percent=80, keys=True)
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    alone = F.col("n_shingles") == 0
    row = F.struct(own.alias("id"), F.col("text_key").alias("key"))
    first = found.groupBy("root", alone.alias("alone"), F.when(alone, row).alias("each")).agg(F.min(row).alias("row"))
    first = first.select("row.id", "row.key", "alone")
    rows = docs.withColumns({"id": own, "key": F.coalesce(F.xxhash64("text"), F.lit(0))}).join(first, ["id", "key"])
    rows = rows.withColumn("turn", F.when(F.col("alone"), F.monotonically_increasing_id()).otherwise(-1))
    return rows.dropDuplicates(["id", "key", "turn"]).select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of ``PASSAGE`` bytes, or ``WORDS`` words, or more that stand elsewhere as well.

    All places of such a passage go. What is left of a character that a passage cuts goes too;
    ``n_chars`` is renewed. A document that consists of such passages stays with an empty text.
    """
    small_batches(spark)
    rows = docs.withColumn("missing", F.col("text").isNull())
    left = remove_repeats(rows, PASSAGE, words=WORDS, columns=("lang", "source", "n_chars", "missing"))
    left = left.select("doc_id", "kept", "n_removed", "lang", "source", "n_chars", "missing")
    left = left.mapInArrow(_whole, left.schema).withColumn("text", F.when(~F.col("missing"), F.col("kept").cast("string")))
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return left.select("doc_id", "text", "lang", "source", chars.alias("n_chars"))


def _whole(batches):
    """What is left of cut texts without broken characters."""
    for batch in batches:
        cut = zip(batch.column("kept"), batch.column("n_removed").to_pylist())
        kept = [b.as_py().decode("utf-8", "ignore").encode() if n else b.as_py() for b, n in cut]
        yield batch.set_column(1, batch.schema.field(1), pa.array(kept, batch.schema.field(1).type))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048 ids: a row per piece of a document with its place and its ids."""
    small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, kept=KEPT)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near_duplicates", without_near_copies),
    ("repeated_passages", without_repeats),
    ("packing", packed),
]

#: No SQL: the stages train models, hash and tokenize; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents, each written and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
