"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Circulant MinHash needs two permutations: ``sigma`` scatters the shingle hashes over the
universe 0 .. 2**32 - 1, and ``pi``, shifted circularly by ``k`` places, gives coordinate
``k`` of the signature: ``min over shingles of pi(sigma(x) - k mod 2**32)``.

Documents with equal shingle sets are one class from the start; only classes are compared.
Bands of equal signature rows name candidates in steps that never list all pairs of a bucket:

1. every class is held against the smallest class of each of its buckets, but only the most
   similar of these by signature; verified links give first components. A large group of near
   copies is mostly one component by then;
2. what shares a bucket across two components after that is compared as well: in buckets of up
   to ``CROWD`` classes pair by pair, in larger ones block by block, where a task holds the sets
   of two chunks of a bucket and returns the links that join components.

Components only grow, so no link between classes that share a bucket is lost. With the
default 40 bands of 6 rows, two sets of similarity 0.8 share none with probability 5e-6.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.llm.base import stored, table
from ringwatch.llm.components import components
from ringwatch.llm.shingles import mix64, shingle_sets

ROWS = 6
BANDS = 40
#: Classes in a bucket up to which all its pairs may be compared.
CROWD = 32
#: Classes of a larger bucket that stand in a chunk.
CHUNK = 1024
#: Standard errors that a pair's estimated similarity may lie below the threshold and still be verified.
MARGIN = 4.5
_EMPTY = np.uint32(0xFFFFFFFF)


def _pi(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers; changes ``x`` in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit shingle hashes."""
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    best = np.full(size, _EMPTY, dtype=np.uint32)
    sigma = (mix64(hashes ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(sigma), 1024):
        np.minimum(best, _pi(sigma[None, at : at + 1024] - shifts).min(axis=1), out=best)
    return best


def _signed(words: int, rows: int, bands: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("set_key", pa.binary()),
                        ("n_shingles", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        salt = np.arange(1, bands + 1, dtype=np.uint64)
        for batch in batches:
            keys, sizes, sigs, buckets = [], [], [], []
            for hashes in shingle_sets(batch.column("text"), words):
                keys.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                sizes.append(len(hashes))
                sig = signature(hashes, rows * bands)
                sigs.append(sig.astype(np.uint8).tobytes())
                part = mix64(salt)
                for column in sig.reshape(bands, rows).T:
                    part = mix64(part ^ column.astype(np.uint64))
                buckets.append(part.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.array(buckets, pa.list_(pa.int64()))], schema=schema)

    return run


_SIGNED = "doc_id long, text_key long, set_key binary, n_shingles long, sig binary, bands array<long>"


def _least_share(k: int, threshold: float, margin: float) -> float:
    """Share of equal signature bytes below which a pair's similarity is not the threshold."""
    share = threshold - margin * (threshold * (1 - threshold) / k) ** 0.5
    return share + (1 - share) / 256


def _alike(k: int, threshold: float, margin: float):
    """Keep the pairs whose signatures don't rule the threshold out."""
    least = _least_share(k, threshold, margin)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_bytes(batch.column(c), k) for c in ("sig_a", "sig_b"))
            share = (a == b).mean(axis=1)
            out = pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(share)], names=["a", "b", "share"])
            yield out.filter(pa.array(share >= least))

    return run


def _bytes(column: pa.Array | pa.ChunkedArray, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, k)


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _crowd(rows: int, bands: int, percent: int, margin: float):
    """Links that join components between the classes of one chunk, or of two, of a bucket."""
    k = rows * bands
    least = _least_share(k, percent / 100, margin)

    def run(key, block):
        bucket, lo, hi = (x.as_py() for x in key)
        keys = block.column("set_key").to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        block = block.take(pa.array(order))
        keys = [keys[n] for n in order]
        sig = _bytes(block.column("sig"), k)
        buckets = block.column("bands").combine_chunks().flatten().to_numpy().reshape(len(keys), bands)
        sets = [np.frombuffer(h, dtype=np.uint64) for h in block.column("hashes").to_pylist()]
        sizes = np.array([len(h) for h in sets])
        chunk = block.column("chunk").to_numpy()
        _, place = np.unique(np.array([r.hex() for r in block.column("root").to_pylist()]), return_inverse=True)
        found: list[tuple[bytes, bytes]] = []
        right = np.flatnonzero(chunk == hi)
        for i in np.flatnonzero(chunk == lo):
            mates = right[right > i] if lo == hi else right
            mates = mates[place[mates] != place[i]]
            mates = mates[np.minimum(sizes[mates], sizes[i]) * 100 >= np.maximum(sizes[mates], sizes[i]) * percent]
            shared = buckets[mates] == buckets[i]
            mates = mates[buckets[i][shared.argmax(axis=1)] == bucket]  # in other buckets they meet again
            mates = mates[(sig[mates] == sig[i]).mean(axis=1) >= least]
            for j in mates:
                if place[i] != place[j] and _similar(sets[i], sets[j], percent):
                    found.append((keys[i], keys[j]))
                    place[place == place[j]] = place[i]
        return pa.Table.from_arrays([pa.array([f[n] for f in found], pa.binary()) for n in range(2)], schema=_LINKS)

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether ``100 * intersection >= percent * union`` for two sorted sets."""
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _sets_of(words: int):
    """Shingle hashes of each text as bytes."""
    schema = pa.schema([("set_key", pa.binary()), ("hashes", pa.binary())])

    def run(batches):
        for batch in batches:
            sets = [h.tobytes() for h in shingle_sets(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([batch.column("set_key"), pa.array(sets, pa.binary())], schema=schema)

    return run


def _linked(percent: int):
    """Keep the pairs with ``100 * intersection >= percent * union`` of the full sets."""

    def run(batches):
        for batch in batches:
            keep = [_similar(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64), percent)
                    for x, y in zip(batch.column("left"), batch.column("right"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = ROWS,
                    bands: int = BANDS, margin: float = MARGIN, keys: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Links hold between texts whose sets of ``words``-word shingles have an intersection of
    at least ``percent`` hundredths of their union. ``component_id`` is the smallest doc_id
    reachable by links, ``kept`` marks the row that bears it.

    Null and empty texts, or texts of white space alone, have no shingles and link with
    nothing; a text with fewer words is one shingle. Rows that repeat a doc_id all come back,
    each with the component of its own text. A null doc_id counts as larger than any other and
    is kept only if its whole component has none. Further columns are ignored.

    With ``keys`` also ``text_key``, which tells the texts of a repeated doc_id apart, and ``root``, which
    is the same for the rows of a component and null for texts without shingles.
    """
    k = rows * bands
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("text_key", F.coalesce(F.xxhash64("text"), F.lit(0)))
    signed = stored(base.mapInArrow(_signed(words, rows, bands), _SIGNED), "minhash-signed")
    classes = (
        signed.where("n_shingles > 0").groupBy("set_key")
        .agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "text_key")).alias("rep"),
             F.min("n_shingles").alias("n"), F.min("sig").alias("sig"), F.min("bands").alias("bands"))
    )
    classes = stored(classes, "minhash-classes")

    members = classes.select(F.explode("bands").alias("bucket"), "set_key", "n")
    buckets = members.groupBy("bucket").agg(F.min("set_key").alias("hub"), F.count("*").alias("m")).where("m > 1")
    members = stored(members.join(buckets, "bucket"), "minhash-members")
    about = classes.select("set_key", "n", "sig")

    def paired(pairs: DataFrame) -> DataFrame:
        left = about.select(F.col("set_key").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
        right = about.select(F.col("set_key").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
        sized = pairs.join(left, "a").join(right, "b").where(
            F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(
            _alike(rows * bands, percent / 100, margin), "a binary, b binary, share double")

    def sets_of(used: DataFrame) -> DataFrame:
        where = classes.join(used, "set_key").select("set_key", F.col("rep.d").alias("d"), F.col("rep.text_key").alias("text_key"))
        own = base.withColumn("d", F.coalesce("doc_id", F.lit(2**63 - 1)))
        texts = own.join(where, ["d", "text_key"]).select("set_key", "text")
        sets = texts.mapInArrow(_sets_of(words), "set_key binary, hashes binary").dropDuplicates(["set_key"])
        return stored(sets, "minhash-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct())
        left = sets.select(F.col("set_key").alias("a"), F.col("hashes").alias("left"))
        right = sets.select(F.col("set_key").alias("b"), F.col("hashes").alias("right"))
        return stored(pairs.join(left, "a").join(right, "b").mapInArrow(
            _linked(percent), "a binary, b binary"), "minhash-links")

    def split(places: DataFrame, members: DataFrame) -> DataFrame:
        """The members of buckets that still lie in several components, with their components."""
        at = members.join(places.withColumnRenamed("node", "set_key"), "set_key", "left").select(
            "bucket", "set_key", "n", "m", F.coalesce("root", "set_key").alias("root"))
        apart = at.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        return stored(at.join(apart.select("bucket"), "bucket"), "minhash-split")

    stars = members.where("set_key <> hub").select(F.col("hub").alias("a"), F.col("set_key").alias("b")).distinct()
    near = stored(paired(stars), "minhash-near")
    tried = near.groupBy("b").agg(F.max_by("a", "share").alias("a")).select("a", "b")
    links = verified(tried)
    places = components(links)
    at = split(places, members.drop("hub"))

    few = at.where(F.col("m") <= CROWD)
    other = few.select("bucket", F.col("set_key").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"))
    rest = few.withColumnRenamed("set_key", "a").join(other, "bucket").where(
        (F.col("a") < F.col("b")) & (F.col("root") != F.col("root_b"))
        & (F.least("n", "n_b") * 100 >= F.greatest("n", "n_b") * percent))
    rest = stored(paired(rest.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")).select("a", "b"), "minhash-rest")
    late = [verified(rest)] if rest.limit(1).count() else []

    crowds = at.where(F.col("m") > CROWD)
    if crowds.limit(1).count():
        held = sets_of(crowds.select("set_key").distinct()).join(classes.select("set_key", "sig", "bands"), "set_key")
        chunks = F.ceil(F.col("m") / F.lit(CHUNK))
        rows_of = crowds.select("bucket", "set_key", "root", chunks.alias("chunks")).join(held, "set_key")
        rows_of = rows_of.withColumn("chunk", F.pmod(F.xxhash64("set_key", "bucket"), F.col("chunks")))
        rows_of = rows_of.withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        rows_of = rows_of.select("bucket", F.least("chunk", "mate").alias("lo"), F.greatest("chunk", "mate").alias("hi"),
                                 "chunk", "set_key", "root", "sig", "bands", "hashes")
        late.append(stored(rows_of.groupBy("bucket", "lo", "hi").applyInArrow(
            _crowd(rows, bands, percent, margin), "a binary, b binary"), "minhash-links"))
    for more in late:
        links = links.unionByName(more)
    if late:
        places = components(links)

    named = classes.select("set_key", F.col("rep.d").alias("d")).join(
        places.withColumnRenamed("node", "set_key"), "set_key", "left")
    named = named.withColumn("root", F.coalesce("root", "set_key"))
    smallest = named.groupBy("root").agg(F.min("d").alias("component"))
    named = named.join(smallest, "root").select("set_key", "component", "root")
    alone = F.col("n_shingles") == 0
    own = F.coalesce("doc_id", F.lit(2**63 - 1))
    found = signed.select("doc_id", "text_key", "n_shingles", F.when(~alone, F.col("set_key")).alias("set_key")).join(named, "set_key", "left")
    component = F.when(alone, own).otherwise(F.col("component"))
    return found.select(
        "doc_id", "n_shingles",
        F.when(component < 2**63 - 1, component).alias("component_id"),
        (component == own).alias("kept"),
        *(["text_key", "root"] if keys else []))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 2-word shingles, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
         ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 80 * (na.n_shingles + nb.n_shingles - c)),
reach AS (
  SELECT doc_id, doc_id AS other FROM n
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""
