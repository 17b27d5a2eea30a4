"""Repeated byte passages by column-wise construction of aligned suffix arrays.

A passage of ``length`` bytes counts as repeated if it starts anywhere else, in the same or
another document. The construction takes one symbol per string and round, the last column
first: a round regroups the strings by their next symbol, stably, so that they stay sorted by
the suffix that starts in this column, and renews the common prefixes of neighbours from the
minima of the former ones. Every round passes once over arrays in order; nothing is compared.

Inserting whole documents that way takes as many rounds as the longest has bytes, each over
all that was inserted before. Here the strings are cut so that ``2 * length - seed`` rounds
are enough and columns needn't be merged with each other: every passage has a *seed*, the
``seed`` bytes of smallest hash within it (the leftmost of equal ones). Equal passages have
equal seeds in the same place, so a passage can only recur around the same seed. The string of
a seed holds all passages around it: ``length - seed`` bytes before it, ``length`` from its start.

* Strings are equal to others in most copies; those are repeated as a whole and sorted once.
* Strings of seeds that occur but once, as most do, are not even cut out.
* Seeds with more than ``most`` different strings aren't sorted in one task. Their columns are
  halved and the strings dealt anew by the bytes that all passages of a half have in common, again
  and again where groups stay too large. Of strings that are equal in a half, one goes on.

Seeds and strings are named by 64-bit hashes. Equal names of different seeds do no harm, since the
sort compares bytes; of strings, those whose hashes are equal are taken to be so (a chance of
about n**2 / 2**65 for n strings).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.llm.base import stored, table
from ringwatch.llm.shingles import mix64, pieces, text_bytes, word_spans

LENGTH = 400
SEED = 64
#: Different strings that one task sorts together.
BATCH = 8192
#: Different strings of one seed up to which they are sorted in one task.
MOST = 8192
_END = 255  # outside the document; no byte of UTF-8
_BITS = 24
_LOW = np.uint64((1 << _BITS) - 1)
_TURN = 0x9E3779B97F4A7C15
_OTHER = 0xC2B2AE3D27D4EB4F
_PIECE = 1 << 23


def _runs(raw: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of the ``width`` bytes (a power of two) from each place that has so many."""
    value = raw.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < width:
        value = value[:-step] * np.uint64(pow(base, step, 2**64)) + value[step:]
        step *= 2
    return mix64(value)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` keys in a row."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.uint64(2**64 - 1), dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def seeds_of(raw: np.ndarray, ends: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the seeds of all passages start, and the seeds' hashes. ``ends`` bounds the documents."""
    if len(raw) > 2 * _PIECE:  # one very long document, in overlapping parts
        found = []
        for at in range(0, len(raw) - length + 1, _PIECE):
            part = raw[at : at + _PIECE + length - 1]
            place, value = seeds_of(part, np.array([0, len(part)]), length, seed)
            found.append((place + at, value))
        place = np.concatenate([x for x, _ in found])
        place, first = np.unique(place, return_index=True)
        return place, np.concatenate([x for _, x in found])[first]
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if len(raw) < length:
        return none
    value = _runs(raw, seed, _TURN)
    keys = (value & ~_LOW) | np.arange(len(value), dtype=np.uint64)
    least = _least(keys, length - seed + 1)
    inside = np.zeros(len(raw) + 1, dtype=np.int32)
    long = np.flatnonzero(np.diff(ends) >= length)
    np.add.at(inside, ends[long], 1)
    np.add.at(inside, ends[long + 1] - length + 1, -1)
    least = least[np.cumsum(inside)[: len(least)] > 0]
    if not len(least):
        return none
    place = np.unique((least & _LOW).astype(np.int64))
    return place, value[place]


_SEEDS = pa.schema([("seed", pa.int64()), ("string", pa.int64()), ("doc", pa.int64()), ("text_key", pa.int64()), ("place", pa.int64())])


def _seeded(length: int, seed: int):
    """A row for each seed: its hash, the hash of its string, and where it stands."""
    before = length - seed

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for first, last in pieces(texts, 500_000):
                raw, ends = text_bytes(texts.slice(first, last - first))
                place, value = seeds_of(raw, ends, length, seed)
                if not len(place):
                    continue
                text = np.searchsorted(ends, place, side="right") - 1
                lo = np.maximum(place - before, ends[text])
                hi = np.minimum(place + length, ends[text + 1])
                # the string from runs of 64 bytes, the last one overlapping the one before
                string = mix64((place - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - place).astype(np.uint64))
                runs = _runs(raw, 64, _OTHER)
                for k in range(0, length + before, 64):
                    at = np.minimum(lo + k, hi - 64)
                    string = mix64(string ^ runs[at])
                docs, keys = (batch.column(c).to_numpy()[first:last] for c in ("doc", "text_key"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(string.view(np.int64)), pa.array(docs[text]),
                     pa.array(keys[text]), pa.array(place - ends[text])], schema=_SEEDS)

    return run


def _strings(length: int, seed: int):
    """The bytes of the wanted seeds' strings; places outside the document are 0xFF."""
    before = length - seed
    width = length + before

    def run(batches):
        for batch in batches:
            out = {"seed": [], "string": [], "place": [], "single": [], "hot": [], "bytes": []}
            rows: list[int] = []
            size = 0
            for n, (text, wanted) in enumerate(zip(batch.column("text"), batch.column("wanted").to_pylist())):
                raw = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                for w in wanted:
                    lo, hi = max(0, w["place"] - before), min(len(raw), w["place"] + length)
                    string = np.full(width, _END, dtype=np.uint8)
                    string[lo - (w["place"] - before) : hi - (w["place"] - before)] = raw[lo:hi]
                    for k in ("seed", "string", "place", "single", "hot"):
                        out[k].append(w[k])
                    out["bytes"].append(string.tobytes())
                    rows.append(n)
                size += len(wanted)
                if size >= 4096:
                    yield _string_rows(batch, rows, out)
                    out, rows, size = {k: [] for k in out}, [], 0
            if rows:
                yield _string_rows(batch, rows, out)

    return run


def _string_rows(batch: pa.RecordBatch, rows: list[int], out: dict) -> pa.RecordBatch:
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(out["seed"], pa.int64()), batch.column("doc").take(at), batch.column("text_key").take(at),
         pa.array(out["place"], pa.int64()), pa.array(out["single"], pa.bool_()), pa.array(out["hot"], pa.bool_()),
         pa.array(out["bytes"], pa.binary())],
        names=["seed", "doc", "text_key", "place", "single", "hot", "bytes"])


_STRINGS = "seed long, doc long, text_key long, place long, single boolean, hot boolean, bytes binary"


def repeated_columns(rows: np.ndarray, length: int) -> np.ndarray:
    """For each string and column whether the ``length`` symbols from there recur in this column.

    ``rows`` are strings of equal width, one symbol a byte; 0xFF equals nothing.
    """
    n, width = rows.shape
    found = np.zeros((n, width - length + 1), dtype=bool)
    if n < 2:
        return found
    columns = np.ascontiguousarray(rows.T)
    order = np.arange(n)
    common = np.zeros(n, dtype=np.int16)  # with the string before, in the current order
    for c in range(width - 1, -1, -1):
        symbol = columns[c][order]
        turn = np.argsort(symbol, kind="stable")
        sorted_symbols = symbol[turn]
        same = np.empty(n, dtype=bool)
        same[0] = False
        np.equal(sorted_symbols[1:], sorted_symbols[:-1], out=same[1:])
        same &= sorted_symbols != _END
        at = np.flatnonzero(same)
        renewed = np.zeros(n, dtype=np.int16)
        if len(at):
            lo, hi = turn[at - 1] + 1, turn[at]  # least common prefix between two old places
            renewed[at] = np.minimum(_range_min(common, lo, hi) + 1, length)
        order, common = order[turn], renewed
        if c < found.shape[1]:
            full = common >= length
            full[:-1] |= full[1:]
            found[order[full], c] = True
    return found


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of ``values[lo .. hi]`` for each pair."""
    span = hi - lo + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(lo), dtype=values.dtype)
    table_row = values
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table_row = np.minimum(table_row[:-half], table_row[half:])
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table_row[lo[at]], table_row[hi[at] - (1 << k) + 1])
    return out


_FOUND = pa.schema([("doc", pa.int64()), ("text_key", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _spans(found: np.ndarray, place: np.ndarray, before: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the bytes that the found passages of each row cover."""
    edge = np.zeros((len(found), found.shape[1] + 2), dtype=np.int8)
    edge[:, 1:-1] = found
    change = np.diff(edge, axis=1)
    row, first = np.nonzero(change == 1)
    _, last = np.nonzero(change == -1)
    return row, place[row] - before + first, place[row] - before + last - 1 + length


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Strings of one width as rows of bytes, without a copy of the column."""
    column = column.combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _sorted(length: int, seed: int):
    """Spans of the strings of one batch of seeds."""
    before = length - seed

    def run(rows):
        if not rows.num_rows:
            return _FOUND.empty_table()
        out = []
        lo, hi = rows.column("lo").to_numpy(), rows.column("hi").to_numpy()
        for first, last in sorted({*zip(lo.tolist(), hi.tolist())}):
            part = rows.filter(pa.array((lo == first) & (hi == last)))
            strings = _matrix(part.column("bytes"))[:, first : last + length]
            found = repeated_columns(strings, length)
            found &= part.column("single").to_numpy(zero_copy_only=False)[:, None]
            row, begin, end = _spans(found, part.column("place").to_numpy() + first, before, length)
            at = pa.array(row)
            out.append(pa.Table.from_arrays([part.column("doc").take(at), part.column("text_key").take(at), pa.array(begin), pa.array(end)], schema=_FOUND))
        return pa.concat_tables(out)

    return run


def _halves(cut: DataFrame, length: int) -> DataFrame:
    """Rows for either half of the columns from ``lo`` to ``hi``, with a new ``key`` and ``string``.

    All passages that start in these columns hold the core from ``hi`` to ``lo + length``; equal ones have equal
    cores, whose hash is the ``key``. ``string`` is the hash of all bytes of these passages. Rows whose core
    leaves the document hold no passage and go.
    """
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi"))))
    rows = cut.drop("key").withColumn("half", halves).withColumns({"lo": F.col("half.lo"), "hi": F.col("half.hi")}).drop("half").where("lo <= hi")
    core = F.substring(F.col("bytes"), F.col("hi") + 1, F.col("lo") + length - F.col("hi"))
    rows = rows.withColumn("core", core).where(~F.contains("core", F.lit(bytes([_END]))))
    own = F.substring(F.col("bytes"), F.col("lo") + 1, F.col("hi") + length - F.col("lo"))
    return rows.withColumns({"key": F.xxhash64("core", "lo", "hi"), "string": F.xxhash64(own, F.col("lo"), F.col("hi"))}).drop("core")


def _split(hot: DataFrame, length: int, before: int, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Strings of hot seeds in groups of at most ``most`` different ones, and the spans of equal ones.

    Each round halves the columns of the strings whose groups are too large and deals them anew by
    what all passages of a half have in common. Strings that are equal in a half are repeated there as a
    whole, and one of them goes on, so that many near copies shrink to their differences; in a single
    column nothing but equal ones are left.
    """
    groups, spans = [], []
    place = ["doc", "text_key", "place"]
    while hot is not None:
        rows = stored(_halves(hot, length), "suffix-halves")
        names = stored(rows.groupBy("key", "string").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("first")), "suffix-names")
        begin = F.col("place") - before
        spans.append(rows.where("single").select("key", "string", *place, "lo", "hi").join(names.where("n > 1").select("key", "string"), ["key", "string"]).select(
            "doc", "text_key", F.greatest(begin + F.col("lo"), F.lit(0)).alias("begin"), (begin + F.col("hi") + length).alias("end")))
        sizes = stored(names.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "suffix-sizes")
        once = names.join(sizes, "key").select("key", "m", "n", *[F.col(f"first.{c}").alias(c) for c in place])
        left = stored(rows.drop("string").join(once, ["key", *place]).withColumn("single", F.col("single") & (F.col("n") == 1)).drop("n"), "suffix-left")
        groups.append(left.where(F.col("m") <= most).drop("m"))
        hot = left.where(F.col("m") > most).drop("m")
        hot = hot if hot.limit(1).count() else None
    return groups, spans


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, batch: int = BATCH, most: int = MOST) -> DataFrame:
    """``doc, text_key, spans``: for each text of ``docs`` with repeated passages the bytes they cover.

    ``docs`` has ``doc, text_key, text``; ``spans`` is an array of ``struct<begin, end>`` in bytes,
    maximal and in order. ``seed`` is a power of two up to ``length``. Texts shorter than ``length``
    have no passages. A row that repeats another is a copy like any other.
    """
    before = length - seed
    seeds = stored(docs.mapInArrow(_seeded(length, seed), "seed long, string long, doc long, text_key long, place long"), "suffix-seeds")
    strings = stored(
        seeds.groupBy("seed", "string").agg(F.count("*").alias("n"), F.min(F.struct("doc", "text_key", "place")).alias("first")),
        "suffix-strings")
    shared = stored(strings.groupBy("seed").agg(F.count("*").alias("m")).where("m > 1"), "suffix-shared")
    size = F.lit(max(1, shared.agg(F.sum("m")).first()[0] or 0))

    copies = seeds.join(strings.where("n > 1").select("seed", "string"), ["seed", "string"])
    members = strings.join(shared, "seed").select(
        F.col("first.doc").alias("doc"), F.col("first.text_key").alias("text_key"),
        F.struct("seed", "string", F.col("first.place").alias("place"), (F.col("n") == 1).alias("single"), (F.col("m") > most).alias("hot")).alias("w"))
    wanted = members.groupBy("doc", "text_key").agg(F.collect_list("w").alias("wanted"))
    cut = docs.join(wanted, ["doc", "text_key"]).mapInArrow(_strings(length, seed), _STRINGS)
    cut = stored(cut, "suffix-cut")

    # strings bear whether their seed is hot, so that they are not shuffled to tell
    whole = {"key": F.col("seed"), "lo": F.lit(0), "hi": F.lit(before)}
    sorts = cut.where(~F.col("hot")).withColumns(whole).drop("seed", "hot")
    spans = None
    if shared.where(F.col("m") > most).limit(1).count():
        groups, equal = _split(cut.where("hot").withColumns(whole).drop("seed", "hot"), length, before, most)
        for part in groups:
            sorts = sorts.unionByName(part)
        for part in equal:
            spans = part if spans is None else spans.unionByName(part)
    tasks = F.ceil(size / F.lit(batch))
    sorts = sorts.withColumn("task", F.pmod(F.xxhash64("key", "lo"), tasks))
    found = sorts.groupBy("task").applyInArrow(_sorted(length, seed), "doc long, text_key long, begin long, end long")
    spans = found if spans is None else spans.unionByName(found)

    bounds = copies.select(
        "doc", "text_key", F.greatest(F.col("place") - before, F.lit(0)).alias("begin"), (F.col("place") + length).alias("end"))
    return stored(spans.unionByName(bounds).groupBy("doc", "text_key").agg(
        F.collect_set(F.struct("begin", "end")).alias("spans")), "suffix-spans")


_SHORT = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("text_key", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _short(words: int, length: int):
    """A row for each run of ``words`` whole words in fewer than ``length`` bytes: 128 bits of its hash, and where it stands."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for first, last in pieces(texts):
                raw, ends = text_bytes(texts.slice(first, last - first))
                start, stop, text = word_spans(raw, ends)
                if len(start) < words:
                    continue
                lo, hi, own = start[: len(start) - words + 1], stop[words - 1 :], text[words - 1 :]
                found = np.flatnonzero((text[: len(own)] == own) & (hi - lo < length))
                data = raw.tobytes()
                docs, keys = (batch.column(c).to_numpy()[first:last] for c in ("doc", "text_key"))
                for k in range(0, len(found), 1 << 16):
                    at = found[k : k + (1 << 16)]
                    hashes = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(lo[at].tolist(), hi[at].tolist()))
                    h1, h2 = np.frombuffer(hashes, dtype=np.int64).reshape(-1, 2).T.copy()
                    home = ends[own[at]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h1), pa.array(h2), pa.array(docs[own[at]]), pa.array(keys[own[at]]),
                         pa.array(lo[at] - home), pa.array(hi[at] - home)], schema=_SHORT)

    return run


def repeated_words(docs: DataFrame, words: int, length: int) -> DataFrame:
    """``doc, text_key, short``: the repeated runs of ``words`` words that ``repeated_spans`` can't see.

    Of ``docs`` as there; these are runs of fewer than ``length`` bytes, the same bytes in both places.
    They are counted by 128 bits of hash, a plain grouping with partial sums.
    """
    runs = stored(docs.mapInArrow(_short(words, length), "h1 long, h2 long, doc long, text_key long, begin long, end long"), "suffix-short")
    often = runs.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    return runs.join(often, ["h1", "h2"]).groupBy("doc", "text_key").agg(F.collect_set(F.struct("begin", "end")).alias("short"))


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _without(with_bytes: bool, length: int, carried: tuple[str, ...]):
    own = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for text, spans, short in zip(batch.column("text"), batch.column("spans").to_pylist(), batch.column("short").to_pylist()):
                raw = text.as_buffer()
                size = raw.size if raw is not None else 0
                merged: list[list[int]] = []
                # a string cut short by the document's end is no passage
                whole = [(s["begin"], min(s["end"], size)) for s in spans or () if min(s["end"], size) - s["begin"] >= length]
                for begin, end in sorted(whole + [(s["begin"], s["end"]) for s in short or ()]):
                    if merged and begin <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([begin, end])
                kept, at = [], 0
                view = memoryview(raw) if size else memoryview(b"")
                for begin, end in merged:
                    kept.append(view[at:begin])
                    at = end
                kept.append(view[at:size])
                kept = b"".join(kept)
                out.append((size, size - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            columns = [pa.array([x[k] for x in out], own.field(k + 1).type) for k in range(5)]
            schema = pa.schema([*own, *(batch.schema.field(c) for c in carried)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *(batch.column(c) for c in carried)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, batch: int = BATCH, most: int = MOST,
                   with_bytes: bool = True, words: int | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """Each row of ``docs`` without the bytes that repeated passages cover.

    With ``words``, so many whole words that stand twice are a passage also in fewer than ``length`` bytes.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``. Texts are taken as UTF-8,
    nulls as empty; every occurrence of a passage goes, the first one too. Rows that repeat others
    are copies like any other and all come back. ``kept`` (null without ``with_bytes``) may begin or
    end inside a character. ``columns`` names further columns to return; others are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns)
    own = own.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("text_key"), *columns)
    spans = repeated_spans(own.select("doc", "text_key", "text"), length, seed, batch, most)
    rows = own.join(spans, ["doc", "text_key"], "left")
    if words:
        rows = rows.join(repeated_words(own.select("doc", "text_key", "text"), words, length), ["doc", "text_key"], "left")
    else:
        rows = rows.withColumn("short", F.lit(None).cast("array<struct<begin:long,end:long>>"))
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return rows.select("doc_id", "text", "spans", "short", *columns).mapInArrow(_without(with_bytes, length, columns), _CUT + kinds)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of repeated 400-byte passages.

    ``text`` is what remains; bytes of a character that a passage cuts stand as the replacement character.
    """
    left = remove_repeats(table(spark, sf_dir, "documents"), 400)
    return left.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
