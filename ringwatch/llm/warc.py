"""WARC archives as a PySpark data source, and an archive with revisits from a table of pages.

``spark.read.format("warc").load(folder)`` gives a row per record: its type, target, id, date,
what it refers to, content type, payload length and digest, all headers as a map, and the payload.
Columns not asked for are not decoded; filters on ``record_type``, ``target_uri``, ``record_id``
and ``date`` are judged on the headers alone, and the payload of a record that they reject is
passed over. (Filter push-down into Python data sources is off unless
``spark.sql.python.filterPushdown.enabled`` is set; :func:`read_archive` sets it.)

A file is read by one task, or by several if it has an index: the writer puts a file
``<name>.idx`` beside each archive file, with the place of a record about every ``SPLIT`` bytes.
Files are opened with ``pyarrow.fs``, so ``path`` may lie in any store that it knows. Records are
single gzip members, or plain in files whose name doesn't end in ``.gz``.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage)

from ringwatch.llm.base import stored, table
from ringwatch.scratch import new_folder

SPLIT = 32 << 20
LEAST = 1000
_PIECE = 1 << 16
# a gzip header with one extra field "sl": the member's length and that of its plain bytes
_SKIP = struct.Struct("<3sBIBBH2sHII")
_SCHEMA = ("record_type string, target_uri string, record_id string, date string, refers_to string, content_type string, "
           "content_length long, payload_digest string, headers map<string,string>, payload binary")
_HEADERS = {"record_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id", "date": "warc-date",
            "refers_to": "warc-refers-to", "content_type": "content-type", "payload_digest": "warc-payload-digest"}
_PUSHED = {"record_type", "target_uri", "record_id", "date"}


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class _Part(InputPartition):
    """Records of a file that begin from ``begin`` up to before ``end`` (its size, or none if not known)."""

    path: str
    begin: int
    end: int | None


class _Bytes:
    """The plain bytes of a file from one place on, whether its records are gzip members or not.

    A member whose header tells its length is left by a seek; of one that does not, the rest is
    inflated in pieces that are not kept.
    """

    def __init__(self, file, packed: bool):
        self.file, self.packed = io.BufferedReader(file, _PIECE), packed
        self.have, self.pos = bytearray(), 0
        self.end: int | None = None
        self.unpack = None

    def begin(self) -> int | None:
        """Place of the next record; none at the end of the file."""
        if not self.packed:
            return self.file.tell() - self._left() if self._fill(1) else None
        if self.unpack is not None:
            if self.end is None:
                while not self.unpack.eof:
                    self._drop()
                    if not self._more():
                        return None
                self.end = self.file.tell() - len(self.unpack.unused_data)
            self.file.seek(self.end)
        place = self.file.tell()
        head = self.file.read(_SKIP.size)
        if not head:
            return None
        self.end = None
        if len(head) == _SKIP.size:
            magic, flags, _, _, _, extra, name, size, length, _ = _SKIP.unpack(head)
            if (magic, extra, name, size) == (b"\x1f\x8b\x08", 12, b"sl", 8) and flags == 4 and length > _SKIP.size:
                self.end = place + length
        self.file.seek(place)
        self._drop()
        self.unpack = zlib.decompressobj(31)
        return place

    def _left(self) -> int:
        return len(self.have) - self.pos

    def _drop(self) -> None:
        self.have, self.pos = bytearray(), 0

    def _more(self) -> bool:
        if self.pos > _PIECE:
            del self.have[: self.pos]
            self.pos = 0
        if not self.packed:
            data = self.file.read(_PIECE)
            self.have += data
            return bool(data)
        data = self.unpack.unconsumed_tail or self.file.read(_PIECE // 8)
        plain = self.unpack.decompress(data, _PIECE)
        self.have += plain
        return bool(data or plain)

    def _fill(self, n: int) -> bool:
        while self._left() < n:
            if (self.packed and self.unpack.eof) or not self._more():
                return False
        return True

    def line(self) -> bytes:
        seen = 0
        while (at := self.have.find(b"\n", self.pos + seen)) < 0:
            seen = self._left()
            if not self._fill(seen + 1):
                at = len(self.have) - 1
                break
        line = bytes(self.have[self.pos : at + 1])
        self.pos = at + 1
        return line.rstrip(b"\r\n")

    def take(self, n: int) -> bytes:
        self._fill(n)
        data = bytes(self.have[self.pos : self.pos + n])
        self.pos += len(data)
        return data

    def skip(self, n: int) -> None:
        """Pass over ``n`` bytes without keeping them; in a member the next :meth:`begin` passes over the rest."""
        if self.packed:
            return
        own = min(n, self._left())
        self.pos += own
        self.file.seek(n - own, 1)


def records(file, packed: bool, end: int | None, wanted, with_payload: bool):
    """Headers (names in lower case) and payload of the records that begin before ``end``.

    ``wanted`` judges the headers; payloads of records that it rejects, or all without
    ``with_payload``, are passed over. A file that stops within a record ends with the one before.
    """
    stream = _Bytes(file, packed)
    while (place := stream.begin()) is not None and (end is None or place < end):
        first = stream.line()
        if not first.startswith(b"WARC/"):
            if not first and not packed:
                continue
            return
        headers: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", 0))
        if wanted(headers):
            payload = stream.take(size) if with_payload else None
            if with_payload and len(payload) < size:
                return
            if not with_payload:
                stream.skip(size)
            yield headers, payload
        else:
            stream.skip(size)
        if not packed:
            stream.skip(4)


class WarcSource(DataSource):
    """Options: ``path`` (a folder or file), for writing also ``compression`` (``gzip`` or ``none``),
    and ``payload`` (``true`` by default; ``false`` leaves payloads out when reading)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("split", SPLIT))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _PUSHED and isinstance(f, EqualTo):
                self.tests.append(("in", _HEADERS[column], (f.value,)))
            elif column in _PUSHED and isinstance(f, In):
                self.tests.append(("in", _HEADERS[column], tuple(f.value)))
            elif column in _PUSHED and isinstance(f, StringStartsWith):
                self.tests.append(("starts", _HEADERS[column], (f.value,)))
            else:
                yield f

    def partitions(self):
        store, root = _store(self.path)
        info = store.get_file_info(root)
        if info.type == pafs.FileType.File:
            files = [info]
        else:
            files = store.get_file_info(pafs.FileSelector(root, recursive=True))
        names = {f.path: f for f in files if f.type == pafs.FileType.File}
        parts = []
        for path, f in sorted(names.items()):
            if not path.endswith((".warc", ".warc.gz")):
                continue
            places = [0]
            if f"{path}.idx" in names:
                with store.open_input_stream(f"{path}.idx") as index:
                    places = [int(x) for x in index.read().split()] or [0]
            for begin, end in zip(places, [*places[1:], f.size]):
                parts.append(_Part(path, begin, end))
        return parts or [_Part("", 0, 0)]

    def read(self, partition: _Part):
        if not partition.path:
            return
        store, _ = _store(self.path)

        def wanted(headers: dict[str, str]) -> bool:
            for kind, name, values in self.tests:
                value = headers.get(name)
                if value is None or not (value in values if kind == "in" else value.startswith(values[0])):
                    return False
            return True

        fields = list(_HEADERS)
        rows: list[tuple] = []
        held = 0
        with store.open_input_file(partition.path) as file:
            file.seek(partition.begin)
            for headers, payload in records(file, partition.path.endswith(".gz"), partition.end, wanted, self.with_payload):
                rows.append((headers, payload))
                held += len(payload or b"") + 500
                if held > 4 << 20:
                    yield self._batch(fields, rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(fields, rows)

    def _batch(self, fields: list[str], rows: list[tuple]) -> pa.RecordBatch:
        text = {c: pa.array([h.get(_HEADERS[c]) for h, _ in rows], pa.string()) for c in fields}
        return pa.RecordBatch.from_pydict({
            **{c: text[c] for c in fields[:6]},
            "content_length": pa.array([int(h.get("content-length", 0)) for h, _ in rows], pa.int64()),
            "payload_digest": text["payload_digest"],
            "headers": pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string())),
            "payload": pa.array([p for _, p in rows], pa.binary())})


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class WarcWriter(DataSourceArrowWriter):
    """Writes rows ``headers map<string,string>, payload binary`` as records; one file a task.

    A task writes under a name that readers pass over and the driver gives it its own when all are
    there, so a repeated task leaves no records twice.
    """

    def __init__(self, options):
        self.path = options["path"]
        self.packed = options.get("compression", "gzip") == "gzip"
        self.split = int(options.get("split", SPLIT))

    def write(self, iterator) -> _Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}"
        places, at, last = [], 0, None
        with store.open_output_stream(f"{name}.tmp", compression=None) as out:
            for batch in iterator:
                for headers, payload in zip(batch.column("headers").to_pylist(), batch.column("payload")):
                    data = record(dict(headers), payload.as_py() or b"")
                    if self.packed:
                        data = member(data)
                    if last is None or at - last >= self.split:
                        places.append(at)
                        last = at
                    out.write(data)
                    at += len(data)
        if not places:
            store.delete_file(f"{name}.tmp")
            return _Written(None)
        with store.open_output_stream(f"{name}.idx.tmp", compression=None) as out:
            out.write("\n".join(map(str, places)).encode())
        return _Written(name)

    def commit(self, messages) -> None:
        store, _ = _store(self.path)
        for message in messages:
            if message is not None and message.path:
                store.move(f"{message.path}.idx.tmp", f"{message.path}.idx")
                store.move(f"{message.path}.tmp", message.path)

    def abort(self, messages) -> None:
        store, _ = _store(self.path)
        for message in messages:
            if message is not None and message.path:
                store.delete_file(f"{message.path}.idx.tmp")
                store.delete_file(f"{message.path}.tmp")


def record(headers: dict[str, str], payload: bytes) -> bytes:
    """The bytes of one record."""
    lines = [f"{k}: {' '.join(v.split())}" for k, v in headers.items() if v is not None]
    lines.append(f"Content-Length: {len(payload)}")
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that tells its own length in an extra field, so that readers can seek past it."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    size = _SKIP.size + len(body) + 8
    if max(size, len(data)) < 1 << 32:
        head = _SKIP.pack(b"\x1f\x8b\x08", 4, 0, 0, 255, 12, b"sl", 8, size, len(data))
    else:
        head = struct.pack("<3sBIBB", b"\x1f\x8b\x08", 0, 0, 0, 255)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def archive_rows(pages: DataFrame, date: str = "2020-01-01T00:00:00Z", least: int = LEAST) -> DataFrame:
    """Records of ``pages`` (``page_id, url, html``) as rows for the writer.

    Of pages with equal payloads of at least ``least`` bytes, that of the largest page_id is the
    response; the others are revisits of it, without payload. Payloads are equal if their size,
    SHA-1 and SHA-256 are. Rows that repeat its page_id are responses too. A null html is an empty
    payload, a null url no target. Pages without an id are responses.

    Groups are found on ids and digests alone, and a page then asks by its own id and digest
    whether it is a revisit: a payload that very many pages share is no key that payloads meet by.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "strong": F.unhex(F.sha2("payload", 256)), "size": F.length("payload").cast("long")})
    same = ["digest", "strong", "size"]
    light = stored(rows.where((F.col("size") >= least) & F.col("page_id").isNotNull()).select("page_id", *same).distinct(), "page-digests")
    groups = light.groupBy(*same).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = light.join(groups, same).where("page_id <> first")
    rows = rows.join(revisits, ["page_id", *same], "left")
    again = F.col("first").isNotNull()
    names = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    headers = {
        "WARC-Type": F.when(again, "revisit").otherwise("response"),
        "WARC-Record-ID": names(F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        "WARC-Date": F.lit(date),
        "WARC-Target-URI": F.col("url"),
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), _base32(F.col("digest"))),
        "WARC-Refers-To": F.when(again, names(F.col("first").cast("string"))),
        "WARC-Profile": F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        "WARC-Payload-Length": F.col("size").cast("string"),
        "Content-Type": F.lit("text/html; charset=utf-8"),
    }
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in headers]), F.array(*headers.values()))
    return rows.select(F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("headers"),
                       F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))


def _base32(digest):
    """Base 32, as archives have digests, of 40 hexadecimal digits: five at a time give four letters."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 2), 20, "0") for k in range(8)])
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[F.substring(alphabet, F.conv(F.substring(bits, 1 + 5 * k, 5), 2, 10).cast("int") + 1, F.lit(1)) for k in range(32)])


def write_archive(rows: DataFrame, path: str, compression: str = "gzip", split: int = SPLIT) -> None:
    """Write rows ``headers, payload`` as archive files in a folder that all executors reach."""
    rows.sparkSession.dataSource.register(WarcSource)
    rows.select("headers", "payload").write.format("warc").option("compression", compression).option("split", split).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row per record of the archives in a folder, with filters pushed into the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back: sizes and digests of all payloads, and revisits."""
    path = new_folder(spark, "warc")
    write_archive(archive_rows(table(spark, sf_dir, "pages")), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    id_of = lambda c: F.when(page(c) != "", page(c)).cast("long")
    responses = read_archive(spark, path).where("record_type = 'response'").select(
        id_of("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read_archive(spark, path, payload=False).where("record_type = 'revisit'").select(
        id_of("record_id").alias("page_id"), F.col("headers")["warc-payload-length"].cast("long").alias("payload_bytes"),
        _hex(F.col("payload_digest")).alias("payload_digest"), "record_type", id_of("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)


def _hex(digest):
    """Hexadecimal digits of a ``sha1:`` header in base 32."""
    letters = F.substring(digest, 6, 32)
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    bits = F.concat(*[F.lpad(F.conv((F.instr(alphabet, F.substring(letters, 1 + k, 1)) - 1).cast("string"), 10, 2), 5, "0") for k in range(32)])
    return F.lower(F.concat(*[F.lpad(F.conv(F.substring(bits, 1 + 20 * k, 20), 2, 16), 5, "0") for k in range(8)]))


OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, n) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND first <> page_id THEN first END AS refers_to
FROM g
"""
