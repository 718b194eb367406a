"""WARC archives as a Python data source, with identical-payload revisit records.

``spark.read.format("warc").load(folder)`` plans one partition a file; writers begin a new file at ``file_bytes`` (512 MB unless given).  A record's headers are parsed first; filters on
record type, headers and the ids in them (=, in, starts with, is not null) that Spark pushes down are tried on them, and the block of a record
that fails is skipped by seeking over its Content-Length (in our .warc.gz files, over its gzip member, whose length is in its
``sl`` field), never read, inflated or decoded.  Options: ``payload`` (default true)
false also skips the blocks of wanted records; ``verify`` true checks the digest of each payload that is read.

``df.write.format("warc").save(folder)`` takes page_id, url, payload, digest, refers_to, revisit: a revisit refers to the page
``refers_to`` (null: one without an id) and holds the HTTP headers (with the length of the payload) and no payload.  Tasks write files under names of
their own, plain or with ``compression`` gzip as one member a record; ``_manifest.json`` lists those of the tasks that the driver saw finish, and only these are read.  Folders of
archives from elsewhere, without a manifest, are read by their ``.warc`` and ``.warc.gz`` files, in subfolders too; the path may be one file.  In them a header that goes on in the next line is
one header, one that is no UTF-8 is Latin-1, ``payload_digest`` is bare for sha1 and as it stands for others, ``verify`` tries sha1, sha256, sha512 and md5 and
passes records without a digest; a record without a length is an error.

Nulls: a null payload is empty; null page_ids and urls have no header and come back null.  Repeated rows are written
each: of equal payloads, one row with the least page_id (null last; then by least url) is the response, also where rows share the id.  ``target_uri`` comes back as the header holds it,
with characters that a URI does not allow percent-encoded.  Very long payloads are one record each.  Columns of pages
other than page_id, url and html are ignored.  Empty table: no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from quillspan.llm.shared import file_system, shared_folder

SCHEMA = "page_id long, record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to long, payload_bytes long, payload binary"
# Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "page_id": "warc-record-id", "refers_to": "warc-refers-to"}
_URN = "urn:page:"


def _value(head: dict[str, str], column: str) -> str | int | None:
    """A header as its column gives it: digests without the name of their method, ids as numbers."""
    x = head.get(_HEADERS[column])
    if x is None:
        return None
    if column in ("page_id", "refers_to"):
        x = x.strip("<>").removeprefix(_URN)
        return int(x) if x.removeprefix("-").isdecimal() else None
    return x.removeprefix("sha1:") or None if column == "payload_digest" else x


def _text(line: bytes) -> str:
    try:
        return line.decode()
    except UnicodeDecodeError:
        return line.decode("latin-1")


def _agrees(payload: bytes, digest: str | None) -> bool:
    """Whether a payload has the digest that a header names (in base 32 or hex); one without a digest, or by a method not known here, is not tried."""
    method, _, value = (digest or "").partition(":")
    method = method.strip().lower().replace("-", "")
    if not value or method not in ("sha1", "sha256", "sha512", "md5"):
        return True
    found = hashlib.new(method, payload, usedforsecurity=False)
    return value.strip().rstrip("=").upper() in (base64.b32encode(found.digest()).decode().rstrip("="), found.hexdigest().upper())


def _record(page_id, url, payload: bytes, digest: str, refers_to, date: str, revisit: bool | None = None) -> bytes:
    revisit = refers_to is not None if revisit is None else revisit
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{'none' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files  # (name, records)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.gzip, self.date = options["path"], options.get("compression") == "gzip", options.get("date", "2000-01-01T00:00:00Z")
        self.most = int(options.get("file_bytes", 512 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, folder = file_system(self.folder)
        files: list[tuple[str, int]] = []
        out, n, size, name = None, 0, 0, ""
        for batch in iterator:
            for low in range(0, batch.num_rows, 256):
                rows = [batch.slice(low, 256).column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit")]
                for page_id, url, payload, digest, refers_to, revisit in zip(*rows, strict=True):
                    if out is not None and size >= self.most:
                        out.close()
                        files.append((name, n))
                        out = None
                    if out is None:
                        fs.create_dir(folder)
                        name, n, size = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip, 0, 0
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    data = _record(page_id, url, payload or b"", digest, refers_to, self.date, revisit)
                    data = _member(data) if self.gzip else data
                    out.write(data)
                    n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            files.append((name, n))
        return _Written(files)

    def commit(self, messages: list) -> None:
        fs, folder = file_system(self.folder)
        fs.create_dir(folder)
        with fs.open_output_stream(f"{folder}/_manifest.json") as f:
            f.write(json.dumps([{"path": name, "records": n} for m in messages if m for name, n in m.files]).encode())

    def abort(self, messages: list) -> None:
        fs, folder = file_system(self.folder)
        for name in [name for m in messages if m for name, _ in m.files]:
            fs.delete_file(f"{folder}/{name}")


class _File(InputPartition):
    def __init__(self, path: str | None):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.payload, self.verify = options.get("payload", "true") == "true", options.get("verify", "false") == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in _HEADERS and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                value = set(f.value) if isinstance(f, In) else {f.value} if isinstance(f, EqualTo) else getattr(f, "value", None)
                self.tests.append((column, "set" if isinstance(value, set) else "start" if value is not None else "there", value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as pafs

        fs, folder = file_system(self.folder)
        if fs.get_file_info(folder).type == pafs.FileType.File:
            return [_File(folder)]
        if fs.get_file_info(f"{folder}/_manifest.json").type == pafs.FileType.File:
            with fs.open_input_stream(f"{folder}/_manifest.json") as f:
                names = [f"{folder}/{x['path']}" for x in json.loads(f.read())]
        else:
            names = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(folder, recursive=True)) if x.base_name.endswith((".warc", ".warc.gz")))
        return [_File(n) for n in names] or [_File(None)]

    def _wanted(self, head: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            x = _value(head, column)
            if x is None or kind == "set" and x not in value or kind == "start" and not x.startswith(value):
                return False
        return True

    def _rows(self, f, seek) -> Iterator[tuple]:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {line[:40]!r}")
            head: dict[str, str] = {}
            name = ""
            while (line := f.readline()).strip():
                text = _text(line)
                if text[0] in " \t" and name:  # goes on from the line before
                    head[name] = f"{head[name]} {text.strip()}".strip()
                    continue
                name, _, value = text.partition(":")
                name = name.strip().lower()
                head[name] = value.strip()
            if not head.get("content-length", "").isdecimal():
                raise ValueError(f"{head.get('warc-record-id')} has no length")
            length = int(head["content-length"])
            if not self._wanted(head):
                seek(length)
                continue
            kind, left, size, payload = head.get("warc-type"), length, None, None
            if head.get("content-type", "").startswith("application/http"):
                while left:
                    line = f.readline()
                    left -= len(line)
                    if not line:
                        break
                    if line.lower().startswith(b"content-length:") and line[15:].strip().isdigit():
                        size = int(line[15:])
                    if not line.strip():
                        break
            if kind != "revisit":
                size = left
                if self.payload or self.verify:
                    payload, left = f.read(left), 0
            seek(left)
            digest = _value(head, "payload_digest")
            if self.verify and payload is not None and not _agrees(payload, head.get("warc-payload-digest")):
                raise ValueError(f"payload of {head.get('warc-record-id')} has another digest")
            yield _value(head, "page_id"), head.get("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-date"), digest, _value(head, "refers_to"), size, payload if self.payload else None

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.path is None:
            return
        fs, _ = file_system(self.folder)
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        with fs.open_input_file(partition.path) as raw:
            packed = partition.path.endswith(".gz")
            lengths = packed and _Members.has_lengths(raw.read(24))
            raw.seek(0)
            f = _Members(raw) if lengths else gzip.GzipFile(fileobj=raw) if packed else _Buffered(raw)
            rows: list[tuple] = []
            held = 0
            for row in self._rows(f, (lambda n: f.seek(n, 1)) if lengths or not packed else (lambda n: f.read(n))):
                rows.append(row)
                held += len(row[-1] or b"")
                if len(rows) >= 2000 or held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _member(data: bytes) -> bytes:
    """One gzip member whose extra field ``sl`` gives its own length and that of the data, so readers can skip it."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, 24 + len(body) + 8, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class _Members:
    """readline, read and seek over gzip members with ``sl`` fields, one a record.  A seek goes on to the next member, and what was
    skipped is not inflated."""

    def __init__(self, raw):
        self._raw, self._next, self._left = raw, 0, 0
        self._inflate, self._data, self._at = None, b"", 0

    @staticmethod
    def has_lengths(head: bytes) -> bool:
        return len(head) == 24 and head[:4] == b"\x1f\x8b\x08\x04" and head[10:16] == b"\x0c\0sl\x08\0"

    def _more(self) -> bool:
        """Inflate on in the current member; False at its end."""
        if self._inflate is None or self._inflate.eof:
            return False
        packed = self._inflate.unconsumed_tail
        if not packed:
            packed = self._raw.read(min(1 << 14, self._left))
            self._left -= len(packed)
        more = self._inflate.decompress(packed, 1 << 16)
        if not packed and not more and not self._inflate.eof:
            raise ValueError("a record ends too early")
        self._data, self._at = self._data[self._at :] + more, 0
        return True

    def _open(self) -> bool:
        self._raw.seek(self._next)
        head = self._raw.read(24)
        if not head:
            return False
        if not self.has_lengths(head):
            raise ValueError("a gzip member without its length")
        (size,) = struct.unpack_from("<I", head, 16)
        self._next, self._left = self._next + size, size - 24
        self._inflate, self._data, self._at = zlib.decompressobj(-15), b"", 0
        return True

    def readline(self) -> bytes:
        while self._at == len(self._data):  # the last step of a member can end it without data
            if not self._more() and not self._open():
                return b""
        while (end := self._data.find(b"\n", self._at)) < 0:
            if not self._more():
                end = len(self._data) - 1
                break
        line, self._at = self._data[self._at : end + 1], end + 1
        return line

    def read(self, n: int) -> bytes:
        while len(self._data) - self._at < n and self._more():
            pass
        out, self._at = self._data[self._at : self._at + n], min(len(self._data), self._at + n)
        return out

    def seek(self, n: int, whence: int = 1) -> None:
        if n:
            self._inflate, self._data, self._at = None, b"", 0


class _Buffered:
    """readline, read and relative seek over a random-access file; a seek beyond the buffer reads nothing."""

    def __init__(self, raw, size: int = 1 << 16):
        self._raw, self._size, self._data, self._at = raw, size, b"", 0

    def _more(self) -> bool:
        more = self._raw.read(self._size)
        self._data, self._at = self._data[self._at :] + more, 0
        return bool(more)

    def readline(self) -> bytes:
        look = self._at
        while (end := self._data.find(b"\n", look)) < 0:
            look = len(self._data) - self._at
            if not self._more():
                end = len(self._data) - 1
                break
        line, self._at = self._data[self._at : end + 1], end + 1
        return line

    def read(self, n: int) -> bytes:
        have = self._data[self._at : self._at + n]
        self._at += len(have)
        return have if len(have) == n else have + self._raw.read(n - len(have))

    def seek(self, n: int, whence: int = 1) -> None:
        have = min(n, len(self._data) - self._at)
        self._at += have
        if n > have:
            self._raw.seek(self._raw.tell() + n - have)


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _base32(hexed):
    """Base 32 of 20 bytes in hex, by Spark functions: five bytes make eight letters."""
    letters = F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"])
    number = lambda i: F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 10).cast("long")
    return F.concat(*[letters[F.shiftrightunsigned(number(i), 35 - 5 * j).bitwiseAND(31).cast("int")] for i in range(4) for j in range(8)])


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest, refers_to, revisit of pages(page_id, url, html): of rows with equal payloads of at least
    ``least`` bytes, one with the smallest page_id is the response and the others refer to it.

    Digests are counted with partial sums; only the ids of repeated payloads are joined back, and the payloads are
    shuffled once, by page, so one payload that a third of all pages share makes no large task."""
    id_ = F.col("page_id").cast("long")
    rows = pages.select(id_.alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    ids = rows.filter(F.octet_length("payload") >= least).groupBy("page_id", "sha").agg(F.count("*").alias("n"))
    first = ids.groupBy("sha").agg(F.min("page_id").alias("first"), F.sum("n").alias("of")).filter("of > 1").select("sha", "first")
    key = [F.coalesce("page_id", F.lit(0)).alias("k"), F.col("page_id").isNull().alias("none")]
    later = ids.join(first, "sha").withColumn("least", F.expr("page_id <=> first")).filter("not least or n > 1").select(*key, "sha", "first", "least")
    keyed = rows.select("*", *key)
    turn = F.row_number().over(Window.partitionBy("k", "none", "sha").orderBy(F.col("url").asc_nulls_last()))
    found = keyed.withColumn("turn", turn).join(later, ["k", "none", "sha"], "left")
    revisit = F.coalesce(~F.col("least") | (F.col("turn") > 1), F.lit(False))
    return found.select("page_id", "url", "payload", _base32(F.col("sha")).alias("digest"), F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_warc(pages: DataFrame, path: str, least: int = 0, compression: str = "none", file_bytes: int = 512 << 20) -> None:
    register(pages.sparkSession)
    with_revisits(pages, least).write.format("warc").option("compression", compression).option("file_bytes", str(file_bytes)).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)


def round_trip(pages: DataFrame, least: int = 0, compression: str = "gzip") -> DataFrame:
    """The records of pages, written to a new shared folder and read back, every payload checked by its digest."""
    path = shared_folder(pages.sparkSession, "warc")
    write_warc(pages, path, least, compression)
    return read_warc(pages.sparkSession, path, payload=False, verify=True)
