"""Token-ID files: length-delimited binary records with masked checksums and a separate offset index.

A record file is a run of frames

    uint64 length | uint32 masked(crc of those 8 bytes) | payload | uint32 masked(crc of the payload)

all little-endian.  ``masked(c) = rotr(c, 15) + 0xA282EAD8 (mod 2**32)``, so that a checksum stored inside data that
is itself checksummed stays harmless; the checksum is CRC-32.  The payload is a 10-byte head (doc_id as int64, a
byte that says whether doc_id is null, the id width 2 or 4) and the ids in that width.  ``<file>.idx`` beside it has,
for each record, its byte offset and the ids before it in the file (two uint64), so any record can be read without
the ones before it: ``read_shuffled`` reads all of them in a random order that a seed names.  ``_manifest.json`` lists the committed files in order with their records, bytes and ids before.

Rows are range-partitioned by (doc_id, hash of the text), so that one id that holds a third of all rows still
spreads; tasks write files under names of their own attempt, and only the files of attempts that the driver saw
finish are in the manifest, so lost executors and repeated tasks leave no double records.

A file holds about ``file_bytes`` of text at most, so files do not grow with the table.

Nulls: a null text has only the end id; null doc_ids come first.  Repeated rows are kept.  An empty table gives an
empty manifest.  Very long texts are records like others.  Ties in the order do not matter: tied rows are equal.  Columns other
than the two named are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quillspan.llm.shared import file_system
from quillspan.llm.token_ids import encoder
from quillspan.llm.words import mix

_HEAD = "<q?B"
_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
_FILE = "part int, path string, records long, ids long, bytes long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(read, where: str = "") -> bytes:
    """The next payload of a file-like object's ``read``; ValueError if it is damaged."""
    head = read(12)
    if len(head) < 12 or struct.unpack_from("<I", head, 8)[0] != masked(head[:8]):
        raise ValueError(f"damaged record length {where}")
    (size,) = struct.unpack_from("<Q", head)
    body = read(size + 4)
    if len(body) < size + 4 or struct.unpack_from("<I", body, size)[0] != masked(payload := body[:size]):
        raise ValueError(f"damaged record {where}")
    return payload


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, parts: int | None = None, file_bytes: int = 64 << 20) -> None:
    """Encode docs(doc_id, text) and write the record files of folder ``path`` in ascending doc_id order."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    if not parts:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    width_limit = 1 << 16

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, folder = file_system(path)
        encode = encoder(tokenizer).encode
        name, at, ids, n, out, index = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.rec", 0, 0, 0, None, None
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                if out is None:
                    out, index = fs.open_output_stream(f"{folder}/{name}"), fs.open_output_stream(f"{folder}/{name}.idx")
                pieces, offsets = [], []
                for doc, tokens in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    tokens = np.append(tokens, np.uint32(end_id))
                    small = int(tokens.max()) < width_limit
                    got = frame(struct.pack(_HEAD, doc or 0, doc is None, 2 if small else 4) + tokens.astype("<u2" if small else "<u4").tobytes())
                    offsets.append((at, ids))
                    pieces.append(got)
                    at, ids, n = at + len(got), ids + len(tokens), n + 1
                out.write(b"".join(pieces))
                index.write(np.array(offsets, "<u8").tobytes())
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "path": [name], "records": pa.array([n], pa.int64()), "ids": pa.array([ids], pa.int64()), "bytes": pa.array([at], pa.int64())})

    fs, folder = file_system(path)
    fs.create_dir(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    files, before = [], 0
    for row in sorted(rows.mapInArrow(write, _FILE).collect(), key=lambda r: r.part):  # one row a file
        files.append({"path": row.path, "records": row.records, "bytes": row.bytes, "before": before})
        before += row.ids
    with fs.open_output_stream(f"{folder}/_manifest.json") as f:
        f.write(json.dumps({"end_id": end_id, "ids": before, "files": files}).encode())


class _Span(InputPartition):
    def __init__(self, path: str, first: int, last: int, before: int):
        self.path, self.first, self.last, self.before = path, first, last, before


def permuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a permutation of 0 .. n - 1 that the seed names sends x: a Feistel network, walked until it stays below n."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> half, v & low
        for turn in range(4):
            left, right = right, left ^ (mix(right ^ mix(np.array([seed * 8 + turn], np.uint64), 1), 2) & low)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


class TokenRecordsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.split = options["path"], int(options.get("splitbytes", 32 << 20))
        self.seed = int(options["seed"]) if "seed" in options else None

    def _files(self) -> list[dict]:
        fs, folder = file_system(self.folder)
        with fs.open_input_stream(f"{folder}/_manifest.json") as f:
            return json.loads(f.read())["files"]

    def partitions(self):
        files = self._files()
        if self.seed is not None:  # spans of places in the shuffled order
            n, size = sum(x["records"] for x in files), sum(x["bytes"] for x in files)
            step = max(1, n * self.split // max(1, size))
            return [_Span("*", i, min(i + step, n), n) for i in range(0, n, step)] or [_Span("", 0, 0, 0)]
        spans = []
        for x in files:
            step = max(1, x["records"] * self.split // max(1, x["bytes"]))
            spans += [_Span(x["path"], i, min(i + step, x["records"]), x["before"]) for i in range(0, x["records"], step)]
        return spans or [_Span("", 0, 0, 0)]

    def read(self, partition: _Span):
        if not partition.path:
            return
        yield from self._shuffled(partition) if partition.path == "*" else self._in_order(partition)

    @staticmethod
    def _batch(rows: list[tuple], order: bool) -> pa.RecordBatch:
        fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("place", pa.int64())]
        schema = pa.schema(fields if order else fields[:4])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    @staticmethod
    def _record(payload: bytes, start: int) -> tuple:
        doc, null, width = struct.unpack_from(_HEAD, payload)
        tokens = np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_HEAD))
        return None if null else doc, start, len(tokens), tokens.astype("<u4").tobytes()

    def _in_order(self, partition: _Span):
        fs, folder = file_system(self.folder)
        with fs.open_input_file(f"{folder}/{partition.path}.idx") as f:
            f.seek(16 * partition.first)
            index = np.frombuffer(f.read(16 * (partition.last - partition.first)), "<u8").reshape(-1, 2)
        with fs.open_input_stream(f"{folder}/{partition.path}", buffer_size=1 << 20) if not partition.first else fs.open_input_file(f"{folder}/{partition.path}") as f:
            if partition.first:
                f.seek(int(index[0, 0]))
            for low in range(0, len(index), 512):
                yield self._batch([self._record(unframe(f.read, f"at {offset} of {partition.path}"), partition.before + ids) for offset, ids in index[low : low + 512].tolist()], False)

    def _shuffled(self, partition: _Span):
        """Places first .. last of the shuffled order; 512 at a time are sought in the order of the files."""
        fs, folder = file_system(self.folder)
        files = self._files()
        ends = np.cumsum([x["records"] for x in files])
        for low in range(partition.first, partition.last, 512):
            places = np.arange(low, min(low + 512, partition.last))
            number = permuted(places, partition.before, self.seed)
            file = np.searchsorted(ends, number, side="right")
            rows: list = [None] * len(places)
            for k in np.unique(file).tolist():
                x = files[k]
                with fs.open_input_file(f"{folder}/{x['path']}.idx") as index, fs.open_input_file(f"{folder}/{x['path']}") as f:
                    mine = np.flatnonzero(file == k)
                    for i in mine[np.argsort(number[mine])].tolist():
                        index.seek(16 * int(number[i] - ends[k] + x["records"]))
                        offset, ids = struct.unpack("<QQ", index.read(16))
                        f.seek(offset)
                        rows[i] = (*self._record(unframe(f.read, f"at {offset} of {x['path']}"), x["before"] + ids), int(places[i]))
            yield self._batch(rows, True)


class TokenRecords(DataSource):
    """``spark.read.format("token_records").load(folder)``: doc_id, start, n_tokens, ids (little-endian uint32).  With the
    option ``seed`` the records come in a random order, with ``place``, their place in it."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        return f"{_SCHEMA}, place long" if "seed" in self.options else _SCHEMA

    def reader(self, schema: StructType) -> TokenRecordsReader:
        return TokenRecordsReader(dict(self.options))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder, with the ids of all records before each one; files are split by the offset index."""
    spark.dataSource.register(TokenRecords)
    return spark.read.format("token_records").load(path)


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records of a folder in a random order: partitions hold runs of ``place``, each read by the offset index."""
    spark.dataSource.register(TokenRecords)
    return spark.read.format("token_records").option("seed", seed).load(path)
