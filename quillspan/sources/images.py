"""Raw image stacks: unsigned 16-bit frames in a ``.dax`` file with a ``.inf`` text beside it.

``spark.read.format("dax").load(path)`` gives one row a frame.  Options cut what is read: ``frames`` (``first:stop:step``), ``rows`` and
``columns`` (``first:stop``); frames that are not wanted and rows outside are never read, for partitions are runs of frames and tasks seek.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspan.sources.files import written

_SCHEMA = "path string, frame int, height int, width int, pixels binary"


def described(text: str) -> dict:
    """height, width, frames and byte order of a ``.inf`` text."""
    find = lambda pattern: re.search(pattern, text)
    size, n = find(r"frame dimensions = (\d+) x (\d+)"), find(r"number of frames = (\d+)")
    return {"height": int(size[1]) if size else 256, "width": int(size[2]) if size else 256, "frames": int(n[1]) if n else None, "order": ">" if find(r" big endian") else "<"}


def _span(text: str | None, n: int) -> range:
    return range(n)[slice(*[int(x) if x else None for x in text.split(":")])] if text else range(n)


class _Frames(InputPartition):
    def __init__(self, path: str, frames: list[int], info: dict):
        self.path, self.frames, self.info = path, frames, info


class DaxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _system(self):
        from pyarrow import fs

        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def partitions(self):
        from pyarrow import fs

        system, path = self._system()
        folder = system.get_file_info(path).type == fs.FileType.Directory
        names = sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".dax")) if folder else [path]
        out = []
        for name in names:
            with system.open_input_stream(name.removesuffix(".dax") + ".inf") as f:
                info = described(f.read().decode("utf-8", "replace"))
            one = 2 * info["height"] * info["width"]
            n = info["frames"] or system.get_file_info(name).size // one
            wanted = list(_span(self.options.get("frames"), n))
            step = max(1, (64 << 20) // one)
            out += [_Frames(name, wanted[i : i + step], info) for i in range(0, len(wanted), step)]
        return out or [_Frames("", [], {})]

    def read(self, partition: _Frames):
        system, _ = self._system()
        if not partition.frames:
            return
        info = partition.info
        rows, columns = _span(self.options.get("rows"), info["height"]), _span(self.options.get("columns"), info["width"])
        schema = pa.schema([("path", pa.string()), ("frame", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.binary())])
        with system.open_input_file(partition.path) as f:
            for frame in partition.frames:
                f.seek(2 * info["width"] * (frame * info["height"] + rows.start))
                data = f.read(2 * info["width"] * (rows.stop - rows.start))
                image = np.frombuffer(data, info["order"] + "u2").reshape(-1, info["width"])[:: rows.step, columns.start : columns.stop : columns.step]
                cells = np.ascontiguousarray(image, "<u2")
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((partition.path, frame, *cells.shape, cells.tobytes()), schema, strict=True)], schema=schema)


class Dax(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dax"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DaxReader:
        return DaxReader(dict(self.options))


def read_stack(spark: SparkSession, path: str, frames: str | None = None, rows: str | None = None, columns: str | None = None) -> DataFrame:
    """path, frame, height, width and pixels (little-endian uint16) of the wanted part of a stack or of a folder of stacks."""
    spark.dataSource.register(Dax)
    reader = spark.read.format("dax")
    for name, value in (("frames", frames), ("rows", rows), ("columns", columns)):
        if value:
            reader = reader.option(name, value)
    return reader.load(path)


def write_stack(path: str, frames: list[np.ndarray]) -> None:
    """A ``.dax`` file and its ``.inf`` of frames of one size, clipped to 16 bits.  For the images of one field of view."""
    height, width = frames[0].shape
    with open(path, "wb") as f:
        for x in frames:
            f.write(np.clip(x, 0, 65535).astype("<u2").tobytes())
    with open(path.removesuffix(".dax") + ".inf", "w") as f:
        f.write(f"frame dimensions = {height} x {width}\nnumber of frames = {len(frames)}\ndata type = 16 bit integers (binary, little endian)\n")


def stretched(image: np.ndarray, bits: int = 16) -> np.ndarray:
    """The image with its least value at 0 and its greatest at the top of 8 or 16 bits."""
    low, high = float(image.min()), float(image.max())
    kind = np.uint8 if bits == 8 else np.uint16
    return ((image - low) / (high - low or 1) * np.iinfo(kind).max).astype(kind)


def write_stacks(frames: DataFrame, folder: str, bits: int | None = None) -> DataFrame:
    """Writes frames(name, frame, height, width, pixels: little-endian uint16) as ``<name>.dax`` and ``.inf`` files under a folder that all executors share, and returns name
    and the number of frames.

    A stack's frames go to one task, sorted, and are appended as they come, a few at a time; the file has its name only when it is whole, so a repeated task
    writes it again.  With ``bits`` (8 or 16) a stack's least value becomes 0 and its greatest the top of that many bits, by extremes that are
    aggregated over its frames first.  Frames of a stack must be of one size."""
    spark = frames.sparkSession
    rows = frames.select("name", F.col("frame").cast("long").alias("frame"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "pixels")
    if bits:

        def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [np.frombuffer(p.as_buffer(), "<u2") for p in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(v.min()) for v in x], pa.int32()), pa.array([int(v.max()) for v in x], pa.int32())], ["name", "low", "high"])

        ends = rows.select("name", "pixels").mapInArrow(extremes, "name string, low int, high int").groupBy("name").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        rows = rows.join(ends, "name")
    else:
        rows = rows.withColumn("low", F.lit(0)).withColumn("high", F.lit(0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        system.create_dir(root, recursive=True)
        name, out, size, n = None, None, (0, 0), 0
        part = f"{root}/.{uuid.uuid4().hex}"

        def close() -> pa.RecordBatch:
            out.close()
            with system.open_output_stream(f"{part}.inf") as f:
                f.write(f"frame dimensions = {size[0]} x {size[1]}\nnumber of frames = {n}\ndata type = 16 bit integers (binary, little endian)\n".encode())
            for kind in ("inf", "dax"):
                system.move(f"{part}.{kind}", f"{root}/{name}.{kind}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "frames"])

        for batch in batches:
            for i in range(batch.num_rows):
                of, _, height, width, pixels, low, high = (batch.column(k)[i] for k in range(7))
                if of.as_py() != name:
                    if out:
                        yield close()
                    name, size, n = of.as_py(), (height.as_py(), width.as_py()), 0
                    out = system.open_output_stream(f"{part}.dax")
                if size != (height.as_py(), width.as_py()):
                    raise ValueError(f"frames of {name} are not of one size")
                x = np.frombuffer(pixels.as_buffer(), "<u2")
                if bits:
                    low, high = low.as_py(), high.as_py()
                    x = ((x - float(low)) / (high - low or 1) * (2**bits - 1)).astype("<u2")
                out.write(x.astype("<u2").tobytes())
                n += 1
        if out:
            yield close()

    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # frames are large
    try:
        return written(rows.repartition("name").sortWithinPartitions("name", "frame").mapInArrow(work, "name string, frames long"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
