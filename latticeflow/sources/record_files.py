"""Files of fixed-length records behind a header (S6, S7, K1) and digests of large files (K9).

A Python data source of the name ``records`` reads byte ranges that are aligned to the records, so one file is read
by as many tasks as its size asks for, and writes records at their places from all tasks at once: no record passes
through the driver.  Filters on ``idx`` reach the plan of the ranges where the session allows it
(``spark.sql.python.filterPushdown.enabled``) or where they are given as options.
"""

from __future__ import annotations

import glob
import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes that one task reads of a file.
SPLIT = 64 << 20
#: Bytes that are read, written or hashed at once.
PIECE = 4 << 20
#: Ranges that the files of one read are cut into at most, whatever ``split`` asks for: tasks have a fixed cost.
MOST_RANGES = 512


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def mounted(path: str) -> str | None:
    """The path as the machines mount it, or None for a store that can't be written at a position."""
    if path.startswith("file:"):
        return unquote(urlparse(path).path)
    return None if "://" in path else os.path.abspath(path)


def sizes(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, of all files of a folder but hidden ones, or of a pattern's files, by name."""
    fs, name = opened(path)
    if isinstance(fs, pafs.LocalFileSystem) and glob.has_magic(name):
        found = fs.get_file_info(sorted(glob.glob(name)))
    else:
        info = fs.get_file_info(name)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(name, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")))


@dataclass
class RecordRange(InputPartition):
    """Records ``first`` to ``end`` (exclusive) of a file."""

    file: str
    first: int
    end: int

    def __post_init__(self) -> None:
        self.value = (self.file, self.first, self.end)


class RecordReader(DataSourceReader):
    """Plans and reads ranges of records; ``first`` and ``end`` bound ``idx``; ``partial``: bytes behind the last whole record are ignored."""

    def __init__(self, path: str, length: int, header: int, first: int, end: int | None, split: int, partial: bool):
        self.path, self.length, self.header, self.first, self.end, self.partial = path, length, header, first, end, partial
        self.at_once = max(1, split // length)

    def partitions(self) -> list[RecordRange]:
        held = []
        for file, size in sizes(self.path):
            if not self.partial and (size < self.header or (size - self.header) % self.length):
                raise ValueError(f"{file}: {size} bytes aren't a header of {self.header} and whole records of {self.length}")
            n = max(0, size - self.header) // self.length
            held.append((file, n if self.end is None else min(n, self.end)))
        first = max(0, self.first)
        at_once = max(self.at_once, -(-sum(max(0, n - first) for _, n in held) // MOST_RANGES))
        found = [RecordRange(file, a, min(n, a + at_once)) for file, n in held for a in range(first, n, at_once)]
        return found or [RecordRange("", 0, 0)]

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        """The range's rows; a record of more than ``PIECE`` bytes is a batch of its own."""
        fs, _ = opened(self.path)
        step = max(1, PIECE // self.length)
        if partition.first >= partition.end:
            return
        with fs.open_input_file(partition.file) as f:
            for a in range(partition.first, partition.end, step):
                b = min(partition.end, a + step)
                data = f.read_at((b - a) * self.length, self.header + a * self.length)
                rows = pa.Array.from_buffers(pa.binary(self.length), b - a, [None, pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * (b - a)), pa.array(np.arange(a, b)), rows], ["path", "idx", "record"])


class FilteringRecordReader(RecordReader):
    """Takes comparisons of ``idx`` with numbers into the plan; Spark checks all other filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            ours = isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == ("idx",)
            if not ours:
                yield f
                continue
            low = {EqualTo: 0, GreaterThanOrEqual: 0, GreaterThan: 1}.get(type(f))
            high = {EqualTo: 1, LessThanOrEqual: 1, LessThan: 0}.get(type(f))
            if low is not None:
                self.first = max(self.first, f.value + low)
            if high is not None:
                self.end = f.value + high if self.end is None else min(self.end, f.value + high)


@dataclass
class Written(WriterCommitMessage):
    """The runs [first, end) of places that a task has filled."""

    runs: list[tuple[int, int]]


class RecordWriter(DataSourceWriter):
    """Fills a hidden file at the records' places; the commit checks that each place was filled once and names it.

    A task that is run again writes the same bytes at the same places.
    """

    def __init__(self, path: str, length: int, header: bytes):
        self.path, self.length, self.header = path, length, header
        folder, name = os.path.split(path)
        self.hidden = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        with open(self.hidden, "wb") as f:
            f.write(header)

    def write(self, rows: Iterator) -> Written:
        runs: list[list[int]] = []
        held = bytearray()
        with open(self.hidden, "r+b") as f:
            for row in rows:
                record = bytes(row.record)
                if len(record) != self.length:
                    raise ValueError(f"record {row.idx} has {len(record)} bytes instead of {self.length}")
                if not runs or row.idx != runs[-1][1] or len(held) >= PIECE:
                    f.write(held)
                    held = bytearray()
                    f.seek(len(self.header) + row.idx * self.length)
                if runs and row.idx == runs[-1][1]:
                    runs[-1][1] += 1
                else:
                    runs.append([row.idx, row.idx + 1])
                held += record
            f.write(held)
            f.flush()
            os.fsync(f.fileno())
        return Written([tuple(r) for r in runs])

    def commit(self, messages: list[Written | None]) -> None:
        at = 0
        for first, end in sorted(r for m in messages if m for r in m.runs):
            if first != at:
                os.unlink(self.hidden)
                raise ValueError(f"record {min(first, at)} {'came twice' if first < at else 'is missing'}")
            at = end
        os.replace(self.hidden, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.hidden):
            os.unlink(self.hidden)


class ArrowRecordWriter(RecordWriter, DataSourceArrowWriter):
    """The same from batches: each run of places within a batch is one piece."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        runs: list[list[int]] = []
        with open(self.hidden, "r+b") as f:
            for batch in batches:
                idx, records = batch.column("idx").to_numpy(), batch.column("record")
                lengths = pc.fill_null(pc.binary_length(records), 0).to_numpy(zero_copy_only=False)
                for k in np.flatnonzero(lengths != self.length)[:1]:
                    raise ValueError(f"record {idx[k]} has {lengths[k]} bytes instead of {self.length}")
                data = memoryview(records.cast(pa.binary(self.length)).buffers()[1]) if len(idx) else b""
                cuts = [0, *(np.flatnonzero(np.diff(idx) != 1) + 1).tolist(), len(idx)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    f.seek(len(self.header) + int(idx[a]) * self.length)
                    f.write(data[a * self.length : b * self.length])
                    if runs and idx[a] == runs[-1][1]:
                        runs[-1][1] += b - a
                    else:
                        runs.append([int(idx[a]), int(idx[a]) + b - a])
            f.flush()
            os.fsync(f.fileno())
        return Written([tuple(r) for r in runs])


class Records(DataSource):
    """Options: path; length of a record; header (bytes when reading, hexadecimal text when writing); first, end; split; partial; pushdown."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "path string, idx long, record binary"

    def reader(self, schema: StructType) -> RecordReader:
        o = self.options
        kind = FilteringRecordReader if o.get("pushdown", "false") == "true" else RecordReader
        return kind(o["path"], int(o["length"]), int(o.get("header", 0)), int(o.get("first", 0)), int(o["end"]) if "end" in o else None, int(o.get("split", SPLIT)), o.get("partial", "false") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> ArrowRecordWriter:
        where = mounted(self.options["path"])
        if where is None:
            raise ValueError("records are written at their places, which needs a folder that all machines mount")
        if not overwrite and os.path.exists(where):
            raise FileExistsError(where)
        return ArrowRecordWriter(where, int(self.options["length"]), bytes.fromhex(self.options.get("header", "")))


def read(spark: SparkSession, path: str, length: int, header: int = 0, first: int = 0, end: int | None = None, split: int = SPLIT, partial: bool = False) -> DataFrame:
    """(path, idx, record) of record files, records ``first`` to ``end`` of each, in ranges of about ``split`` bytes."""
    spark.dataSource.register(Records)
    options = {"length": length, "header": header, "first": first, "split": split, "partial": partial} | ({} if end is None else {"end": end})
    return spark.read.format("records").options(pushdown=spark.conf.get("spark.sql.python.filterPushdown.enabled"), **options).load(path)


def write(records: DataFrame, path: str, length: int, header: bytes = b"") -> None:
    """Writes (idx, record), the places 0.. each once, as one file; nothing is left of a write that fails."""
    records.sparkSession.dataSource.register(Records)
    placed = records.select("idx", "record").repartitionByRange("idx").sortWithinPartitions("idx")
    placed.write.format("records").options(length=length, header=header.hex()).mode("overwrite").save(path)


def blocks(spark: SparkSession, path: str, block: int) -> DataFrame:
    """(path, idx, record): files in blocks of ``block`` bytes, with what is left of a file as its last."""
    whole = read(spark, path, block, partial=True, split=4 * PIECE)
    rests = [(f, n // block, n - n % block, n) for f, n in sizes(path) if n % block]
    if not rests:
        return whole
    tails = spark.createDataFrame(rests, "path string, idx long, at long, size long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(path)
        for batch in batches:
            for name, idx, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(name) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([idx], pa.int64()), pa.array([f.read_at(size - at, at)], pa.binary())], ["path", "idx", "record"])

    return whole.unionByName(tails.mapInArrow(run, "path string, idx long, record binary"))


def tree_digests(blocks: DataFrame) -> DataFrame:
    """K9: (path, blocks, tree_sha256) from (path, idx, record): the digest of the blocks' digests in order.

    The blocks are hashed where they are read; a file's digests go through one task as a stream, as they are a chain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list = []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([told[0]]), pa.array([told[1]], pa.int64()), pa.array([told[2].hexdigest()])], ["path", "blocks", "tree_sha256"])

        for batch in batches:
            paths, leaves = batch.column(0), batch.column(1).to_pylist()
            ends = pc.run_end_encode(paths)
            at = 0
            for path, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True):
                if not told or told[0] != path:
                    if told:
                        yield done()
                    told = [path, 0, hashlib.sha256()]
                told[1] += end - at
                told[2].update("".join(leaves[at:end]).encode())
                at = end
        if told:
            yield done()

    leaves = blocks.select("path", "idx", F.sha2("record", 256).alias("leaf")).repartition("path").sortWithinPartitions("path", "idx")
    return leaves.select("path", "leaf").mapInArrow(run, "path string, blocks long, tree_sha256 string")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """K9: (path, sha256, size_bytes) of files of any size; each is hashed in pieces, one file a task."""
    files = spark.createDataFrame(sizes(path), "path string, size_bytes long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, _ = opened(path)
                told = hashlib.sha256()
                with fs.open_input_stream(name) as f:
                    while piece := f.read(PIECE):
                        told.update(piece)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([told.hexdigest()]), pa.array([size], pa.int64())], ["path", "sha256", "size_bytes"])

    return files.repartition(max(1, files.count()), "path").mapInArrow(run, "path string, sha256 string, size_bytes long")
