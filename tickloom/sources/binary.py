"""Binary tick files: a data source that reads them by ranges of records, their headers alone, and their writing in chunks.

    tick_files(spark, folder).where("token = 7 AND ts_ns >= 5")

A file of any length is read by many tasks, each of which holds CHUNK_RECORDS records at a time. Predicates on token and ts_ns are
pushed into the reader: a file whose header rules them out is left after 64 bytes, and in files of ordered records, which is how
they are written, the range of times is found by bisection. Paths are those of any file system that Arrow knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from tickloom.sources.readers import CHUNK_RECORDS, HEADER, MAGIC, RECORD, TICK_SCHEMA, VERSION

PART_RECORDS, LEAST, MOST = 1 << 20, 0, 2**63 - 1


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files of a folder, or of the one file, in order."""
    system, at = place(path)
    info = system.get_file_info(at)
    found = system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
    if any(f.type == fs.FileType.NotFound for f in found):
        raise FileNotFoundError(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def header(name: str, data: bytes, size: int):
    """The header of a file, after its checks."""
    if len(data) < HEADER.itemsize:
        raise ValueError(f"{name}: no header")
    head = np.frombuffer(data, HEADER, 1)[0]
    if head["magic"] != MAGIC:
        raise ValueError(f"{name}: not a tick file")
    if head["version"] != VERSION:
        raise ValueError(f"{name}: version {head['version']}")
    if head["size"] != RECORD.itemsize:
        raise ValueError(f"{name}: records of {head['size']} bytes")
    if size < HEADER.itemsize + int(head["count"]) * RECORD.itemsize:
        raise ValueError(f"{name}: cut off")
    return head


class Ranges(InputPartition):
    """Ranges of records (path, size of the file, first, end): a part of a large file, or several small files."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


class TickFiles(DataSource):
    """Options: path, records (of a task, PART_RECORDS), ordered (true: records are in order of time)."""

    @classmethod
    def name(cls) -> str:
        return "tick_files"

    def schema(self) -> str:
        return TICK_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TickReader(dict(self.options))


class TickReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.records = options["path"], int(options.get("records", PART_RECORDS))
        self.ordered = options.get("ordered", "true") == "true"
        self.tokens: set[int] | None = None
        self.low, self.high = LEAST, MOST

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of ts_ns and equality of token; others stay with Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("token",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tokens = own if self.tokens is None else self.tokens & own
            elif column == ("ts_ns",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        """Ranges of records by the files' sizes: no file is opened here."""
        out, have = [[]], 0
        for path, size in listed(self.path):
            n = max(0, size - HEADER.itemsize) // RECORD.itemsize
            for a in range(0, max(n, 1), self.records):
                b = min(a + self.records, n)
                if out[-1] and have + b - a > self.records:
                    out.append([])
                    have = 0
                out[-1].append((path, size, a, b))
                have += b - a
        return [Ranges(x) for x in out if x]

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        for each in part.ranges:
            yield from self.records_of(*each)

    def records_of(self, path: str, size: int, first: int, end: int) -> Iterator[pa.RecordBatch]:
        system, at = place(path)
        with system.open_input_file(at) as file:
            head = header(path, file.read_at(min(HEADER.itemsize, size), 0), size)
            end = min(end, int(head["count"]))
            if self.high < head["first_ns"] or self.low > head["last_ns"]:
                return
            if self.ordered:
                first, end = self.bisected(file, first, end, self.low), self.bisected(file, first, end, self.high + 1)
            for lo in range(first, end, CHUNK_RECORDS):
                n = min(CHUNK_RECORDS, end - lo)
                rows = np.frombuffer(file.read_at(n * RECORD.itemsize, HEADER.itemsize + lo * RECORD.itemsize), RECORD)
                keep = (rows["ts_ns"] >= self.low) & (rows["ts_ns"] <= self.high)
                if self.tokens is not None:
                    keep &= np.isin(rows["token"], list(self.tokens))
                rows = rows[keep]
                if len(rows):
                    columns = [pa.array(rows[c].astype(np.int64 if c in ("ts_ns", "token", "volume") else np.float32)) for c in RECORD.names]
                    yield pa.record_batch([pa.array([path] * len(rows)), *columns], names=["path", *RECORD.names])

    @staticmethod
    def bisected(file, first: int, end: int, ts_ns: int) -> int:
        """The first record of a range that is not before a time."""
        while first < end:
            mid = (first + end) // 2
            if int.from_bytes(file.read_at(8, HEADER.itemsize + mid * RECORD.itemsize), "little") < ts_ns:
                first = mid + 1
            else:
                end = mid
        return first


def tick_files(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(TickFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tick_files").options(path=path, **options).load()


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path and length of the files of a folder whose names fit a pattern: a listing, which opens none."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")


def tick_headers(spark: SparkSession, path: str, pattern: str = "*.ticks") -> DataFrame:
    """path, token, first_ns, last_ns, records of binary tick files, from their first 64 bytes."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = place(name)
                with system.open_input_file(at) as file:
                    head = header(name, file.read_at(min(HEADER.itemsize, size), 0), size)
                rows.append((name, *(int(head[c]) for c in ("token", "first_ns", "last_ns", "count"))))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["path", "token", "first_ns", "last_ns", "records"])

    return files(spark, path, pattern).mapInArrow(probe, "path string, token long, first_ns long, last_ns long, records long")


def footer_ranges(spark: SparkSession, path: str, column: str) -> DataFrame:
    """path, records, first and last (as text) of a column of Parquet files, from their footers: no row group is read.

    first and last are null where a row group has no statistics; a reader then has to look at the rows.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                system, at = place(name)
                with system.open_input_file(at) as file:
                    meta = pq.read_metadata(file)
                index = meta.schema.names.index(column)
                stats = [meta.row_group(i).column(index).statistics for i in range(meta.num_row_groups) if meta.row_group(i).num_rows]
                known = bool(stats) and all(s is not None and s.has_min_max for s in stats)
                ends = (str(min(s.min for s in stats)), str(max(s.max for s in stats))) if known else (None, None)
                rows.append((name, meta.num_rows, *ends))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "records", "first", "last"])

    return files(spark, path, "*.parquet").mapInArrow(probe, "path string, records long, first string, last string")


def write_tick_files(ticks: DataFrame, folder: str) -> DataFrame:
    """token, path, records of one file a token, written when the result is computed.

    What the header says is summed up first, so that a task writes a token's records as they come in order, a batch at a time; a file
    gets its name when it is complete, and a task that runs again writes it anew.
    """
    sums = ticks.groupBy("token").agg(F.min("ts_ns").alias("_first"), F.max("ts_ns").alias("_last"), F.count(F.lit(1)).alias("_n"))
    rows = ticks.select(*RECORD.names).join(sums, "token").repartition("token").sortWithinPartitions("token", "ts_ns")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, root = place(folder)
        system.create_dir(root, recursive=True)
        token, count, file, temporary = None, 0, None, ""

        def done() -> pa.RecordBatch:
            file.close()
            system.move(temporary, f"{root}/{token}.ticks")
            return pa.record_batch([pa.array([token], pa.int64()), pa.array([f"{root}/{token}.ticks"]), pa.array([count], pa.int64())], names=["token", "path", "records"])

        for batch in batches:
            values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*RECORD.names, "_first", "_last", "_n")}
            part = np.zeros(batch.num_rows, RECORD)
            for c in RECORD.names:
                part[c] = values[c]
            cuts = [0, *(np.flatnonzero(np.diff(values["token"])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if file is None or int(values["token"][lo]) != token:
                    if file is not None:
                        yield done()
                    token, count, temporary = int(values["token"][lo]), 0, f"{root}/.{uuid.uuid4().hex}"
                    file = system.open_output_stream(temporary)
                    head = np.zeros(1, HEADER)
                    head[0] = (MAGIC, VERSION, token, values["_first"][lo], values["_last"][lo], values["_n"][lo], RECORD.itemsize, 0, (0, 0))
                    file.write(head.tobytes())
                file.write(part[lo:hi].tobytes())
                count += hi - lo
        if file is not None:
            yield done()

    return rows.mapInArrow(write, "token long, path string, records long")
