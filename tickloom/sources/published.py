"""A bounded published stream: a committed sink for micro-batches, and its newest rows.

Each task of a micro-batch writes a file; the files become a batch of the stream by one commit record, which is made under another
name and moved into place. A batch that is already committed stays as it is when it is replayed, and the files of the replay go, as do
those of a batch that is aborted. Commits and files that no reader of the newest ``capacity`` rows needs are dropped, so that what is
kept does not grow with the stream.

    sinks.publish(stream, path, capacity, checkpoint)
    published.newest(spark, path)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

from tickloom.sources.binary import place


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class Published(DataSource):
    """Options: path, capacity (rows to keep)."""

    @classmethod
    def name(cls) -> str:
        return "published"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return Writer(dict(self.options))


class Writer(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.path, self.capacity = options["path"], int(options["capacity"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = place(self.path)
        system.create_dir(f"{root}/rows", recursive=True)
        name, rows, writer = f"rows/{uuid.uuid4().hex}.parquet", 0, None
        for batch in batches:
            if batch.num_rows:
                writer = writer or pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=system)
                writer.write_batch(batch)
                rows += batch.num_rows
        if writer is None:
            return Written(None, 0)
        writer.close()
        return Written(name, rows)

    def commit(self, messages: list[Written | None], batch_id: int) -> None:
        system, root = place(self.path)
        files = [[m.file, m.rows] for m in messages if m is not None and m.file]
        known = commits(self.path)
        if batch_id in known:
            drop(self.path, [f for f, _ in files])
            return
        system.create_dir(f"{root}/commits", recursive=True)
        temporary = f"{root}/.{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as file:
            file.write(json.dumps({"files": files}).encode())
        system.move(temporary, f"{root}/commits/{batch_id:012d}.json")
        known[batch_id] = files
        self.trim(known)

    def abort(self, messages: list[Written | None], batch_id: int) -> None:
        drop(self.path, [m.file for m in messages if m is not None and m.file])

    def trim(self, known: dict[int, list]) -> None:
        """Drops the batches before those that hold the newest ``capacity`` rows; the newest commit always stays, as it tells replays."""
        system, root = place(self.path)
        have = 0
        for batch_id in sorted(known, reverse=True):
            if have >= self.capacity:
                system.delete_file(f"{root}/commits/{batch_id:012d}.json")
                drop(self.path, [f for f, _ in known[batch_id]])
            have += sum(n for _, n in known[batch_id])


def drop(path: str, names: list[str]) -> None:
    system, root = place(path)
    for name in names:
        if system.get_file_info(f"{root}/{name}").type == fs.FileType.File:
            system.delete_file(f"{root}/{name}")


def commits(path: str) -> dict[int, list]:
    """The files (name, rows) of each committed batch that is kept."""
    system, root = place(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    out = {}
    for info in found:
        with system.open_input_stream(info.path) as file:
            out[int(info.base_name.split(".")[0])] = json.loads(file.read())["files"]
    return out


def newest(spark: SparkSession, path: str, capacity: int | None = None, order: tuple[str, ...] = ("ts_ns", "seq")) -> DataFrame | None:
    """The newest rows of a published stream by ``order``: of committed batches alone; None where there is none yet."""
    files = [f"{path}/{f}" for batch in commits(path).values() for f, _ in batch]
    if not files:
        return None
    rows = spark.read.parquet(*files)
    return rows if capacity is None else rows.orderBy(*[F.desc(c) for c in order]).limit(capacity)
