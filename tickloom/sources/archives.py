"""Zip archives of delimited files: rows of their members, which are read as they are unpacked."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH = 8192


def member_rows(archives: DataFrame, pattern: str = "*.csv") -> DataFrame:
    """path, member, line and cells (header: cell, trimmed) of the members of zip archives (path, content) that fit a pattern.

    A member is unpacked and parsed line by line and leaves in batches, so that it is never held whole. The first line that isn't blank is the
    header, blank lines are left out, and so are lines with more or fewer cells than it and what can't be read as text. An archive that
    can't be opened raises; members of other names don't count.
    """

    def cells_of(archive: zipfile.ZipFile, name: str) -> Iterator[tuple[int, list[tuple[str, str]]]]:
        with archive.open(name) as raw:
            lines = (x.replace("\0", "") for x in io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline=""))
            reader, header = csv.reader(lines), None
            while True:
                try:
                    cells = next(reader)
                except StopIteration:
                    return
                except csv.Error:
                    continue
                cells = [c.strip() for c in cells]
                if not any(cells) or any("�" in c for c in cells):
                    continue
                if header is None:
                    header = cells
                elif len(cells) == len(header):
                    yield reader.line_num, list(zip(header, cells, strict=True))

    kind = pa.map_(pa.string(), pa.string())

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                    for name in sorted(n for n in archive.namelist() if fnmatch(n.lower(), pattern.lower())):
                        held: list = []
                        for row in cells_of(archive, name):
                            held.append(row)
                            if len(held) == BATCH:
                                yield made(path, name, held)
                                held = []
                        if held:
                            yield made(path, name, held)

    def made(path: str, name: str, held: list) -> pa.RecordBatch:
        n = len(held)
        return pa.record_batch(
            [pa.array([path] * n), pa.array([name] * n), pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], kind)],
            names=["path", "member", "line", "cells"],
        )

    return archives.select("path", "content").mapInArrow(unpack, "path string, member string, line long, cells map<string,string>")


def zipped(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """``member_rows`` of the archives at a path."""
    return member_rows(spark.read.format("binaryFile").load(path), pattern)


def table_of(rows: DataFrame, headers: list[str]) -> DataFrame:
    """The cells of some headers as columns of text: null where a member lacks a header; member and line stay."""
    return rows.select("member", "line", *[rows["cells"][h].alias(h) for h in headers])
