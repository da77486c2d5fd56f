"""Data vendors as a Spark data source: history as a batch and live ticks as a stream, with a task for each symbol.

A vendor is a class with ``authenticate(options)``, ``connect()``, ``subscribe(symbols)``, ``fetch_historical(symbol, first_ns,
last_ns)`` (rows), ``fetch_live(symbol, after, until)`` (rows after one position and up to another) and, as a static method,
``position(options)``: how far a batch may read, by the clock for instance. It is named by the option ``adapter`` as module:Class,
and made and authenticated on the executor that reads a symbol, so that no connection is sent anywhere; the driver calls
``position`` alone. Each symbol has its own offset, which a restart goes on from; a symbol that is new begins at ``after``.

    spark.dataSource.register(VendorSource)
    spark.read.format("vendor").options(adapter="my.module:Feed", symbols="A,B", first_ns=0, last_ns=10**18).load()
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "symbol string, ts_ns bigint, last_price double, last_quantity bigint"


def adapter(options: dict):
    module, name = options["adapter"].split(":")
    return getattr(importlib.import_module(module), name)


def vendor(options: dict, wanted: list[str]):
    """The vendor of the options, authenticated, connected and subscribed."""
    made = adapter(options)()
    made.authenticate(options)
    made.connect()
    made.subscribe(wanted)
    return made


def symbols(options: dict) -> list[str]:
    return [s for s in options.get("symbols", "").split(",") if s]


class VendorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vendor"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return History(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Live(dict(self.options))


class History(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in symbols(self.options)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        made = vendor(self.options, [partition.value])
        yield from map(tuple, made.fetch_historical(partition.value, int(self.options["first_ns"]), int(self.options["last_ns"])))


class Span(InputPartition):
    def __init__(self, symbol: str, after: int, until: int):
        self.symbol, self.after, self.until = symbol, after, until


class Live(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def begin(self) -> int:
        return int(self.options.get("after", 0))

    def initialOffset(self) -> dict:
        return {s: self.begin() for s in symbols(self.options)}

    def latestOffset(self) -> dict:
        now = int(adapter(self.options).position(self.options))
        return {s: now for s in symbols(self.options)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        spans = [Span(s, start.get(s, self.begin()), until) for s, until in end.items()]
        return [x for x in spans if x.after < x.until]

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from map(tuple, vendor(self.options, [partition.symbol]).fetch_live(partition.symbol, partition.after, partition.until))
