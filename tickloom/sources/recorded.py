"""A vendor of recorded ticks: a Parquet table of events stands in for a broker, one symbol for each user."""

from __future__ import annotations

import datetime

import pyarrow.dataset as ds

from tickloom.sources.binary import place

EPOCH = datetime.datetime(1970, 1, 1)


class Recorded:
    """Options: table (the path of a table of user_id, ts and value), position (how far, in ns)."""

    def authenticate(self, options: dict) -> None:
        self.path = options["table"]

    def connect(self) -> None:
        system, at = place(self.path)
        self.table = ds.dataset(at, filesystem=system, format="parquet")

    def subscribe(self, symbols: list[str]) -> None:
        self.symbols = set(symbols)

    @staticmethod
    def position(options: dict) -> int:
        return int(options["position"])

    def fetch_historical(self, symbol: str, first_ns: int, last_ns: int) -> list[tuple]:
        at = lambda ns: EPOCH + datetime.timedelta(microseconds=ns // 1000)
        wanted = (ds.field("user_id") == int(symbol)) & (ds.field("ts") >= at(first_ns)) & (ds.field("ts") <= at(last_ns))
        rows = self.table.to_table(columns=["ts", "value"], filter=wanted).sort_by("ts")
        micros = rows["ts"].cast("timestamp[us]").cast("int64").to_pylist()
        return [(symbol, t * 1000, v, 1) for t, v in zip(micros, rows["value"].to_pylist(), strict=True)]

    def fetch_live(self, symbol: str, after: int, until: int) -> list[tuple]:
        return self.fetch_historical(symbol, after, until - 1000)
