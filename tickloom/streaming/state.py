"""Streams with typed keyed state: folds, and a chain from signals to intents, fills, positions and the square-off.

Each key's state is a typed row of numbers and typed lists in the state store (RocksDB, which ``use_rocksdb`` sets), so that it can
be read from outside and evolves by column; a micro-batch loads what it needs of a key and no more. Timers on event time drop
the state of idle keys and close positions at the end of a session.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators import charges, folds, strategy
from tickloom.operators.portfolio import Position

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS, CLOSE_MS, IST_MS = 86_400_000, strategy.CLOSE_MINUTE * 60_000, strategy.IST_NS // 1_000_000


def use_rocksdb(spark: SparkSession) -> None:
    """Typed state needs this provider; other stateful operators work with it as well."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def typed(schema: str):
    """A function that makes a tuple of values fit a schema: the store takes a whole number in a column of doubles for a missing one."""
    makers = [{"double": float, "long": int, "bigint": int, "int": int}.get(t, lambda x: x) for _, t in folds.fields(schema)]
    return lambda values: tuple(None if v is None else make(v) for v, make in zip(values, makers, strict=True))


class Cells:
    """The state of several folds as one typed row, and a typed list for each of their lists."""

    def __init__(self, handle: StatefulProcessorHandle, made: list, extra: str):
        self.made = made
        self.names = [[n for n, _ in folds.fields(f.state)] if f.state else [] for f in made]
        schema = ", ".join([extra, *(f"f{i}_{n} {t}" for i, f in enumerate(made) if f.state for n, t in folds.fields(f.state))])
        self.extra, self.fit = len(folds.fields(extra)), typed(schema)
        self.row = handle.getValueState("cells", schema)
        self.fits = [{n: typed(t) for n, t in f.lists.items()} for f in made]
        self.lists = [{n: handle.getListState(f"f{i}_{n}", t) for n, t in f.lists.items()} for i, f in enumerate(made)]

    def fresh(self) -> list[dict]:
        return [f.init() for f in self.made]

    def load(self) -> tuple[list | None, list[dict] | None]:
        """What is held of the key, or None twice. Each call to the store is a message to it, so none is made for what can't be there."""
        self.held, row = set(), self.row.get()
        if row is None:
            return None, None
        row = list(row)
        extra, rest = row[: self.extra], iter(row[self.extra :])
        states = [{n: next(rest) for n in names} for names in self.names]
        for i, (state, own) in enumerate(zip(states, self.lists, strict=True)):
            for n, cell in own.items():
                state[n] = [r[0] if len(r) == 1 else None if all(x is None for x in r) else tuple(r) for r in cell.get()]
                if state[n]:
                    self.held.add((i, n))
        return extra, states

    def save(self, extra: list, states: list[dict]) -> None:
        self.row.update(self.fit([*extra, *(s[n] for s, names in zip(states, self.names, strict=True) for n in names)]))
        for i, (fold, state, own, fits) in enumerate(zip(self.made, states, self.lists, self.fits, strict=True)):
            for n, cell in own.items():
                width = len(folds.fields(fold.lists[n]))
                items = [fits[n](x if isinstance(x, (tuple, list)) else [x] * width if x is None else [x]) for x in state[n]]
                if items:
                    cell.put(items)
                elif (i, n) in self.held:
                    cell.clear()

    def drop(self) -> None:
        self.row.clear()
        for own in self.lists:
            for cell in own.values():
                cell.clear()


def in_order(rows: Iterator[Row], order: list[str]) -> list[dict]:
    """A key's rows of a micro-batch as dictionaries, in order."""
    return sorted((row.asDict() for row in rows), key=itemgetter(*order))


class Folded(StatefulProcessor):
    """The folds over the rows of a key in order; rows before the last one folded are left out."""

    def __init__(self, made: list, columns: list[str], order: dict[str, str], session: tuple[str, str] | None, idle_ms: int | None):
        self.made, self.columns, self.order, self.session, self.idle = made, columns, order, session, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        extra = [f"at_{c} {t}" for c, t in self.order.items()] + ([f"session {self.session[1]}"] if self.session else [])
        self.cells = Cells(handle, self.made, ", ".join(extra))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        made, n, last = Row(*self.columns), len(self.order), None
        extra, states = self.cells.load()
        for row in in_order(rows, list(self.order)):
            last = row["at_ms"] if self.idle and (last is None or row["at_ms"] > last) else last
            now = [row[c] for c in self.order] + ([row[self.session[0]]] if self.session else [])
            if extra is not None and now[:n] < extra[:n]:
                continue
            if states is None or self.session and now[-1] != extra[-1]:
                states = self.cells.fresh()
            extra = now
            folds.advance(self.made, states, row)
            yield made(*(row[c] for c in self.columns))
        if extra is not None:
            self.cells.save(extra, states)
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.cells.drop()
        return iter(())

    def close(self) -> None:
        pass


def folded(
    rows: DataFrame, made: list, keep: list[str], order: list[str], key: str = "token", session: str | None = None, at: str | None = None,
    late: str | None = "10 seconds", idle_ms: int | None = None,
) -> DataFrame:
    """The folds of the batch operators over a stream, with typed state.

    With ``session`` (a column) the state begins anew where its value changes. With ``at`` (a timestamp column) rows later than
    the watermark are dropped, the output can go on to further stateful operators, and, with ``idle_ms``, the state of a key expires
    once the watermark is so far after its last row. A stream that has a watermark already takes ``late`` None.
    """
    kinds = dict(rows.dtypes)
    keep = [*keep, *([at] if at and at not in keep else [])]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), *(f.outputs for f in made)])
    columns = [*keep, *(c for f in made for c, _ in folds.fields(f.outputs))]
    processor = Folded(made, columns, {c: kinds[c] for c in order}, (session, kinds[session]) if session else None, idle_ms)
    source = rows.withWatermark(at, late) if at and late else rows
    source = source.withColumn("at_ms", F.unix_millis(at)) if idle_ms else source
    return source.groupBy(key).transformWithState(processor, schema, "append", "EventTime" if at else "None", eventTimeColumnName=at or "")


def intents(signals: DataFrame, at: str = "ts", late: str | None = "10 seconds", hours: bool = False) -> DataFrame:
    """Order intents of a stream of signals (token, ts_ns, seq, action, confidence, price and the event time ``at``)."""
    out = folded(strategy.wanted(signals, hours), [strategy.Intents()], ["token", "ts_ns", "seq", "price", "confidence"], ["ts_ns", "seq"], at=at, late=late)
    return strategy.explained(out.where("traded").drop("traded"))


def fills(made: DataFrame, segment: int = 1, at: str = "ts") -> DataFrame:
    """The fills of a stream of intents: no state, as the charges are a function of the order."""
    orders = made.select(
        "token", at, "ts_ns", "seq", "side", F.col("qty").alias("units"), F.col("qty").cast("double").alias("quantity"), "price", F.lit(segment).alias("segment"),
        F.lit(1.0).alias("lot"),
    )
    return charges.simulate(orders, F.col("lot")).withColumn("price", F.col("fill"))


ACCOUNT = (
    "token long, ts timestamp, ts_ns long, seq long, kind string, quantity long, avg_cost double, realized double, fees double, lot double, segment int, cash_change double"
)


class Accounts(StatefulProcessor):
    """Positions after each fill, and their close by a timer at the end of the session."""

    COLUMNS = [c for c, _ in folds.fields(ACCOUNT)]

    def __init__(self, close_ms: int, every_ms: int, intraday: int, pnl_only: bool):
        self.close_ms, self.every, self.intraday, self.pnl_only = close_ms, every_ms, intraday, pnl_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = Cells(handle, [Position()], "price double, segment int, ts_ns long, seq long")

    def ends(self, ms: int) -> int:
        """The end of the session that a time falls in: the next close of the clock."""
        return ms + (self.close_ms - ms - 1) % self.every + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        made, fold = Row(*self.COLUMNS), self.cells.made[0]
        extra, states = self.cells.load()
        if extra is None:
            extra, states = [None, None, None, None], self.cells.fresh()
        for row in in_order(rows, ["ts_ns", "seq"]):
            newest = row["ts_ns"]
            if row["side"] is None:  # a tick
                if row["price"] > 0:
                    extra[0] = row["price"]
                continue
            extra[1:] = row["segment"], row["ts_ns"], row["seq"]
            now = fold.step(states[0], row)
            yield made(key[0], row["ts"], row["ts_ns"], row["seq"], "fill", now["quantity"], now["avg_cost"], now["realized"], now["fees"], row["lot"], row["segment"], 0.0)
        self.cells.save(extra, states)
        self.handle.registerTimer(self.ends(newest // 1_000_000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        extra, states = self.cells.load()
        if extra is not None:
            (price, segment, ts_ns, seq), (s,) = extra, states
            if segment is not None:
                closes = segment == self.intraday and s["q"] != 0
                mark = s["cost"] if price is None else price
                shares, lot, cost = s["q"] * s["lot"], s["lot"], s["cost"]
                if closes:
                    s["real"] += shares * (mark - cost)
                    s["q"], s["cost"] = 0, 0.0
                    self.cells.save([price, segment, ts_ns, seq], [s])
                cash = (shares * (mark - cost) if self.pnl_only else shares * mark) if closes else 0.0
                at = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=expiredTimerInfo.getExpiryTimeInMs())
                yield Row(*self.COLUMNS)(key[0], at, ts_ns, seq, "square_off", s["q"], s["cost"], s["real"], s["fees"], lot, segment, cash)

    def close(self) -> None:
        pass


def accounts(
    done: DataFrame, ticks: DataFrame, late: str | None = "10 seconds", close_ms: int = CLOSE_MS - IST_MS, every_ms: int = DAY_MS, intraday: int = 1, pnl_only: bool = False
) -> DataFrame:
    """Rows of ACCOUNT: the position of a token after each fill of a stream, and one row a session when it ends.

    Ticks (token, ts, ts_ns, seq, last_price) give the prices that positions of the ``intraday`` segment close at; without one they close
    at their average cost. A session ends every ``every_ms`` at ``close_ms`` of the clock in UTC, once the watermark has passed.
    """
    null = lambda kind: F.lit(None).cast(kind)
    both = done.select(
        "token", "ts", "ts_ns", "seq", F.col("side").cast("int").alias("side"), F.col("units").cast("long").alias("units"), "price", "total_charges",
        F.col("lot").cast("double").alias("lot"), F.col("segment").cast("int").alias("segment"),
    ).unionByName(
        ticks.select("token", "ts", "ts_ns", "seq", null("int").alias("side"), null("long").alias("units"), F.col("last_price").alias("price"),
                     null("double").alias("total_charges"), null("double").alias("lot"), null("int").alias("segment"))
    )
    processor = Accounts(close_ms, every_ms, intraday, pnl_only)
    source = both.withWatermark("ts", late) if late else both
    return source.groupBy("token").transformWithState(processor, ACCOUNT, "append", "EventTime", eventTimeColumnName="ts")
