"""From signals to order intents: sizing, hysteresis, risk gate and strategy positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import running_total
from tickloom.operators import folds

#: Sizing, trading thresholds, risk limits and the strategy's cost model.
UNITS, MIN_TRADE, HYSTERESIS = 100, 10, 0.05
LOSS_LIMIT, OPEN_MINUTE, CLOSE_MINUTE, IST_NS, MINUTE_NS = -50_000.0, 9 * 60 + 15, 15 * 60 + 30, 19_800_000_000_000, 60_000_000_000
FLAT, PCT, GST, SELL_TAX, SLIP = 20.0, 0.0003, 0.18, 0.00025, 0.1


def target(action: Column, confidence: Column) -> Column:
    """Units to hold for a signal, capped."""
    return (action * F.least(F.floor(UNITS * confidence + 0.5), F.lit(UNITS))).cast("long")


def market_open(ts_ns: Column) -> Column:
    """Whether a UTC time falls in trading hours (open inclusive, close exclusive)."""
    minute = F.floor(F.pmod(ts_ns + IST_NS, F.lit(86_400_000_000_000)) / MINUTE_NS)
    return (minute >= OPEN_MINUTE) & (minute < CLOSE_MINUTE)


def reason(before: Column, after: Column) -> Column:
    """1 entry, 2 exit, 3 scale in, 4 scale out, 5 reverse."""
    return (
        F.when(before == 0, 1).when(after == 0, 2)
        .when((before > 0) == (after > 0), F.when(F.abs(after) > F.abs(before), 3).otherwise(4)).otherwise(5)
    )


class Book:
    """A strategy's position of one token: entry price by volume, profit after the costs of every leg."""

    def __init__(self, quantity: int = 0, entry: float = 0.0, realized: float = 0.0):
        self.quantity, self.entry, self.realized = quantity, entry, realized

    def fill(self, n: int, price: float) -> None:
        size = abs(n)
        turnover = price * size
        self.realized -= SLIP * size + min(FLAT, turnover * PCT) * (1 + GST) + (turnover * SELL_TAX if n < 0 else 0.0)
        after = self.quantity + n
        if self.quantity * n >= 0:
            self.entry = (self.entry * abs(self.quantity) + price * size) / abs(after) if self.quantity else price
        else:
            way = 1 if self.quantity > 0 else -1
            self.realized += min(size, abs(self.quantity)) * (price - self.entry) * way
            if after * self.quantity < 0:
                self.entry = price
        self.quantity = after


def trades(before: int, desired: int, confidence: float) -> bool:
    """Whether a signal changes the position, and flips it, moves it by MIN_TRADE, or is HYSTERESIS away from it."""
    delta = desired - before
    moved = abs(delta) >= MIN_TRADE or abs(confidence - abs(before) / UNITS) >= HYSTERESIS
    return delta != 0 and (moved or before * desired < 0)


class Intents:
    """The position of a token after each signal, as a fold: ``traded`` tells the signals that become intents."""

    outputs = "before long, after long, realized double, traded boolean"
    state, lists = "quantity long, entry double, realized double", {}

    def init(self):
        return {"quantity": 0, "entry": 0.0, "realized": 0.0}

    def step(self, s, row):
        before = s["quantity"]
        go = trades(before, row["desired"], row["confidence"])
        if go:
            book = Book(**s)
            book.fill(row["desired"] - before, row["price"])
            s.update(vars(book))
        return {"before": before, "after": s["quantity"], "realized": s["realized"], "traded": go}


OUT = "token long, ts_ns long, seq long, before long, after long, price double, confidence double, realized double, gain double"


def wanted(signals: DataFrame, hours: bool = False) -> DataFrame:
    """The signals that may trade, with the units that they want to hold."""
    rows = signals.where("action <> 0").withColumn("desired", target(F.col("action"), F.col("confidence")))
    if hours:
        rows = rows.where(market_open(F.col("ts_ns")))
    return rows.withColumn("price", F.col("price").cast("double"))


def explained(made: DataFrame) -> DataFrame:
    """Intents with quantity, side and reason of their change from before to after."""
    delta = F.col("after") - F.col("before")
    return made.withColumns({"qty": F.abs(delta), "side": F.signum(delta).cast("int"), "reason": reason(F.col("before"), F.col("after"))})


def intents(signals: DataFrame, loss_limit: float | None = None, hours: bool = False) -> DataFrame:
    """Order intents from signals (token, ts_ns, seq, action, confidence, price).

    A signal trades if it changes the position and flips it, moves it by MIN_TRADE, or is HYSTERESIS away from it. With
    ``loss_limit`` trading stops once the realised profit of all tokens is not above it. Nothing trades after that, so
    nothing can lift it again: tokens fold in parallel as without a limit, and the intents up to the first that breaks it, in
    order of time, token and sequence, stay.
    """
    rows = wanted(signals, hours)

    def start():
        book = Book()

        def step(r):
            before = book.quantity
            if not trades(before, r.desired, r.confidence):
                return None
            was = book.realized
            book.fill(r.desired - before, r.price)
            return [(r.token, r.ts_ns, r.seq, before, book.quantity, r.price, r.confidence, book.realized, book.realized - was)]

        return step, lambda: ()

    made = folds.replay(rows, ["ts_ns", "seq"], ["token", "ts_ns", "seq", "desired", "confidence", "price"], start, OUT)
    if loss_limit is not None:
        at = F.struct("ts_ns", "token", "seq")
        total = running_total(made, "gain", ["ts_ns", "token", "seq"], "total")
        # One row: the first intent after which the limit is broken; none at all where nothing may be traded from the start.
        first = total.agg(F.min(F.when(F.col("total") <= loss_limit, at)).alias("broken"))
        made = made.join(F.broadcast(first), F.col("broken").isNull() | (at <= F.col("broken"))).drop("broken").where(F.lit(loss_limit < 0))
    return explained(made.drop("gain"))


def rounded_half_away(x: float) -> int:
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)
