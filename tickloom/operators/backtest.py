"""Backtest: ticks joined with the signals of their bar, strategies as folds, trades, equity and metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.numeric import floor_to, ratio
from tickloom.operators import folds
from tickloom.operators.strategy import HYSTERESIS, MIN_TRADE, UNITS, rounded_half_away

MINUTE_NS, DAY_NS = 60_000_000_000, 86_400_000_000_000
#: Annualisation of daily ratios, and where in a batch of ticks equity is sampled.
SQRT_YEAR, BATCH, SAMPLES = 15.8745, 1024, (0, 1000)


@dataclass(frozen=True)
class Config:
    capital: float = 1_000_000.0
    flat: float = 20.0
    exchange: float = 0.0000345
    gst: float = 0.18
    sebi: float = 0.000001
    slippage_bps: float = 2.0
    sell_tax: float = 0.00025
    brokerage_pct: float = 0.0003


def with_signals(ticks: DataFrame, signals: DataFrame, width_ns: int = MINUTE_NS, lag_bars: int = 0) -> DataFrame:
    """Ticks with the signals of their own bar, or of one before; the first of doubled signals counts, none gives nulls.

    Signals of one time count in order of seq, where they have one, and else of their values.
    """
    bar = floor_to(F.col("ts_ns"), width_ns)
    tie = ["seq"] if "seq" in signals.columns else sorted(set(signals.columns) - {"token", "ts_ns"})
    first = signals.withColumn("bar_ts", bar).withColumn(
        "rn", F.row_number().over(W.partitionBy("token", "bar_ts").orderBy("ts_ns", *tie))
    )
    if "seq" in signals.columns:
        first = first.drop("seq")
    first = first.where("rn = 1").drop("rn", "ts_ns").withColumn("bar_ts", F.col("bar_ts") + lag_bars * width_ns)
    return ticks.withColumn("bar_ts", bar).join(first, ["token", "bar_ts"], "left")


def asof_join(left: DataFrame, right: DataFrame, values: list[str]) -> DataFrame:
    """Left rows with the newest right values at or before their time: a union and a running last value, in one shuffle."""
    none = [F.lit(None).cast(dict(right.dtypes)[c]).alias(c) for c in values]
    extra = [c for c in left.columns if c not in ("token", "ts_ns")]
    a = left.select("token", "ts_ns", F.lit(1).alias("_side"), F.struct(*extra).alias("_row"), *none, F.lit(None).cast("long").alias("_at"))
    b = right.select("token", "ts_ns", F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *values, F.col("ts_ns").alias("_at"))
    w = W.partitionBy("token").orderBy("ts_ns", "_side").rowsBetween(W.unboundedPreceding, 0)
    held = F.last(F.when(F.col("_side") == 0, F.struct(*values, "_at")), ignorenulls=True).over(w)
    joined = a.unionByName(b).withColumn("_v", held).where("_side = 1")
    return joined.select("token", "ts_ns", *[F.col(f"_row.{c}").alias(c) for c in extra], *[F.col(f"_v.{c}").alias(c) for c in values])


def disorder(ticks: DataFrame) -> DataFrame:
    """Ticks that go back in time against the one before in their token's sequence: a replay needs none."""
    w = W.partitionBy("token").orderBy("seq")
    return ticks.withColumn("back_ns", F.lag("ts_ns").over(w) - F.col("ts_ns")).where("back_ns > 0")


def in_time(ticks: DataFrame) -> DataFrame:
    """The ticks as they are; reading one that goes back in time against the one before raises, as a replay clock does."""
    w = W.partitionBy("token").orderBy("seq")
    said = F.concat(F.lit("time goes back at token "), F.col("token").cast("string"), F.lit(", sequence "), F.col("seq").cast("string"))
    back = F.lag("ts_ns").over(w) > F.col("ts_ns")
    return ticks.withColumn("_back", back).withColumn("ts_ns", F.when(F.col("_back"), F.raise_error(said).cast("long")).otherwise(F.col("ts_ns"))).drop("_back")


def visible(ts_ns: Column, now_ns: Column | int) -> Column:
    """Whether a row may be seen at a time of the replay."""
    return ts_ns <= now_ns


def execution_price(price: Column, side: Column, cfg: Config = Config()) -> Column:  # noqa: B008
    """Price after slippage with the statutory charges folded in per unit."""
    slipped = price * (1 + side * cfg.slippage_bps / 10_000)
    rate = (cfg.exchange + cfg.sebi) * (1 + cfg.gst)
    return slipped * (1 + side * (rate + F.when(side < 0, cfg.sell_tax).otherwise(0.0)))


def cost_price(price: float, side: int, cfg: Config) -> float:
    slipped = price * (1 + side * cfg.slippage_bps / 10_000)
    return slipped * (1 + side * ((cfg.exchange + cfg.sebi) * (1 + cfg.gst) + (cfg.sell_tax if side < 0 else 0.0)))


#: Fixed values of the rule strategy: stop, bars until overbought exits and until any, rests after either, and entry levels.
STOP, LATE, LONGEST, REST_STOP, REST = 0.985, 30, 120, 30, 20
OVERBOUGHT, HIGH_BAND, LEAST_VOLUME, LOW_BAND, OVERSOLD = 75, 0.95, 100, 0.15, 25
DEEP_BAND, DEEP_RSI, DEEP_HIST, STAKE = 0.02, 40, -0.2, 100_000


class RuleStrategy:
    """Buys oversold bars; leaves by a stop, by overbought bars after a while, or by time, and then rests.

    A bar without a price trades nothing, but counts as held or rested.
    """

    columns = ("rsi", "rsi_valid", "macd_hist", "macd_valid", "pct_b", "bb_valid")

    def __init__(self):
        self.entry, self.held, self.units, self.rest = None, 0, 0, 0

    def leave(self, rest: int):
        self.entry, self.rest = None, rest
        return -1, self.units, 2

    def __call__(self, t):
        price = t.last_price
        signal = bool(t.rsi_valid is True)
        if self.entry is not None:
            self.held += 1
            if price <= 0:
                return None
            if price < self.entry * STOP:
                return self.leave(REST_STOP)
            late = self.held >= LATE and signal
            if late and (t.rsi > OVERBOUGHT or (t.bb_valid is True and t.pct_b > HIGH_BAND)) or self.held >= LONGEST:
                return self.leave(REST)
            return None
        if self.rest > 0:
            self.rest -= 1
            return None
        if price <= 0 or not signal or t.macd_valid is not True or t.volume <= LEAST_VOLUME:
            return None
        low_band = t.bb_valid is not True or t.pct_b < LOW_BAND
        oversold = t.rsi < OVERSOLD and t.macd_hist > 0 and low_band
        if oversold or (t.bb_valid is True and t.pct_b < DEEP_BAND and t.rsi < DEEP_RSI and t.macd_hist > DEEP_HIST):
            self.entry, self.held, self.units = price, 0, max(1, int(STAKE / price))
            return 1, self.units, 1
        return None


class CompositeStrategy:
    """Follows the sized composite score, with hysteresis against the size last traded."""

    columns = ("score", "kelly_half", "norm_valid")

    def __init__(self):
        self.quantity, self.last = 0, 0.0

    def __call__(self, t):
        if t.norm_valid is not True:
            return None
        wanted = (1 if t.score > 0 else -1) * rounded_half_away(UNITS * t.kelly_half)
        delta = wanted - self.quantity
        flips = self.quantity * wanted < 0
        if delta == 0 or not (flips or abs(delta) >= MIN_TRADE or abs(t.kelly_half - self.last) >= HYSTERESIS):
            return None
        code = 1 if self.quantity == 0 else 3 if flips else 4
        self.quantity, self.last = wanted, t.kelly_half
        return (1 if delta > 0 else -1), abs(delta), code


@dataclass
class Account:
    """Long positions of one token: an order against an open position, or an exit, closes all of it."""

    cfg: Config
    equity: float
    quantity: int = 0
    price: float = 0.0
    opened: int = 0
    events: list = field(default_factory=list)

    def brokerage(self, price: float) -> float:
        return min(self.cfg.flat, price * self.quantity * self.cfg.brokerage_pct) * (1 + self.cfg.gst)

    def order(self, token: int, ts: int, last: float, side: int, units: int, code: int) -> None:
        price = cost_price(last, side, self.cfg)
        if self.quantity == 0:
            if side > 0:
                self.quantity, self.price, self.opened = units, price, ts
        elif side < 0 or code == 2:
            gross = self.quantity * (price - self.price)
            fee = self.brokerage(self.price) + self.brokerage(price)
            self.equity += gross - fee
            self.events.append((token, "trade", ts, self.opened, self.price, price, self.quantity, gross, fee, gross - fee, None, None))
            self.events.append((token, "equity", ts, *[None] * 7, self.equity, None))
            self.quantity = 0


EVENTS = (
    "token long, kind string, ts_ns long, entry_ts long, entry_price double, exit_price double, qty long, gross_pnl double, "
    "commission double, net_pnl double, equity double, note string"
)


def simulate(joined: DataFrame, strategy, cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """Trades and equity points of every token, replayed in order; tokens run in parallel, and an open position is closed at the end.

    Rows are put in order of time first, so that a replay never goes back; ``in_time`` before it raises where they come out of order.

    A token whose rows the strategy can't take gives an event of kind error with what went wrong, and no more; the others go on.
    Each token's last event is of kind end, with what its account holds.
    """
    needed = ["token", "ts_ns", "seq", "last_price", "volume", *strategy.columns]

    def start():
        account, act = Account(cfg, cfg.capital), strategy()
        seen = {"n": 0, "row": None, "failed": False}

        def said() -> list[tuple]:
            out, account.events = account.events, []
            return out

        def step(row):
            if seen["failed"]:
                return ()
            try:
                if (order := act(row)) is not None and order[1]:
                    account.order(row.token, row.ts_ns, row.last_price, *order)
                if account.quantity and seen["n"] % BATCH in SAMPLES:
                    marked = account.equity + account.quantity * (row.last_price - account.price)
                    account.events.append((row.token, "equity", row.ts_ns, *[None] * 7, marked, None))
            except (TypeError, ValueError, ArithmeticError) as error:
                seen["failed"] = True
                account.events.append((row.token, "error", row.ts_ns, *[None] * 8, f"{type(error).__name__}: {error}"))
            seen["n"], seen["row"] = seen["n"] + 1, row
            return said()

        def finish():
            row = seen["row"]
            if account.quantity and not seen["failed"]:
                account.order(row.token, row.ts_ns, row.last_price, -1, account.quantity, 2)
            account.events.append((row.token, "end", row.ts_ns, *[None] * 7, account.equity, None))
            return said()

        return step, finish

    return folds.replay(joined, ["ts_ns", "seq"], needed, start, EVENTS)


def run_status(events: DataFrame, tokens: DataFrame) -> DataFrame:
    """token, status (ok or error), note of each token's run."""
    failed = events.where("kind = 'error'").groupBy("token").agg(F.min("note").alias("note"))
    return tokens.select("token").distinct().join(failed, "token", "left").select(
        "token", F.when(F.col("note").isNull(), "ok").otherwise("error").alias("status"), "note"
    )


def run_summary(events: DataFrame) -> DataFrame:
    """As ``run_status`` and ``trade_statistics`` in one aggregation over the events of all tokens, each of which has one at its end."""
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    own = events.select("token", "kind", "note", *[of("trade", c).alias(c) for c in ("net_pnl", "gross_pnl", "commission")])
    failed = F.min(of("error", "note"))
    stats = own.groupBy("token").agg(F.when(failed.isNull(), "ok").otherwise("error").alias("status"), failed.alias("note"), *trade_sums())
    return derived_statistics(stats)


def trade_sums() -> list[Column]:
    """Sums over the rows that have a net_pnl."""
    net = F.col("net_pnl")
    win, loss = F.when(net > 0, net), F.when(net < 0, net)
    return [
        F.count(net).alias("trades"), F.count(win).alias("wins"), F.count(loss).alias("losses"), F.sum("gross_pnl").alias("gross"),
        F.sum("commission").alias("commission"), F.sum(net).alias("net"), F.sum(win).alias("won"), F.sum(loss).alias("lost"),
        F.max(win).alias("largest_win"), F.min(loss).alias("largest_loss"),
    ]


def trade_statistics(trades: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Per token: counts, sums, averages, extremes, win rate, profit factor (infinite without losses), expectancy.

    A trade without profit or loss counts in ``trades`` only. Tokens without trades have zeros throughout.
    """
    stats = trades.groupBy("token").agg(*trade_sums())
    if tokens is not None:
        stats = tokens.select("token").distinct().join(stats, "token", "left")
    return derived_statistics(stats)


def derived_statistics(stats: DataFrame) -> DataFrame:
    out = stats.fillna(0)
    average_win, average_loss = ratio(F.col("won"), F.col("wins")), ratio(F.col("lost"), F.col("losses"))
    rate = ratio(F.col("wins").cast("double"), F.col("trades"))
    factor = F.when(F.col("lost") < 0, F.col("won") / -F.col("lost")).when(F.col("trades") > 0, float("inf")).otherwise(0.0)
    out = out.withColumns({"win_rate": rate, "average_win": average_win, "average_loss": average_loss, "profit_factor": factor})
    expected = F.col("win_rate") * F.col("average_win") + (1 - F.col("win_rate")) * F.col("average_loss")
    return out.withColumns({"average_trade": ratio(F.col("net"), F.col("trades")), "expectancy": F.when(F.col("trades") > 0, expected).otherwise(0.0)})


def max_drawdown(equity: DataFrame) -> DataFrame:
    """Largest fall from a running peak, and its share of that peak; the first of equal falls counts."""
    w = W.partitionBy("token").orderBy("ts_ns", "seq").rowsBetween(W.unboundedPreceding, 0)
    fell = equity.withColumn("peak", F.max("equity").over(w)).withColumn("fall", F.col("peak") - F.col("equity"))
    worst = F.max_by(F.struct("fall", "peak"), F.struct("fall", -F.col("ts_ns"), -F.col("seq")))
    return fell.groupBy("token").agg(worst.alias("m")).select(
        "token", F.col("m.fall").alias("max_drawdown"), F.when(F.col("m.peak") > 0, F.col("m.fall") / F.col("m.peak") * 100).otherwise(0.0).alias("max_drawdown_pct")
    )


def risk_ratios(equity: DataFrame) -> DataFrame:
    """Sharpe and Sortino ratios of daily returns; a day is 24 hours from where the last one ended, the open day doesn't count.

    Tokens without a closed day have 0.
    """

    def start():
        state = {"start": None, "last": 0.0, "before": 0.0}

        def step(r):
            out = ()
            if state["start"] is None:
                state.update(start=r.ts_ns, before=r.equity)
            elif r.ts_ns - state["start"] >= DAY_NS:
                if state["before"] > 0:
                    out = [(r.token, (state["last"] - state["before"]) / state["before"])]
                state.update(before=state["last"], start=r.ts_ns)
            state["last"] = r.equity
            return out

        return step, lambda: ()

    daily = folds.replay(equity, ["ts_ns", "seq"], ["token", "ts_ns", "seq", "equity"], start, "token long, r double")
    down = F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") * F.col("r")).otherwise(0.0)))
    stats = daily.groupBy("token").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("sd"), down.alias("dd"))
    stats = equity.select("token").distinct().join(stats, "token", "left").fillna(0.0)
    return stats.select("token", (ratio(F.col("m"), F.col("sd")) * SQRT_YEAR).alias("sharpe"), (ratio(F.col("m"), F.col("dd")) * SQRT_YEAR).alias("sortino"))


def total_return(final: Column, start: Column) -> Column:
    return ratio(final - start, start) * 100
