"""Sequential operators as folds: one interface for batch and streams.

A fold has ``init()`` and ``step(state, row) -> out``; ``row`` and ``out`` are dictionaries. Its state is a dictionary of the
numbers that ``state`` lists with their types, and of the ``lists``, whose items are a number or a row of numbers. ``run`` folds the rows of each token in order in one pass for any number of folds, so that
they share a shuffle; the streaming module runs the same folds over a stored state.

Rows are dealt by key, sorted by Spark (which spills), and streamed through Arrow batches with the state carried along: no
task holds a token's history, and thousands of small tokens cost no more than one large one.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Filter noise, change detection, and periods.
PROCESS_NOISE, MEASURE_NOISE, NOISE_SHARE = 1e-5, 1e-3, 0.01
CUSUM_COST, CUSUM_PENALTY = 1e-4, 0.5
RSI_PERIOD, FAST, SLOW, SIGNAL = 14, 12, 26, 9


class Kalman:
    """Local level of returns; with a valid rv_var the noise follows the bar's variance, and stays so until the next.

    A bar without a valid return leaves the filter as it is and shows nothing.
    """

    outputs = "level double, kalman_gain double, kalman_valid boolean"
    state, lists = "level double, p double, n long, q double, r double", {}

    def init(self):
        return {"level": 0.0, "p": 0.0, "n": 0, "q": PROCESS_NOISE, "r": MEASURE_NOISE}

    def step(self, s, row):
        if row.get("rv_valid") and row["rv_var"] > 0:
            s["q"], s["r"] = row["rv_var"] * NOISE_SHARE, row["rv_var"]
        if not row.get("return_valid", True):
            return {"level": 0.0, "kalman_gain": 0.0, "kalman_valid": False}
        r = row["log_return"]
        s["n"] += 1
        if s["n"] == 1:
            s["level"], s["p"] = r, 1.0
            return {"level": r, "kalman_gain": 0.0, "kalman_valid": False}
        ahead = s["p"] + s["q"]
        gain = ahead / (ahead + s["r"])
        s["level"] += gain * (r - s["level"])
        s["p"] = (1 - gain) * ahead
        return {"level": s["level"], "kalman_gain": gain, "kalman_valid": True}


class Cusum:
    """Two-sided change detection on the filtered level of the same bar and its variance; both must be valid."""

    outputs = "cusum_up double, cusum_down double, cusum_threshold double, cusum_fired int, cusum_valid boolean"
    state, lists = "up double, down double", {}

    def init(self):
        return {"up": 0.0, "down": 0.0}

    def step(self, s, row):
        level, var, r = row["level"], row["rv_var"], row["log_return"]
        out = lambda h, fired, ok: {
            "cusum_up": s["up"], "cusum_down": s["down"], "cusum_threshold": h, "cusum_fired": fired, "cusum_valid": ok
        }
        if not (row.get("kalman_valid", True) and row.get("rv_valid", True)):
            return {"cusum_up": 0.0, "cusum_down": 0.0, "cusum_threshold": 0.0, "cusum_fired": 0, "cusum_valid": False}
        if var <= 0 or level == 0:
            return out(math.inf, 0, False)
        score, penalty = level * r / var, level * level / (2 * var)
        s["up"] = max(0.0, s["up"] + score - penalty)
        s["down"] = max(0.0, s["down"] - score - penalty)
        h = math.log(abs(level) / CUSUM_COST) - CUSUM_PENALTY * var / (level * level)
        if h <= 0:
            return out(h, 0, False)
        fired = 0
        if s["up"] >= h:
            fired, s["up"] = 1, 0.0
        elif s["down"] >= h:
            fired, s["down"] = -1, 0.0
        return out(h, fired, True)


class Rsi:
    """Relative strength with Wilder's smoothing, seeded by the mean of the first changes."""

    outputs = "rsi double, rsi_valid boolean"
    state, lists = "last double, n long, gain double, loss double", {}

    def init(self):
        return {"last": None, "n": 0, "gain": 0.0, "loss": 0.0}

    def step(self, s, row):
        close, n = row["close"], RSI_PERIOD
        if s["last"] is None:
            s["last"] = close
            return {"rsi": 0.0, "rsi_valid": False}
        change, s["last"] = close - s["last"], close
        up, down = max(change, 0.0), max(-change, 0.0)
        s["n"] += 1
        if s["n"] <= n:
            s["gain"] += up / n
            s["loss"] += down / n
        else:
            s["gain"] = s["gain"] * ((n - 1) / n) + up / n
            s["loss"] = s["loss"] * ((n - 1) / n) + down / n
        if s["n"] < n:
            return {"rsi": 0.0, "rsi_valid": False}
        value = 100.0 if s["loss"] < 1e-10 else 100 - 100 / (1 + s["gain"] / s["loss"])
        return {"rsi": value, "rsi_valid": True}


class Macd:
    """Difference of two exponential means and its signal line, each seeded by a simple mean."""

    outputs = "macd double, macd_signal double, macd_hist double, macd_valid boolean"
    state, lists = "n long, fast double, slow double, m long, signal double", {}

    def init(self):
        return {"n": 0, "fast": 0.0, "slow": 0.0, "m": 0, "signal": 0.0}

    @staticmethod
    def mean(value, x, n, period):
        if n <= period:
            return value + x / period
        return value + (x - value) * (2 / (period + 1))

    def step(self, s, row):
        s["n"] += 1
        s["fast"] = self.mean(s["fast"], row["close"], s["n"], FAST)
        s["slow"] = self.mean(s["slow"], row["close"], s["n"], SLOW)
        if s["n"] < SLOW:
            return {"macd": 0.0, "macd_signal": 0.0, "macd_hist": 0.0, "macd_valid": False}
        macd = s["fast"] - s["slow"]
        s["m"] += 1
        s["signal"] = self.mean(s["signal"], macd, s["m"], SIGNAL)
        if s["m"] < SIGNAL:
            return {"macd": macd, "macd_signal": 0.0, "macd_hist": 0.0, "macd_valid": False}
        return {"macd": macd, "macd_signal": s["signal"], "macd_hist": macd - s["signal"], "macd_valid": True}


class Volatility:
    """Sample variance of the last valid returns, as the live window operator gives it, with bounded state."""

    outputs = "rv_var double, rv_sigma_ann double, rv_valid boolean"
    state, lists = "", {"r": "x double"}

    def __init__(self, window: int = 20, annual: float = 307.4085110396682):
        self.window, self.annual = window, annual

    def init(self):
        return {"r": []}

    def step(self, s, row):
        if not row["return_valid"]:
            return {"rv_var": 0.0, "rv_sigma_ann": 0.0, "rv_valid": False}
        s["r"] = [*s["r"][1 - self.window :], row["log_return"]]
        var = sample_variance(s["r"])
        return {"rv_var": var, "rv_sigma_ann": math.sqrt(var) * self.annual, "rv_valid": len(s["r"]) >= 2}


class Normaliser:
    """Rolling z-scores of signals, as the window operator gives them, with bounded state."""

    def __init__(self, signals: list[str], window: int = 252, spread: float = 1e-12):
        self.signals, self.window, self.spread = signals, window, spread
        self.outputs = ", ".join([*(f"z_{s} double" for s in signals), "norm_valid boolean"])
        self.state, self.lists = "", {"rows": ", ".join(f"x{i} double" for i in range(len(signals)))}

    def init(self):
        return {"rows": []}

    def step(self, s, row):
        s["rows"] = [*s["rows"][1 - self.window :], [row[x] for x in self.signals]]
        n, out = len(s["rows"]), {}
        for i, name in enumerate(self.signals):
            column = [r[i] for r in s["rows"]]
            mean, sd = math.fsum(column) / n, math.sqrt(sample_variance(column))
            out[f"z_{name}"] = column[-1] if n < 2 else (column[-1] - mean) / sd if sd > abs(mean) * self.spread else 0.0
        return out | {"norm_valid": n >= 2}


class Flow:
    """Direction of trades and order flow against the quotes of the tick before, with their running sums."""

    outputs = "direction int, direction_valid boolean, cum_direction long, ofi long, ofi_valid boolean, cum_ofi long, ofi_norm double"
    state, lists = "bid double, ask double, bid_size long, ask_size long, directions long, flows long", {}

    def init(self):
        return {"bid": None, "ask": None, "bid_size": 0, "ask_size": 0, "directions": 0, "flows": 0}

    def step(self, s, row):
        known = s["bid"] is not None
        way = flow = 0
        if known:
            way = 1 if row["last_price"] >= s["ask"] else -1 if row["last_price"] <= s["bid"] else 0
            bid = row["bid_size"] if row["bid_price"] > s["bid"] else -s["bid_size"] if row["bid_price"] < s["bid"] else row["bid_size"] - s["bid_size"]
            ask = row["ask_size"] if row["ask_price"] < s["ask"] else -s["ask_size"] if row["ask_price"] > s["ask"] else row["ask_size"] - s["ask_size"]
            flow = bid - ask
        s.update(bid=row["bid_price"], ask=row["ask_price"], bid_size=row["bid_size"], ask_size=row["ask_size"])
        s["directions"] += way
        s["flows"] += flow
        quoted = row["bid_size"] + row["ask_size"]
        return {
            "direction": way, "direction_valid": known, "cum_direction": s["directions"], "ofi": flow, "ofi_valid": known, "cum_ofi": s["flows"],
            "ofi_norm": min(1.0, max(-1.0, flow / quoted)) if quoted else 0.0,
        }


class ArrivalBars:
    """The bar that a tick's arrival closes: a tick of a later minute closes the open bar, any other goes into it, late ones too.

    A row tells by ``bar_closed`` whether it has closed one; the other outputs are that bar's, or null.
    """

    outputs = (
        "bar_closed boolean, bar_ts long, open double, high double, low double, close double, volume long, vwap double, buy_volume long, sell_volume long, "
        "tick_count long, open_interest double"
    )
    state, lists = "ts long, first double, top double, low double, last double, volume long, pv double, buys long, sells long, n long, interest double", {}
    NAMES = [part.split()[0] for part in outputs.split(",")][1:]

    def __init__(self, width_ns: int = 60_000_000_000, offset_ns: int = 0):
        self.width, self.offset = width_ns, offset_ns

    def init(self):
        return {"ts": None, "first": 0.0, "top": 0.0, "low": 0.0, "last": 0.0, "volume": 0, "pv": 0.0, "buys": 0, "sells": 0, "n": 0, "interest": 0.0}

    def step(self, s, row):
        price, size, way = row["last_price"], row["last_quantity"], row.get("direction", 0)
        ts = (row["ts_ns"] + self.offset) // self.width * self.width
        out = {"bar_closed": False} | dict.fromkeys(self.NAMES)
        if s["ts"] is not None and ts > s["ts"]:
            vwap = s["pv"] / s["volume"] if s["volume"] else s["last"]
            bar = (s["ts"], s["first"], s["top"], s["low"], s["last"], s["volume"], vwap, s["buys"], s["sells"], s["n"], s["interest"])
            out = {"bar_closed": True} | dict(zip(self.NAMES, bar, strict=True))
            s.update(self.init())
        if s["ts"] is None:
            s.update(ts=ts, first=price, top=price, low=price)
        s["top"], s["low"], s["last"] = max(s["top"], price), min(s["low"], price), price
        s["volume"] += size
        s["pv"] += price * size
        s["buys"] += size if way > 0 else 0
        s["sells"] += size if way < 0 else 0
        s["n"] += 1
        s["interest"] = row.get("open_interest") or 0.0
        return out


class KyleLambda:
    """Price change on order flow through the origin over the last contributions, with bounded state."""

    outputs = "kyle_lambda double, kyle_valid boolean"
    state, lists = "price double", {"pairs": "dp double, x double"}

    def __init__(self, window: int = 20):
        self.window = window

    def init(self):
        return {"price": None, "pairs": []}

    def step(self, s, row):
        pair = None if s["price"] is None else (row["last_price"] - s["price"], float(row["ofi"]))
        s["price"] = row["last_price"]
        s["pairs"] = [*s["pairs"][1 - self.window :], pair]
        held = [p for p in s["pairs"] if p is not None]
        square = sum(x * x for _, x in held)
        return {"kyle_lambda": sum(d * x for d, x in held) / square if square else 0.0, "kyle_valid": len(held) == self.window}


class Vpin:
    """The volume clock and the metric of the last closed bucket (null before the first), with bounded state."""

    outputs = "buckets_completed long, bucket_closed boolean, vpin double"
    state, lists = "filled long, signed long, done long, vpin double", {"held": "x long"}

    def __init__(self, size: int, buckets: int = 50):
        self.size, self.buckets = size, buckets

    def init(self):
        return {"filled": 0, "signed": 0, "done": 0, "held": [], "vpin": None}

    def step(self, s, row):
        left, before = row["last_quantity"], s["done"]
        while left > 0:
            part = min(left, self.size - s["filled"])
            s["filled"] += part
            s["signed"] += row["direction"] * part
            left -= part
            if s["filled"] == self.size:
                s["held"] = [*s["held"][1 - self.buckets :], abs(s["signed"])]
                s["filled"], s["signed"], s["done"] = 0, 0, s["done"] + 1
                s["vpin"] = min(1.0, max(0.0, sum(s["held"]) / (len(s["held"]) * self.size)))
        return {"buckets_completed": s["done"], "bucket_closed": s["done"] > before, "vpin": s["vpin"]}


def sample_variance(values: list[float]) -> float:
    if len(values) < 2:
        return 0.0
    mean = math.fsum(values) / len(values)
    return math.fsum((x - mean) ** 2 for x in values) / (len(values) - 1)


def advance(folds, states, row: dict) -> dict:
    """The row with the outputs of all folds in order; each sees what those before it put out."""
    for fold, state in zip(folds, states, strict=True):
        row.update(fold.step(state, row))
    return row


ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def fields(schema: str) -> list[tuple[str, str]]:
    """Names and types of a flat schema in text form."""
    return [tuple(part.split()) for part in schema.split(",")]


def in_order(df: DataFrame, key: str, order: list[str], work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` over the batches of each partition, in which the rows of a key stand together and in order."""
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(work, schema)


def run(df: DataFrame, folds: list, keep: list[str], order: list[str], key: str = "token") -> DataFrame:
    """``keep`` and the folds' outputs for each row, folded in order within each key: one pass."""
    kinds = dict(df.dtypes)
    made = [f for fold in folds for f in fields(fold.outputs)]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), *(f"{c} {t}" for c, t in made)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, last = [], None
        for batch in batches:
            names, out = batch.schema.names, [[] for _ in made]
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                if not states or row[key] != last:
                    states, last = [f.init() for f in folds], row[key]
                advance(folds, states, row)
                for column, (c, _) in zip(out, made, strict=True):
                    column.append(row[c])
            new = [pa.array(x, ARROW[t]) for x, (_, t) in zip(out, made, strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in keep), *new], names=[*keep, *(c for c, _ in made)])

    return in_order(df, key, order, work, schema)


def replay(df: DataFrame, order: list[str], columns: list[str], start: Callable, schema: str, key: str = "token") -> DataFrame:
    """Events of a replay in order within each key. ``start()`` gives a pair of functions: one takes a row (a named tuple of
    ``columns``), the other none, at the end of the key; both return the events (tuples of ``schema``) that follow."""
    from collections import namedtuple

    kinds = fields(schema)
    Row = namedtuple("Row", columns)  # noqa: N806

    def batch_of(events: list[tuple]) -> pa.RecordBatch:
        rows = zip(*events, strict=True) if events else [[] for _ in kinds]
        return pa.record_batch([pa.array(list(x), ARROW[t]) for x, (_, t) in zip(rows, kinds, strict=True)], names=[c for c, _ in kinds])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, finish, last = None, None, None
        at = columns.index(key)
        for batch in batches:
            events: list[tuple] = []
            for values in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if step is None or values[at] != last:
                    events += finish() if finish else ()
                    (step, finish), last = start(), values[at]
                events += step(Row(*values)) or ()
            yield batch_of(events)
        if finish:
            yield batch_of(list(finish()))

    return in_order(df.select(*dict.fromkeys([*columns, *order])), key, order, work, schema)


def dump(states) -> bytes:
    return pickle.dumps(states)


def load(raw: bytes):
    return pickle.loads(raw)
