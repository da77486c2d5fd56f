"""Running state over a token's whole history without a task that holds it: scans by slices of time.

Rows are dealt by (token, slice of time). What a slice does to the state is summed up in one row: a sum, the last values, a
peak, or an affine or fractional map. These rows, one for each slice, are run through in order, and what stands before each slice is
joined back to its rows. So a token with far more ticks than any other still spreads over as many tasks as it has slices.

Every function gives what the window or fold of the same name gives, up to the rounding of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.numeric import div, ratio
from tickloom.operators import folds

HOUR = 3_600_000_000_000
ORDER = ["ts_ns", "seq"]
KEY = ["token", "_slice"]


def sliced(rows: DataFrame, width_ns: int = HOUR) -> DataFrame:
    return rows.withColumn("_slice", F.floor(F.col("ts_ns") / width_ns).cast("long"))


def within(order: list[str]) -> W:
    return W.partitionBy(*KEY).orderBy(*order)


def before_slices(totals: DataFrame, carries: dict[str, Callable]) -> DataFrame:
    """KEY and, for each column, what ``carries`` makes of it over the slices of the token before."""
    w = W.partitionBy("token").orderBy("_slice")
    return totals.select(*KEY, *[make(c, w).alias(f"_{c}_before") for c, make in carries.items()])


def running_sums(rows: DataFrame, sums: dict[str, Column], order: list[str] = ORDER) -> DataFrame:
    """The (sliced) rows with the running sum of each column over the token's history, the row included."""
    totals = rows.groupBy(*KEY).agg(*[F.sum(x).alias(c) for c, x in sums.items()])
    past = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = before_slices(totals, dict.fromkeys(sums, past))
    run = within(order).rowsBetween(W.unboundedPreceding, 0)
    own = rows.withColumns({c: F.sum(x).over(run) for c, x in sums.items()})
    joined = own.join(before, KEY)
    return joined.withColumns({c: F.col(c) + F.col(f"_{c}_before") for c in sums}).drop(*[f"_{c}_before" for c in sums])


def previous(rows: DataFrame, columns: list[str], order: list[str] = ORDER) -> DataFrame:
    """The (sliced) rows with ``previous_`` columns: the values of the token's row before, of an earlier slice if need be."""
    row = F.struct(*columns)
    last = rows.groupBy(*KEY).agg(F.max_by(row, F.struct(*order)).alias("row"))
    carried = before_slices(last, {"row": lambda c, w: F.lag(c).over(w)})
    w = within(order)
    own = rows.withColumn("_row", F.lag(row).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    joined = own.join(carried, KEY).withColumn("_row", F.when(F.col("_first"), F.col("_row_before")).otherwise(F.col("_row")))
    return joined.withColumns({f"previous_{c}": F.col(f"_row.{c}") for c in columns}).drop("_row", "_first", "_row_before")


def carried_on(rows: DataFrame, column: str, value: Column, order: list[str] = ORDER) -> DataFrame:
    """The (sliced) rows with the last value that is not null so far."""
    last = rows.withColumn("_v", value).groupBy(*KEY).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("v"))
    past = before_slices(last, {"v": lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))})
    run = within(order).rowsBetween(W.unboundedPreceding, 0)
    own = rows.withColumn(column, F.last(value, ignorenulls=True).over(run))
    return own.join(past, KEY).withColumn(column, F.coalesce(column, "_v_before")).drop("_v_before")


# Tick signals


def quoted(ticks: DataFrame, width_ns: int = HOUR) -> DataFrame:
    return previous(sliced(ticks, width_ns), ["bid_price", "ask_price", "bid_size", "ask_size"])


def cumulative_direction(ticks: DataFrame, width_ns: int = HOUR) -> DataFrame:
    """As ``ticks.trade_direction``: direction, direction_valid and cum_direction."""
    ask, bid = F.col("previous_ask_price"), F.col("previous_bid_price")
    way = F.when(F.col("last_price") >= ask, 1).when(F.col("last_price") <= bid, -1).otherwise(0)
    directed = quoted(ticks, width_ns).withColumn("direction", way).withColumn("direction_valid", ask.isNotNull())
    return running_sums(directed, {"cum_direction": F.col("direction")})


def cumulative_flow(ticks: DataFrame, width_ns: int = HOUR) -> DataFrame:
    """As ``ticks.order_flow``: ofi, ofi_valid and cum_ofi."""
    was = lambda c: F.col(f"previous_{c}")

    def side(name: str, better: Column, worse: Column) -> Column:
        size = F.col(f"{name}_size")
        return F.when(better, size).when(worse, -was(f"{name}_size")).otherwise(size - was(f"{name}_size"))

    bid = side("bid", F.col("bid_price") > was("bid_price"), F.col("bid_price") < was("bid_price"))
    ask = side("ask", F.col("ask_price") < was("ask_price"), F.col("ask_price") > was("ask_price"))
    flow = quoted(ticks, width_ns).withColumn("ofi", F.coalesce(bid - ask, F.lit(0))).withColumn("ofi_valid", was("bid_price").isNotNull())
    return running_sums(flow, {"cum_ofi": F.col("ofi")})


def volume_clock(ticks: DataFrame, size: int, width_ns: int = HOUR) -> DataFrame:
    """As ``ticks.volume_clock``: filled, buckets_completed and bucket_closed."""
    clocked = running_sums(sliced(ticks, width_ns), {"filled": F.col("last_quantity")})
    return clocked.withColumn("buckets_completed", div(F.col("filled"), size)).withColumn(
        "bucket_closed", F.col("buckets_completed") > div(F.col("filled") - F.col("last_quantity"), size)
    )


def running_vwap(candles: DataFrame, width_ns: int = HOUR, order: list[str] = ORDER) -> DataFrame:
    """run_vwap of candles: their volume-weighted close so far."""
    sums = running_sums(sliced(candles, width_ns), {"_pv": F.col("close") * F.col("volume"), "_v": F.col("volume")}, order)
    return sums.withColumn("run_vwap", ratio(F.col("_pv"), F.col("_v"))).drop("_pv", "_v")


def max_drawdown(equity: DataFrame, width_ns: int = HOUR) -> DataFrame:
    """As ``backtest.max_drawdown``: the peak before each slice is carried, the worst fall is a plain aggregate."""
    rows = sliced(equity, width_ns)
    peaks = rows.groupBy(*KEY).agg(F.max("equity").alias("peak"))
    before = before_slices(peaks, {"peak": lambda c, w: F.max(c).over(w.rowsBetween(W.unboundedPreceding, -1))})
    own = rows.withColumn("peak", F.max("equity").over(within(ORDER).rowsBetween(W.unboundedPreceding, 0)))
    fell = own.join(before, KEY).withColumn("peak", F.greatest("peak", "_peak_before")).withColumn("fall", F.col("peak") - F.col("equity"))
    worst = F.max_by(F.struct("fall", "peak"), F.struct("fall", -F.col("ts_ns"), -F.col("seq")))
    return fell.groupBy("token").agg(worst.alias("m")).select(
        "token", F.col("m.fall").alias("max_drawdown"), F.when(F.col("m.peak") > 0, F.col("m.fall") / F.col("m.peak") * 100).otherwise(0.0).alias("max_drawdown_pct")
    )


# Filters and smoothed means: the state after a row is an affine map of that before it, or, for the filter's variance, a
# quotient of two.


def by_slice(rows: DataFrame, order: list[str], columns: list[str], work: Callable, schema: str, keys: list[str] = KEY) -> DataFrame:
    """What ``work`` makes (a list of tuples) of the rows of each key, which come in order as a list of dictionaries."""
    kinds = folds.fields(schema)

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        out = list(zip(*made, strict=True)) or [()] * len(kinds)
        return pa.record_batch([pa.array(x, ARROW.get(t) or folds.ARROW[t]) for x, (_, t) in zip(out, kinds, strict=True)], names=[c for c, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            made, lists = [], [batch.column(c).to_pylist() for c in columns]
            at = zip(*(lists[columns.index(k)] for k in keys), strict=True)
            for key, values in zip(at, zip(*lists, strict=True), strict=True):
                if held and key != last:
                    made += work(held)
                    held = []
                held.append(dict(zip(columns, values, strict=True)))
                last = key
            # The slices that end within a batch go out together: there may be millions of small ones.
            yield batch_of(made)
        if held:
            yield batch_of(work(held))

    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


ARROW = {"array<double>": pa.list_(pa.float64())}


def carried_states(maps: DataFrame, start: list[float], fractional: bool = False) -> DataFrame:
    """KEY and the state (array) before each slice, from the slices' maps: rows of an affine map (a line of factors and a constant for
    each number of the state), or the four numbers of a fractional one."""
    k = len(start)

    def work(slices: list[dict]) -> list[tuple]:
        state, out = np.array(start), []
        for s in slices:
            out.append((s["token"], s["_slice"], state.tolist()))
            m = np.array(s["map"])
            if fractional:
                state = np.array([(m[0] * state[0] + m[1]) / (m[2] * state[0] + m[3])])
            else:
                m = m.reshape(k, k + 1)
                state = m[:, :k] @ state + m[:, k]
        return out

    return by_slice(maps, ["_slice"], [*KEY, "map"], work, "token long, _slice long, state array<double>", ["token"])


def smoothed(rows: DataFrame, fold, numbers: list[str], begun: Callable, keep: list[str], order: list[str]) -> DataFrame:
    """``keep`` and the outputs of a fold whose ``numbers`` follow affine maps; its other state follows from a row's place.

    ``rows`` are sliced and have n (the token's rows so far) and previous_close; ``begun(row)`` gives the other state before a row.
    """
    columns = list(dict.fromkeys([*KEY, *order, *keep, "close", "n", "previous_close"]))
    kinds = dict(rows.dtypes)

    def state_at(row: dict, values) -> dict:
        return fold.init() | begun(row) | dict(zip(numbers, values, strict=True))

    def summed(held: list[dict]) -> list[tuple]:
        def end(values, still: bool) -> list[float]:
            state = state_at(held[0] | ({"previous_close": 0.0} if still and held[0]["previous_close"] is not None else {}), values)
            for row in held:
                fold.step(state, row | {"close": 0.0} if still else row)
            return [state[c] for c in numbers]

        zero = [0.0] * len(numbers)
        # Factors come from steps without any input, so that no difference of large numbers is taken.
        factors = [end([float(i == j) for j in range(len(numbers))], True) for i in range(len(numbers))]
        constant = end(zero, False)
        lines = [[*(f[i] for f in factors), constant[i]] for i in range(len(numbers))]
        return [(held[0]["token"], held[0]["_slice"], [x for line in lines for x in line])]

    maps = by_slice(rows, order, columns, summed, "token long, _slice long, map array<double>")
    joined = rows.join(carried_states(maps, [0.0] * len(numbers)), KEY)
    outputs = [c for c, _ in folds.fields(fold.outputs)]

    def applied(held: list[dict]) -> list[tuple]:
        state, out = state_at(held[0], held[0]["state"]), []
        for row in held:
            made = fold.step(state, row)
            out.append(tuple([*(row[c] for c in keep), *(made[c] for c in outputs)]))
        return out

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), fold.outputs])
    return by_slice(joined, order, [*columns, "state"], applied, schema)


def numbered(bars: DataFrame, width_ns: int, order: list[str]) -> DataFrame:
    return running_sums(previous(sliced(bars, width_ns), ["close"], order), {"n": F.lit(1)}, order)


def rsi(bars: DataFrame, keep: list[str], width_ns: int = HOUR, order: list[str] = ORDER) -> DataFrame:
    """As the fold ``folds.Rsi``."""
    begun = lambda row: {"last": row["previous_close"], "n": max(0, row["n"] - 2)}
    return smoothed(numbered(bars, width_ns, order), folds.Rsi(), ["gain", "loss"], begun, keep, order)


def macd(bars: DataFrame, keep: list[str], width_ns: int = HOUR, order: list[str] = ORDER) -> DataFrame:
    """As the fold ``folds.Macd``."""
    begun = lambda row: {"n": row["n"] - 1, "m": max(0, row["n"] - folds.SLOW)}
    return smoothed(numbered(bars, width_ns, order), folds.Macd(), ["fast", "slow", "signal"], begun, keep, order)


def kalman(bars: DataFrame, keep: list[str], width_ns: int = HOUR, order: list[str] = ORDER) -> DataFrame:
    """As the fold ``folds.Kalman``: first the variance before each slice, by products of fractional maps, then, with the gains that
    follow, the level, by affine ones.

    Bars have log_return, return_valid, rv_var and rv_valid.
    """
    rows = carried_on(sliced(bars, width_ns), "_var", F.when(F.col("rv_valid") & (F.col("rv_var") > 0), F.col("rv_var")), order)
    rows = running_sums(rows, {"_n": F.when(F.col("return_valid"), 1).otherwise(0)}, order)
    noise = lambda v: (folds.PROCESS_NOISE, folds.MEASURE_NOISE) if v is None else (v * folds.NOISE_SHARE, v)
    used = list(dict.fromkeys([*KEY, *order, "return_valid", "_var", "_n"]))
    columns = list(dict.fromkeys([*used, "log_return", *keep]))
    kinds = dict(rows.dtypes)

    def variances(held: list[dict]) -> list[tuple]:
        a, b, c, d = 1.0, 0.0, 0.0, 1.0
        for row in held:
            if row["return_valid"]:
                q, r = noise(row["_var"])
                if row["_n"] == 1:
                    a, b, c, d = c, d, c, d
                else:
                    a, b, c, d = r * a + r * q * c, r * b + r * q * d, a + (q + r) * c, b + (q + r) * d
                top = max(abs(a), abs(b), abs(c), abs(d))
                a, b, c, d = a / top, b / top, c / top, d / top
        return [(held[0]["token"], held[0]["_slice"], [a, b, c, d])]

    maps = "token long, _slice long, map array<double>"
    first = carried_states(by_slice(rows, order, used, variances, maps), [0.0], fractional=True)
    rows = rows.join(first.select(*KEY, F.get("state", F.lit(0)).alias("_p")), KEY)

    def begun(row: dict, level: float) -> dict:
        q, r = noise(None)
        return {"level": level, "p": row["_p"], "n": row["_n"] - int(row["return_valid"]), "q": q, "r": r}

    def noted(row: dict) -> dict:
        """The row with the noise that holds at it, also where its own variance is not valid."""
        row["rv_valid"], row["rv_var"] = row["_var"] is not None, row["_var"] or 0.0
        return row

    fold = folds.Kalman()

    def levels(held: list[dict]) -> list[tuple]:
        state, factor = begun(held[0], 0.0), 1.0
        for row in held:
            made = fold.step(state, noted(row))
            if row["return_valid"]:
                factor *= 0.0 if row["_n"] == 1 else 1 - made["kalman_gain"]
        return [(held[0]["token"], held[0]["_slice"], [factor, state["level"]])]

    second = carried_states(by_slice(rows, order, [*used, "log_return", "_p"], levels, maps), [0.0])
    rows = rows.join(second.select(*KEY, F.get("state", F.lit(0)).alias("_level")), KEY)

    def applied(held: list[dict]) -> list[tuple]:
        state, out = begun(held[0], held[0]["_level"]), []
        for row in held:
            kept = [row[c] for c in keep]
            made = fold.step(state, noted(row))
            out.append(tuple([*kept, made["level"], made["kalman_gain"], made["kalman_valid"]]))
        return out

    return by_slice(rows, order, [*columns, "_p", "_level"], applied, ", ".join([*(f"{c} {kinds[c]}" for c in keep), fold.outputs]))
