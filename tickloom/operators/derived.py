"""Normalised composite scores, sizing, decay, position gate and parameters from history."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickloom.functions.numeric import clamped, div, floor_to, ratio

#: Windows, gates and cost rates.
NORM_WINDOW, KELLY_GATE, SIZE, ODDS, SPREAD, STRONG = 252, 0.10, 100, 1.0, 1e-12, 1 + 1e-9
BAR_YEARS, DECAY_BASE, DECAY_COVERAGE, DECAY_VOLUME, DECAY_VARIANCE = 1 / 94_500, 0.10, 0.01, 0.0, 5.0
BROKERAGE, SELL_TAX, TICK, SLIP_TICKS = 20.0, 0.00025, 0.05, 2


def by_token() -> WindowSpec:
    return W.partitionBy("token").orderBy("ts_ns")


#: The slots of a bar's signals, in order.
SLOTS = ["ofi_norm", "trade_dir", "vpin", "kyle_lambda", "entropy", "log_return", "rv_ann", "bar_ofi"]


def signal_bundle(bars: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """The bars with all SLOTS: the tick signals as they stood after the bar's last tick (snap_ columns, by token and ts_ns), and
    the bar's own. Without snapshots (bars from candles) the tick signals and bar_ofi are 0."""
    names = {"ofi_norm": "snap_ofi", "trade_dir": "snap_direction", "vpin": "snap_vpin", "kyle_lambda": "snap_kyle", "entropy": "snap_entropy"}
    own = {
        "log_return": F.when(F.col("return_valid"), F.col("log_return")).otherwise(0.0),
        "rv_ann": F.when(F.col("rv_valid"), F.col("rv_sigma_ann")).otherwise(0.0),
    }
    if snapshots is None:
        return bars.withColumns(own | {c: F.lit(0.0) for c in [*names, "bar_ofi"]})
    joined = bars.join(snapshots.select("token", "ts_ns", *names.values()), ["token", "ts_ns"], "left")
    return joined.withColumns(own | {c: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for c, n in names.items()}).drop(*names.values())


def closing_snapshots(snapshots: DataFrame, width_ns: int, offset_ns: int = 0) -> DataFrame:
    """The tick signals of each bar (token, ts_ns) as they stood after its last tick."""
    row = F.struct(*[c for c in snapshots.columns if c.startswith("snap_")])
    bar = floor_to(F.col("ts_ns"), width_ns, offset_ns).alias("bar_ts")
    last = snapshots.groupBy("token", bar).agg(F.max_by(row, F.struct("ts_ns", "seq")).alias("r"))
    return last.select("token", F.col("bar_ts").alias("ts_ns"), "r.*")


def normalised(bars: DataFrame, signals: list[str], window: int = NORM_WINDOW) -> DataFrame:
    """z_<signal> and norm_valid: rolling z-scores; the raw value where a window has one row, 0 where it has no spread.

    A spread under SPREAD of the mean, the size of rounding, is none: numbers that are equal but for it have no spread. Two rows
    have theirs from their step, by the distances from the mean before and after it: scores of two rows may cancel out but for rounding,
    whose sign is then the action's.

    A token's first ``window`` rows take the sums so far, which a row adds to; only the rows beyond go over their whole window. Rows of
    tokens without any beyond stand alone there.
    """
    order = by_token()
    rows = bars.withColumns({"_row": F.row_number().over(order), "_all": F.count(F.lit(1)).over(W.partitionBy("token"))})
    rows = rows.withColumn("_apart", F.when(F.col("_all") > window, 0).otherwise(F.col("_row")))
    first, full = F.col("_row") <= window, W.partitionBy("token", "_apart").orderBy("ts_ns").rowsBetween(1 - window, 0)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    n = F.least(F.col("_row"), F.lit(window))
    own, out = {}, {}
    for s in signals:
        was = F.lag(s).over(order)
        step = F.col(s) - was
        own[f"_mean_{s}"] = F.when(first, F.avg(s).over(so_far)).otherwise(F.avg(s).over(full))
        spread = F.when(n == 2, F.sqrt((F.col(s) - (was + step / 2)) * step)).when(first, F.stddev_samp(s).over(so_far))
        own[f"_sd_{s}"] = spread.otherwise(F.stddev_samp(s).over(full))
        mean, sd = F.col(f"_mean_{s}"), F.col(f"_sd_{s}")
        out[f"z_{s}"] = F.when(n < 2, F.col(s)).when(sd > F.abs(mean) * SPREAD, (F.col(s) - mean) / sd).otherwise(0.0)
    return rows.withColumns(own).withColumns(out | {"norm_valid": n >= 2}).drop("_row", "_all", "_apart", *own)


def information_coefficients(bars: DataFrame, signals: list[str]) -> DataFrame:
    """slot, signal, ic: the correlation of each signal's z-score with the return of the token's next bar; 0 where there is none."""
    ahead = F.lead("log_return").over(by_token())
    rows = bars.withColumn("_next", ahead).where(F.col("norm_valid") & F.col("_next").isNotNull())
    each = rows.agg(*[F.coalesce(F.nanvl(F.corr(f"z_{s}", "_next"), F.lit(None)), F.lit(0.0)).alias(s) for s in signals])
    return each.select(F.posexplode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("ic")) for s in signals])).alias("slot", "_s")).select(
        F.col("slot").cast("long").alias("slot"), "_s.*"
    )


def weights_of(ics: DataFrame) -> DataFrame:
    """The coefficients (one row a slot) with their weight, as ``ic_weights`` gives it."""
    every = W.partitionBy()
    kept = F.greatest(F.col("ic"), F.lit(0.0))
    total = F.sum(kept).over(every)
    return ics.withColumn("weight", F.when(total > 0, kept / total).otherwise(1 / F.count(F.lit(1)).over(every)))


def ic_weights(ics: list[float]) -> list[float]:
    """Weights from information coefficients: negative ones count 0; equal weights if none is positive."""
    kept = [max(0.0, x) for x in ics]
    total = sum(kept)
    return [x / total for x in kept] if total > 0 else [1 / len(ics)] * len(ics)


def composite(bars: DataFrame, signals: list[str], weights: list[float], odds: float = ODDS) -> DataFrame:
    """score, quality, p_win, kelly_half of the z-scores; one is strong beyond 1 by more than rounding."""
    z = [F.col(f"z_{s}") for s in signals]
    score = sum((w * x for w, x in zip(weights[1:], z[1:], strict=True)), weights[0] * z[0])
    strong = sum((F.when(F.abs(x) > STRONG, 1).otherwise(0) for x in z[1:]), F.when(F.abs(z[0]) > STRONG, 1).otherwise(0))
    p = 1 / (1 + F.exp(-F.col("score")))
    return (
        bars.withColumn("score", score)
        .withColumn("quality", strong * 100.0 / len(signals))
        .withColumn("p_win", p)
        .withColumn("kelly_half", clamped((F.col("p_win") * (odds + 1) - 1) / odds / 2, 0.0, 1.0))
    )


def signal_decay(bars: DataFrame, coverage: int = 0) -> DataFrame:
    """decay rate, the level it leaves after a bar, and the half-life (infinite without decay)."""
    rate = DECAY_BASE + DECAY_COVERAGE * coverage + DECAY_VOLUME * F.col("volume") / 1e6 + DECAY_VARIANCE * F.col("rv_var")
    return (
        bars.withColumn("decay_rate", rate)
        .withColumn("decayed_level", F.col("level") * F.exp(-F.col("decay_rate") * BAR_YEARS))
        .withColumn("half_life", ratio(F.lit(math.log(2)), F.col("decay_rate") * BAR_YEARS, F.lit(float("inf"))))
    )


def position_gate(bars: DataFrame, gate: float = KELLY_GATE, size: int = SIZE) -> DataFrame:
    """position (0 or size) by the sizing gate, and the entry price of the island of bars that it is held for."""
    held = (F.col("kelly_half") >= gate).cast("int")
    change = F.when(F.col("held") != F.coalesce(F.lag("held").over(by_token()), F.lit(0)), 1).otherwise(0)
    island = W.partitionBy("token", "island").orderBy("ts_ns")
    return (
        bars.withColumn("held", held)
        .withColumn("change", change)
        .withColumn("island", F.sum("change").over(by_token().rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("position", F.col("held") * size)
        .withColumn("entry_price", F.when(F.col("held") == 1, F.first("close").over(island.rowsBetween(W.unboundedPreceding, 0))).otherwise(0.0))
        .drop("change", "held")
    )


def unrealised_pnl(price: Column, entry: Column, quantity: Column, direction: Column) -> Column:
    """Mark to market after the costs of entering and leaving."""
    slip = SLIP_TICKS * TICK * quantity
    leave = BROKERAGE + slip + F.when(direction > 0, SELL_TAX * price * quantity).otherwise(0.0)
    return quantity * (price - entry) * direction - (BROKERAGE + slip) - leave


def composite_signals(bars: DataFrame, gate: float = KELLY_GATE) -> DataFrame:
    """Signals of strategy 4: valid scores that pass the gate."""
    return bars.where(F.col("norm_valid") & (F.col("kelly_half") >= gate)).select(
        "token", "ts_ns", F.col("close").alias("price"), F.signum("score").cast("int").alias("action"),
        F.col("kelly_half").alias("confidence"), F.lit(4).alias("strategy_id"),
    )


def initial_parameters(returns: DataFrame, adv: DataFrame, window: int = NORM_WINDOW) -> DataFrame:
    """Per token, from its last returns and its volume: noise of the filter, drift and variance, volume bucket."""
    newest = W.partitionBy("token").orderBy(F.desc("ts_ns"))
    last = returns.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= window)
    stats = last.groupBy("token").agg(F.var_samp("log_return").alias("v"), F.avg("log_return").alias("drift"))
    var = F.when(F.col("v") > 0, F.col("v")).otherwise(1e-6)
    return stats.join(adv, "token").select(
        "token", "drift", var.alias("measure_noise"), (var * 0.01).alias("process_noise"),
        F.when(F.col("adv") > 0, F.greatest(F.lit(1), div(F.col("adv"), 50))).otherwise(F.lit(200_000)).alias("bucket"),
        (var * 252 * 375).alias("annual_variance"), F.sqrt(var * 252 * 375).alias("annual_sigma"),
    )


def exposure_thresholds(history: DataFrame, key: str, value: str) -> DataFrame:
    """5th and 95th percentile of past exposures, interpolated; +/- 1e6 with fewer than two."""
    both = F.percentile(value, F.array(F.lit(0.05), F.lit(0.95)))
    n = F.count(value)
    return history.groupBy(key).agg(
        F.when(n >= 2, both[0]).otherwise(-1e6).alias("low"), F.when(n >= 2, both[1]).otherwise(1e6).alias("high")
    )
