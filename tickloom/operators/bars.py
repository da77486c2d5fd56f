"""Time bars from ticks, and synthetic ticks from candles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.numeric import div, floor_to, ratio

MINUTE = 60_000_000_000
LAST_MOMENT = 59_999_000_000


def bars(directed: DataFrame, width_ns: int = MINUTE, offset_ns: int = 0, emit_open_bar: bool = False) -> DataFrame:
    """One row for each token and bar: prices, volume, volume by direction, tick count, and open_interest of its last tick.

    Ticks without open interest have 0.

    The turnover behind vwap is summed in order of time and seq, so that it is the same to the last bit however the ticks are split.

    The last bar of a token is open: nothing after it has closed it, so it is dropped by default.
    """
    at = F.struct("ts_ns", "seq")
    interest = F.col("open_interest") if "open_interest" in directed.columns else F.lit(0.0)
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("last_quantity")).otherwise(0))
    in_order = W.partitionBy("token", "bar_ts").orderBy("ts_ns", "seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = (
        directed.withColumn("bar_ts", floor_to(F.col("ts_ns"), width_ns, offset_ns))
        .withColumn("pv", F.sum(F.col("last_price") * F.col("last_quantity")).over(in_order))
        .groupBy("token", "bar_ts")
        .agg(
            F.min_by("last_price", at).alias("open"), F.max("last_price").alias("high"), F.min("last_price").alias("low"),
            F.max_by("last_price", at).alias("close"), F.sum("last_quantity").alias("volume"),
            F.max("pv").alias("pv"), side(1).alias("buy_volume"),
            side(-1).alias("sell_volume"), F.count(F.lit(1)).alias("tick_count"), F.max_by(interest, at).alias("open_interest"),
        )
        .withColumn("vwap", ratio(F.col("pv"), F.col("volume"), F.col("close")))
        .withColumn("bar_ofi", ratio((F.col("buy_volume") - F.col("sell_volume")).cast("double"), F.col("volume")))
        .drop("pv")
    )
    if emit_open_bar:
        return out
    newest = F.max("bar_ts").over(W.partitionBy("token"))
    return out.withColumn("newest", newest).where("bar_ts < newest").drop("newest")


def arrival_minutes(ticks: DataFrame, width_ns: int = MINUTE, offset_ns: int = 0) -> DataFrame:
    """Ticks with the time of the bar that is open when they arrive, as ts_ns: the newest minute of the token's ticks so far, in order of seq.

    A late tick so goes into the bar that is open, and never opens a closed one again.
    """
    arrived = W.partitionBy("token").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return ticks.withColumn("ts_ns", F.max(floor_to(F.col("ts_ns"), width_ns, offset_ns)).over(arrived))


def arrival_bars(directed: DataFrame, width_ns: int = MINUTE, offset_ns: int = 0, emit_open_bar: bool = False) -> DataFrame:
    """As ``bars``, of ticks in order of arrival (seq): the first and last to arrive open and close a bar."""
    return bars(arrival_minutes(directed, width_ns, offset_ns), width_ns, 0, emit_open_bar)


def candle_ticks(candles: DataFrame, offset_ns: int = LAST_MOMENT) -> DataFrame:
    """Four ticks for each candle (open, high, low, close), all stamped near the end of its interval."""
    return candles.select(
        "token", "seq", (F.col("ts_ns") + offset_ns).alias("ts_ns"), F.posexplode(F.array("open", "high", "low", "close")).alias("leg", "last_price")
    )


def backfill_ticks(candles: DataFrame) -> DataFrame:
    """Four backtest ticks for each candle with a quarter of its volume, a narrow spread and the running vwap."""
    run = W.partitionBy("token").orderBy("ts_ns", "seq").rowsBetween(W.unboundedPreceding, 0)
    vwap = ratio(F.sum(F.col("close") * F.col("volume")).over(run), F.sum("volume").over(run))
    marked = candles.withColumn("vwap", vwap)
    return marked.select(
        "token", "seq", (F.col("ts_ns") + LAST_MOMENT).alias("ts_ns"), "vwap", div(F.col("volume"), 4).alias("volume"),
        F.posexplode(F.array("open", "high", "low", "close")).alias("leg", "last_price"),
    ).withColumns({"bid_price": F.col("last_price") * 0.9999, "ask_price": F.col("last_price") * 1.0001})


def close_ticks(candles: DataFrame, tokens: DataFrame) -> DataFrame:
    """One backtest tick for each candle of a known symbol, at its close, with a spread from its range."""
    spread = F.greatest(F.col("high") - F.col("low"), F.col("close") * 0.0002) * 0.1
    return candles.join(tokens, "symbol").select(
        "symbol", "token", "ts_ns", F.col("close").alias("last_price"), (F.col("close") - spread).alias("bid_price"),
        (F.col("close") + spread).alias("ask_price"),
        ((F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4).alias("vwap"), "volume",
    )
