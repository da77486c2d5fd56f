"""Queries of the running operators by slices of time; their oracles are those of the operators over whole tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.numeric import quantised as q
from tickloom.operators import blocked as K
from tickloom.plans import bar_queries as BQ
from tickloom.plans import tick_queries as TQ
from tickloom.plans import trade_queries as RQ
from tickloom.sources import adapters as A

TICKS_NS, BARS_NS = A.DAY, 3 * A.DAY


def folded_bars(s, d):
    return BQ.live(s, d).select("token", "ts_ns", "close", "log_return", "return_valid", "rv_var", "rv_valid")


def equity(s, d):
    rows = K.running_sums(K.sliced(A.ticks(s, d), TICKS_NS), {"equity": F.col("last_price") - 250.0})
    return rows.select("token", "ts_ns", "seq", (F.col("equity") + 100_000.0).alias("equity"))


BAR = (["token", "ts_ns"], BARS_NS, ["ts_ns"])
QUERIES = {
    "c2_cumulative_direction_sliced": lambda s, d: K.cumulative_direction(A.ticks(s, d), TICKS_NS).select("token", "seq", "cum_direction"),
    "c4_cumulative_ofi_sliced": lambda s, d: K.cumulative_flow(A.ticks(s, d), TICKS_NS).select("token", "seq", F.col("cum_ofi").cast("long").alias("cum_ofi")),
    "c7_volume_clock_sliced": lambda s, d: K.volume_clock(A.ticks(s, d), TQ.SIZE, TICKS_NS).select("token", "seq", "buckets_completed", "bucket_closed"),
    "e3_kalman_filter_sliced": lambda s, d: BQ.rounded(K.kalman(folded_bars(s, d), *BAR), ["level", "kalman_gain"], "kalman_valid"),
    "e5_rsi_sliced": lambda s, d: BQ.rounded(K.rsi(folded_bars(s, d), *BAR), ["rsi"], "rsi_valid"),
    "e6_macd_sliced": lambda s, d: BQ.rounded(K.macd(folded_bars(s, d), *BAR), ["macd", "macd_signal", "macd_hist"], "macd_valid"),
    "e13_running_vwap_sliced": lambda s, d: K.running_vwap(BQ.bars(s, d), BARS_NS, ["ts_ns"]).select(
        "token", "ts_ns", q(F.col("run_vwap") + 1e-7, 3).alias("run_vwap")  # off the edges that whole cents lie on
    ),
    "h28_max_drawdown_sliced": lambda s, d: RQ.money(K.max_drawdown(equity(s, d), TICKS_NS), ["token"], ["max_drawdown", "max_drawdown_pct"], 3),
}
_ALL = {**TQ.ORACLES, **BQ.ORACLES, **RQ.ORACLES}
ORACLES = {name: _ALL[name.removesuffix("_sliced")] for name in QUERIES}
ORACLES["e13_running_vwap_sliced"] = ORACLES["e13_running_vwap_sliced"].replace("(run_vwap)", "(run_vwap + 1e-7::DOUBLE)")
