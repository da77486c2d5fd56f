"""Tick-level order-flow operators, all as window expressions over one partitioning by token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickloom.functions.numeric import clamped, div, ratio

#: Thresholds and windows.
OFI_SIGNAL, VPIN_ALERT, VPIN_BUCKETS, DEFAULT_BUCKET, KYLE_WINDOW, LEVELS = 50_000, 0.70, 50, 200_000, 20, 5


def keys(session: bool) -> list[str]:
    """What the state of an operator belongs to: a token, or one session of it where it is reset."""
    return ["token", "session_id"] if session else ["token"]


def by_token(session: bool = False) -> WindowSpec:
    return W.partitionBy(*keys(session)).orderBy("ts_ns", "seq")


def so_far(session: bool = False) -> WindowSpec:
    return by_token(session).rowsBetween(W.unboundedPreceding, 0)


def trade_direction(ticks: DataFrame, session: bool = False) -> DataFrame:
    """direction (+1 at or over the last ask, -1 at or under the last bid, else 0), its validity, and its running sum.

    With ``session`` the sum restarts in each session_id; the last quotes stay known.
    """
    ask, bid = F.lag("ask_price").over(by_token()), F.lag("bid_price").over(by_token())
    d = F.when(F.col("last_price") >= ask, 1).when(F.col("last_price") <= bid, -1).otherwise(0)
    return (
        ticks.withColumn("direction", d)
        .withColumn("direction_valid", ask.isNotNull())
        .withColumn("cum_direction", F.sum("direction").over(so_far(session)))
    )


def order_flow(ticks: DataFrame, session: bool = False) -> DataFrame:
    """ofi, its validity, its running sum, and the imbalance normalised by the quoted size and clamped to [-1, 1]."""
    was = lambda c: F.lag(c).over(by_token())

    def flow(price: str, size: str, better: Column, worse: Column) -> Column:
        return F.when(better, F.col(size)).when(worse, -was(size)).otherwise(F.col(size) - was(size))

    bid = flow("bid_price", "bid_size", F.col("bid_price") > was("bid_price"), F.col("bid_price") < was("bid_price"))
    ask = flow("ask_price", "ask_size", F.col("ask_price") < was("ask_price"), F.col("ask_price") > was("ask_price"))
    quoted = F.col("bid_size") + F.col("ask_size")
    return (
        ticks.withColumn("ofi", F.coalesce(bid - ask, F.lit(0)))
        .withColumn("ofi_valid", was("bid_price").isNotNull())
        .withColumn("cum_ofi", F.sum("ofi").over(so_far(session)))
        .withColumn("ofi_norm", clamped(ratio(F.col("ofi").cast("double"), quoted), -1.0, 1.0))
    )


def bucket_size(adv: int) -> int:
    """Shares in a volume bucket: a fiftieth of the average daily volume, at least one; a default without it."""
    return max(1, adv // VPIN_BUCKETS) if adv > 0 else DEFAULT_BUCKET


def volume_clock(directed: DataFrame, size: int, session: bool = False) -> DataFrame:
    """Per tick: buckets completed so far (in its session), and whether this tick closed one."""
    done = F.sum("last_quantity").over(so_far(session))
    return (
        directed.withColumn("filled", done)
        .withColumn("buckets_completed", div(F.col("filled"), size))
        .withColumn("bucket_closed", F.col("buckets_completed") > div(F.col("filled") - F.col("last_quantity"), size))
    )


def vpin(directed: DataFrame, size: int, session: bool = False) -> DataFrame:
    """token (and session_id), bucket, vpin of every closed volume bucket; a session's first tick opens its first bucket.

    In closed form: a tick covers the shares from its running volume before to after it, so its part of each bucket is
    an overlap of intervals; buckets are then a plain aggregate, and the metric a rolling sum over closed ones.
    """
    own = keys(session)
    c = F.sum("last_quantity").over(so_far(session))
    traded = directed.withColumn("hi", c).withColumn("lo", c - F.col("last_quantity")).where("last_quantity > 0")
    parts = traded.select(
        *own, "direction", "lo", "hi", F.explode(F.sequence(div(F.col("lo"), size), div(F.col("hi") - 1, size))).alias("bucket")
    )
    overlap = F.least("hi", (F.col("bucket") + 1) * size) - F.greatest("lo", F.col("bucket") * size)
    buckets = parts.groupBy(*own, "bucket").agg(
        F.abs(F.sum(F.col("direction") * overlap)).alias("imbalance"), F.sum(overlap).alias("shares")
    )
    window = W.partitionBy(*own).orderBy("bucket").rowsBetween(1 - VPIN_BUCKETS, 0)
    held = F.least(F.col("bucket") + 1, F.lit(VPIN_BUCKETS)) * size
    return buckets.where(F.col("shares") == size).select(
        *own, "bucket", clamped(F.sum("imbalance").over(window) / held, 0.0, 1.0).alias("vpin")
    )


def vpin_by_tick(directed: DataFrame, size: int, session: bool = False) -> DataFrame:
    """Ticks with the volume clock and the metric of the last closed bucket (null before the first)."""
    clocked = volume_clock(directed, size, session)
    closed = vpin(directed, size, session).withColumn("buckets_completed", F.col("bucket") + 1).drop("bucket")
    return clocked.join(closed, [*keys(session), "buckets_completed"], "left")


def kyle_lambda(flow: DataFrame, window: int = KYLE_WINDOW, session: bool = False) -> DataFrame:
    """kyle_lambda: price change on order flow through the origin over the last contributions; valid once they are full."""
    w = by_token(session).rowsBetween(1 - window, 0)
    moved = flow.withColumn("dp", F.col("last_price") - F.lag("last_price").over(by_token(session)))
    x = F.when(F.col("dp").isNotNull(), F.col("ofi").cast("double"))
    return (
        moved.withColumn("kyle_lambda", F.coalesce(ratio(F.sum(F.col("dp") * x).over(w), F.sum(x * x).over(w)), F.lit(0.0)))
        .withColumn("kyle_valid", F.count("dp").over(w) == window)
        .drop("dp")
    )


def depth_entropy(ticks: DataFrame, sizes: list[Column]) -> DataFrame:
    """entropy of the book's size over its levels, and that over ln 5; ``sizes`` are bid + ask sizes by level."""
    total = sum(sizes[1:], sizes[0]).cast("double")
    terms = [F.when(c > 0, c * F.ln(c.cast("double"))).otherwise(0.0) for c in sizes]
    h = F.when(total > 0, F.ln(total) - sum(terms[1:], terms[0]) / total).otherwise(0.0)
    return (
        ticks.withColumn("entropy", h)
        .withColumn("entropy_norm", F.col("entropy") / F.ln(F.lit(float(LEVELS))))
        .withColumn("entropy_valid", total > 0)
    )


def snapshot(signals: DataFrame, session: bool = False) -> DataFrame:
    """The signals as they stand after each tick: values that come only at times are carried forward (within a session)."""
    carried = lambda c: F.last(c, ignorenulls=True).over(so_far(session))
    return signals.select(
        "token", "seq", "ts_ns", F.col("ofi_norm").alias("snap_ofi"), F.col("cum_direction").alias("snap_direction"),
        F.coalesce(carried(F.when(F.col("bucket_closed"), F.col("vpin"))), F.lit(0.0)).alias("snap_vpin"),
        F.coalesce(carried(F.when(F.col("kyle_valid"), F.col("kyle_lambda"))), F.lit(0.0)).alias("snap_kyle"),
        F.coalesce(carried(F.when(F.col("entropy_valid"), F.col("entropy_norm"))), F.lit(0.0)).alias("snap_entropy"),
    )


def ofi_signals(flow: DataFrame, threshold: int = OFI_SIGNAL) -> DataFrame:
    """A signal of strategy 1 for each strong imbalance: its side, with the normalised size as confidence."""
    return flow.where(F.col("ofi_valid") & (F.abs("ofi") >= threshold)).select(
        "token", "seq", "ts_ns", F.col("last_price").alias("price"), F.signum("ofi").cast("int").alias("action"),
        F.abs("ofi_norm").alias("confidence"), F.lit(1).alias("strategy_id"),
    )


def vpin_alerts(by_tick: DataFrame, threshold: float = VPIN_ALERT) -> DataFrame:
    """An alert of strategy 2 for each tick that closes a bucket at a toxic level."""
    return by_tick.where(F.col("bucket_closed") & (F.col("vpin") >= threshold)).select(
        "token", "seq", "ts_ns", F.col("last_price").alias("price"), F.lit(0).alias("action"), F.col("vpin").alias("confidence"),
        F.lit(2).alias("strategy_id"),
    )
