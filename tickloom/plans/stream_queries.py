"""Queries that run streams over the event table; their oracles are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.numeric import div
from tickloom.functions.numeric import quantised as q
from tickloom.operators import bars as B
from tickloom.operators import folds
from tickloom.plans import trade_queries as TQ
from tickloom.plans.tick_queries import BAR_NS, BASE, CLOCK, FLOWED, KYLE, SIZE, Q, directed
from tickloom.sources import adapters as A
from tickloom.streaming import state as S
from tickloom.streaming.replay import replayed

#: A session that ends after all the data, for the square-off of all that is left.
ERA_MS = 40_000 * S.DAY_MS


def events(s, d):
    return A.streamed(s, d, "events")


def ticks(s, d):
    return A.tick_rows(events(s, d)).withColumn("ts", F.timestamp_micros(div(F.col("ts_ns"), 1000)))


def tick_state(s, d):
    """All tick signals of a stream, from one state for each token."""
    return S.folded(ticks(s, d).drop("open_interest"), [folds.Flow(), folds.Vpin(SIZE), folds.KyleLambda()], ["token", "seq", "ts_ns", "last_price"], ["ts_ns", "seq"], at="ts")


def signals(s, d):
    """Signals of strong imbalance, as the batch has them, from the same state."""
    flow = S.folded(ticks(s, d).drop("last_quantity", "open_interest"), [folds.Flow()], ["token", "seq", "ts_ns", "last_price"], ["ts_ns", "seq"], at="ts")
    return flow.where(F.col("ofi_valid") & (F.abs("ofi") >= 300)).select(
        "token", "seq", "ts_ns", "ts", F.col("last_price").alias("price"), F.signum("ofi").cast("int").alias("action"), F.abs("ofi_norm").alias("confidence")
    )


def arrived(df):
    """Ticks in another order of arrival: each 256 of the table turned round, so that many come late."""
    return df.withColumn("seq", F.col("seq").bitwiseXOR(F.lit(255)))


def arrival_bars(s, d):
    """Bars of a stream as ticks arrive; the last one of a token stays open."""
    out = S.folded(arrived(ticks(s, d)).drop("bid_price", "ask_price", "bid_size", "ask_size"), [folds.ArrivalBars(BAR_NS)], ["token", "seq"], ["seq"], at="ts")
    return out.where("bar_closed")


def account(s, d):
    """Fills of the event table and its ticks, and one tick far ahead of them that ends the session."""
    rows = ticks(s, d)
    last = rows.where("seq = 0").select(F.lit(-1).cast("long").alias("token"), F.timestamp_millis(F.lit(2 * ERA_MS)).alias("ts"), F.lit(2_000_000 * ERA_MS).alias("ts_ns"), "seq", F.lit(0.0).alias("last_price"))
    prices = rows.select("token", "ts", "ts_ns", "seq", "last_price").unionByName(last)
    return S.accounts(TQ.fills_of(rows, "ts"), prices, close_ms=0, every_ms=ERA_MS)


def chain(s, d):
    """Ticks to signals to intents to fills to positions: three states in one stream."""
    return S.accounts(S.fills(S.intents(signals(s, d), late=None)), ticks(s, d).withWatermark("ts", "10 seconds"), late=None, close_ms=0, every_ms=S.DAY_MS)


QUERIES = {
    "l1_streamed_signals": lambda s, d: replayed(tick_state(s, d)).select(
        "token", "seq", "direction", "cum_direction", "ofi", "cum_ofi", q(F.col("ofi_norm")).alias("ofi_norm"), "buckets_completed", "bucket_closed",
        q(F.col("vpin")).alias("vpin"), q(F.col("kyle_lambda")).alias("kyle_lambda"), "kyle_valid",
    ),
    "l2_streamed_intents": lambda s, d: replayed(S.intents(signals(s, d), late=None)).select("token", "seq", "before", "after", "qty", "side"),
    "l3_streamed_positions": lambda s, d: TQ.money(
        replayed(account(s, d)).where("kind = 'fill'"), ["token", "seq", "quantity"], ["avg_cost", "realized", "fees"]
    ),
    "d7_arrival_bars": lambda s, d: B.arrival_bars(arrived(directed(s, d)), BAR_NS).select(
        "token", "bar_ts", "open", "high", "low", "close", "volume", q(F.col("vwap")).alias("vwap"), "buy_volume", "sell_volume", "tick_count", "open_interest"
    ),
    "l5_streamed_arrival_bars": lambda s, d: replayed(arrival_bars(s, d)).select(
        "token", "bar_ts", "open", "high", "low", "close", "volume", q(F.col("vwap")).alias("vwap"), "tick_count", "open_interest"
    ),
    "l4_streamed_square_off": lambda s, d: TQ.money(
        replayed(account(s, d)).where("kind = 'square_off'"), ["token", "quantity"], ["realized", "cash_change"]
    ),
}
BAR_COLUMNS = f"token, bar_ts, open, high, low, close, volume, {Q('vwap')} AS vwap, tick_count, open_interest"
ARRIVAL = f"""{BASE}, arrived AS (SELECT * REPLACE (xor(seq, 255) AS seq) FROM directed),
    minutes AS (SELECT *, max(ts_ns // {BAR_NS} * {BAR_NS}) OVER (PARTITION BY token ORDER BY seq) AS bar_ts FROM arrived),
    grouped AS (SELECT token, bar_ts, arg_min(last_price, seq) AS open, max(last_price) AS high, min(last_price) AS low, arg_max(last_price, seq) AS close,
        sum(last_quantity)::BIGINT AS volume, sum(last_price * last_quantity) / sum(last_quantity) AS vwap, count(*) AS tick_count, arg_max(open_interest, seq) AS open_interest,
        sum(CASE WHEN direction = 1 THEN last_quantity ELSE 0 END)::BIGINT AS buy_volume, sum(CASE WHEN direction = -1 THEN last_quantity ELSE 0 END)::BIGINT AS sell_volume
        FROM minutes GROUP BY token, bar_ts),
    allbars AS (SELECT *, max(bar_ts) OVER (PARTITION BY token) AS newest FROM grouped)"""
ORACLES = {
    "l1_streamed_signals": f"""{FLOWED}, {CLOCK}, {KYLE.replace('FROM flow', 'FROM clock')}
        SELECT k.token, k.seq, direction, (sum(direction) OVER w)::BIGINT AS cum_direction, ofi, (sum(ofi) OVER w)::BIGINT AS cum_ofi, {Q('ofi_norm')} AS ofi_norm,
            buckets_completed, bucket_closed, {Q('v.vpin')} AS vpin, {Q('kyle_lambda')} AS kyle_lambda, kyle_valid
        FROM kyle k LEFT JOIN vpin v ON v.token = k.token AND v.bucket + 1 = k.buckets_completed WINDOW w AS (PARTITION BY k.token ORDER BY ts_ns, k.seq)""",
    "l2_streamed_intents": TQ.ORACLES["h2_hysteresis"],
    "l3_streamed_positions": TQ.ORACLES["h13_positions"],
    "l4_streamed_square_off": TQ.ORACLES["h18_square_off"],
    "d7_arrival_bars": f"{ARRIVAL} SELECT {BAR_COLUMNS}, buy_volume, sell_volume FROM allbars WHERE bar_ts < newest",
    "l5_streamed_arrival_bars": f"{ARRIVAL} SELECT {BAR_COLUMNS} FROM allbars WHERE bar_ts < newest",
}

