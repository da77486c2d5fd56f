"""Queries and oracles of the tick and bar operators over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.numeric import floor_to
from tickloom.functions.numeric import quantised as q
from tickloom.operators import bars as B
from tickloom.operators import ticks as T
from tickloom.sources import adapters as A

ADV = 10_000
SIZE = T.bucket_size(ADV)
Q = lambda x: f"floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE + 0.0::DOUBLE"
W = "WINDOW w AS (PARTITION BY token ORDER BY ts_ns, seq)"
DIRECTED = """directed AS (
    SELECT *, CASE WHEN last_price >= lag(ask_price) OVER w THEN 1 WHEN last_price <= lag(bid_price) OVER w THEN -1 ELSE 0 END AS direction,
           lag(ask_price) OVER w IS NOT NULL AS direction_valid
    FROM ticks WINDOW w AS (PARTITION BY token ORDER BY ts_ns, seq))"""
FLOW = """flow0 AS (
    SELECT *, lag(bid_price) OVER w AS pb, lag(ask_price) OVER w AS pa, lag(bid_size) OVER w AS pbs, lag(ask_size) OVER w AS pas
    FROM directed WINDOW w AS (PARTITION BY token ORDER BY ts_ns, seq)
), flow AS (
    SELECT * EXCLUDE (pb, pa, pbs, pas), pb IS NOT NULL AS ofi_valid,
           coalesce(CASE WHEN bid_price > pb THEN bid_size WHEN bid_price < pb THEN -pbs ELSE bid_size - pbs END
                  - CASE WHEN ask_price < pa THEN ask_size WHEN ask_price > pa THEN -pas ELSE ask_size - pas END, 0) AS ofi,
           greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ofi::DOUBLE / (bid_size + ask_size))) AS ofi_norm
    FROM flow0)"""
CLOCK = f"""clock AS (
    SELECT *, filled // {SIZE} AS buckets_completed, filled // {SIZE} > (filled - last_quantity) // {SIZE} AS bucket_closed
    FROM (SELECT *, (sum(last_quantity) OVER w)::BIGINT AS filled FROM flow {W})
), parts AS (
    SELECT token, direction, k AS bucket, least(filled, (k + 1) * {SIZE}) - greatest(filled - last_quantity, k * {SIZE}) AS share
    FROM (SELECT *, unnest(range((filled - last_quantity) // {SIZE}, (filled - 1) // {SIZE} + 1)) AS k FROM clock)
), closed AS (
    SELECT token, bucket, abs(sum(direction * share)) AS imbalance FROM parts GROUP BY token, bucket HAVING sum(share) = {SIZE}
), vpin AS (
    SELECT token, bucket, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (sum(imbalance) OVER (PARTITION BY token ORDER BY bucket ROWS 49 PRECEDING))::DOUBLE
           / (least(bucket + 1, 50) * {SIZE}))) AS vpin FROM closed)"""
KYLE = """kyle AS (
    SELECT *, count(dp) OVER v = 20 AS kyle_valid,
           coalesce(CASE WHEN sum(x * x) OVER v <> 0 THEN sum(dp * x) OVER v / sum(x * x) OVER v ELSE 0.0::DOUBLE END, 0.0::DOUBLE) AS kyle_lambda
    FROM (SELECT *, CASE WHEN dp IS NOT NULL THEN ofi::DOUBLE END AS x FROM (SELECT *, last_price - lag(last_price) OVER w AS dp FROM flow
          WINDOW w AS (PARTITION BY token ORDER BY ts_ns, seq)))
    WINDOW v AS (PARTITION BY token ORDER BY ts_ns, seq ROWS 19 PRECEDING))"""
ENTROPY = """entropy AS (
    SELECT *, ln(t) - (%s) / t AS entropy, (ln(t) - (%s) / t) / ln(5.0::DOUBLE) AS entropy_norm
    FROM (SELECT *, (5 * (bid_size + ask_size) + 2 * (10 + 20 + 30 + 40))::DOUBLE AS t FROM %%s))""" % ((" + ".join(
    f"(bid_size + ask_size + {20 * i}) * ln((bid_size + ask_size + {20 * i})::DOUBLE)" for i in range(5)),) * 2)
BAR_NS = A.SIX_HOURS
BARS = f"""allbars AS (
    SELECT token, ts_ns // {BAR_NS} * {BAR_NS} AS bar_ts, arg_min(last_price, seq) AS open, max(last_price) AS high, min(last_price) AS low,
           arg_max(last_price, seq) AS close, sum(last_quantity)::BIGINT AS volume, sum(last_price * last_quantity) / sum(last_quantity) AS vwap,
           sum(CASE WHEN direction = 1 THEN last_quantity ELSE 0 END)::BIGINT AS buy_volume,
           sum(CASE WHEN direction = -1 THEN last_quantity ELSE 0 END)::BIGINT AS sell_volume, count(*) AS tick_count, arg_max(open_interest, seq) AS open_interest
    FROM directed GROUP BY token, ts_ns // {BAR_NS} * {BAR_NS}
), bars AS (
    SELECT *, (buy_volume - sell_volume)::DOUBLE / volume AS bar_ofi FROM (SELECT *, max(bar_ts) OVER (PARTITION BY token) AS newest FROM allbars)
    WHERE bar_ts < newest)"""
BASE = f"WITH {A.TICKS}, {DIRECTED}"
FLOWED = f"{BASE}, {FLOW}"


def directed(spark, d):
    return T.trade_direction(A.ticks(spark, d))


def flowed(spark, d):
    return T.order_flow(directed(spark, d))


def entropied(df):
    sizes = [F.col("bid_size") + F.col("ask_size") + 20 * i for i in range(T.LEVELS)]
    return T.depth_entropy(df, sizes)


def full(spark, d):
    return T.vpin_by_tick(entropied(T.kyle_lambda(flowed(spark, d))), SIZE)


def six_hour_bars(spark, d, **kw):
    return B.bars(directed(spark, d), BAR_NS, **kw)


def by_day(df):
    """A session a day."""
    return df.withColumn("session_id", F.floor(F.col("ts_ns") / A.DAY).cast("long"))


def full_by_session(s, d):
    flow = T.order_flow(T.trade_direction(by_day(A.ticks(s, d)), session=True), session=True)
    return T.vpin_by_tick(entropied(T.kyle_lambda(flow, 2, session=True)), 40, session=True)


def off_grid(candles):
    """Candles with prices that aren't whole cents, so that no average lies on the edge of a rounding step."""
    return candles.withColumns({c: F.col(c) * 0.9973 for c in ("open", "high", "low", "close")})


KEY = ["token", "seq"]
QUERIES = {
    "c1_trade_direction": lambda s, d: directed(s, d).select(*KEY, "direction", "direction_valid"),
    "c2_cumulative_direction": lambda s, d: directed(s, d).select(*KEY, "cum_direction"),
    "c3_order_flow_imbalance": lambda s, d: flowed(s, d).select(*KEY, F.col("ofi").cast("long").alias("ofi"), "ofi_valid"),
    "c4_cumulative_ofi": lambda s, d: flowed(s, d).select(*KEY, F.col("cum_ofi").cast("long").alias("cum_ofi")),
    "c5_ofi_normalised": lambda s, d: flowed(s, d).select(*KEY, q(F.col("ofi_norm")).alias("ofi_norm")),
    "c6_vpin": lambda s, d: T.vpin(directed(s, d), SIZE).select("token", "bucket", q(F.col("vpin")).alias("vpin")),
    "c7_volume_clock": lambda s, d: T.volume_clock(directed(s, d), SIZE).select(*KEY, "buckets_completed", "bucket_closed"),
    "c8_kyle_lambda": lambda s, d: T.kyle_lambda(flowed(s, d)).select(*KEY, q(F.col("kyle_lambda")).alias("kyle_lambda"), "kyle_valid"),
    "c9_depth_entropy": lambda s, d: entropied(A.ticks(s, d)).select(
        *KEY, q(F.col("entropy")).alias("entropy"), q(F.col("entropy_norm")).alias("entropy_norm")
    ),
    "c10_tick_snapshot": lambda s, d: T.snapshot(full(s, d)).select(
        *KEY, "snap_direction", *[q(F.col(c)).alias(c) for c in ("snap_ofi", "snap_vpin", "snap_kyle", "snap_entropy")]
    ),
    "c11_ofi_signals": lambda s, d: T.ofi_signals(flowed(s, d), 300).select(
        *KEY, "price", "action", q(F.col("confidence")).alias("confidence"), "strategy_id"
    ),
    "c12_vpin_alerts": lambda s, d: T.vpin_alerts(T.vpin_by_tick(directed(s, d), SIZE), 0.25).select(
        *KEY, "price", "action", q(F.col("confidence")).alias("confidence"), "strategy_id"
    ),
    "c14_session_vpin": lambda s, d: T.vpin(by_day(directed(s, d)), 40, session=True).select("token", "session_id", "bucket", q(F.col("vpin")).alias("vpin")),
    "c14_session_kyle": lambda s, d: T.kyle_lambda(by_day(flowed(s, d)), 2, session=True).select(*KEY, q(F.col("kyle_lambda")).alias("kyle_lambda"), "kyle_valid"),
    "c14_session_snapshot": lambda s, d: T.snapshot(full_by_session(s, d), session=True).select(
        *KEY, "snap_direction", *[q(F.col(c)).alias(c) for c in ("snap_ofi", "snap_vpin", "snap_kyle", "snap_entropy")]
    ),
    "d1_bars": lambda s, d: six_hour_bars(s, d).select(
        "token", "bar_ts", "open", "high", "low", "close", "volume", q(F.col("vwap")).alias("vwap"), "buy_volume", "sell_volume",
        "tick_count", "open_interest", q(F.col("bar_ofi")).alias("bar_ofi"),
    ),
    "d2_ohlcv": lambda s, d: six_hour_bars(s, d).select("token", "bar_ts", "open", "high", "low", "close", "volume", "open_interest"),
    "d3_candle_ticks": lambda s, d: B.candle_ticks(A.day_candles(s, d)).select("token", "ts_ns", "leg", "last_price"),
    "d4_backfill_ticks": lambda s, d: B.backfill_ticks(off_grid(A.day_candles(s, d))).select(
        "token", "ts_ns", "leg", "volume", q(F.col("vwap"), 2).alias("vwap"),
        *[q(F.col(c), 4).alias(c) for c in ("last_price", "bid_price", "ask_price")],
    ),
    "d5_close_ticks": lambda s, d: B.close_ticks(
        A.day_candles(s, d).drop("token"), A.day_candles(s, d).where("token < 4").select("symbol", "token").distinct()
    ).select("symbol", "token", "ts_ns", "volume", *[q(F.col(c), 4).alias(c) for c in ("last_price", "bid_price", "ask_price", "vwap")]),
    "d6_bar_floor": lambda s, d: A.ticks(s, d).select(
        *KEY, floor_to(F.col("ts_ns"), B.MINUTE).alias("bar_ts"), floor_to(F.col("ts_ns"), B.MINUTE, 19_800_000_000_000).alias("bar_ts_local")
    ),
    "d7_open_bars": lambda s, d: six_hour_bars(s, d, emit_open_bar=True).join(
        six_hour_bars(s, d).select("token", "bar_ts"), ["token", "bar_ts"], "left_anti"
    ).select("token", "bar_ts", "tick_count"),
}
TICK_SIGNALS = f"{FLOW}, {CLOCK}, {KYLE.replace('FROM flow', 'FROM clock')}, {ENTROPY % 'kyle'}"
_FULL = f"{BASE}, {TICK_SIGNALS}"
SNAP = f"""snap AS (SELECT token, seq, ts_ns, (sum(direction) OVER w)::BIGINT AS snap_direction, ofi_norm AS snap_ofi,
        coalesce(last_value(CASE WHEN bucket_closed THEN vpin END IGNORE NULLS) OVER w, 0.0::DOUBLE) AS snap_vpin,
        coalesce(last_value(CASE WHEN kyle_valid THEN kyle_lambda END IGNORE NULLS) OVER w, 0.0::DOUBLE) AS snap_kyle, entropy_norm AS snap_entropy
        FROM (SELECT e.*, v.vpin FROM entropy e LEFT JOIN vpin v ON v.token = e.token AND v.bucket + 1 = e.buckets_completed) {W})"""
def _by_session(sql: str) -> str:
    """The state's windows and joins over a session of a token in place of all of it; the last quotes stay known."""
    sql = sql.replace("PARTITION BY token", "PARTITION BY token, session_id").replace("GROUP BY token", "GROUP BY token, session_id")
    return sql.replace("SELECT token, ", "SELECT token, session_id, ").replace("v.token = e.token", "v.token = e.token AND v.session_id = e.session_id").replace(str(SIZE), "40")


_DAILY = f"""{BASE}, {FLOW.replace('flow AS', 'flow1 AS')}, flow AS (SELECT *, ts_ns // {A.DAY} AS session_id FROM flow1),
    {_by_session(CLOCK)}, {_by_session(KYLE.replace('FROM flow', 'FROM clock')).replace('count(dp) OVER v = 20', 'count(dp) OVER v = 2').replace('ROWS 19', 'ROWS 1')}, {ENTROPY % 'kyle'}"""
_DAILY_SNAP = _by_session(SNAP)
ORACLES = {
    "c1_trade_direction": f"{BASE} SELECT token, seq, direction, direction_valid FROM directed",
    "c2_cumulative_direction": f"{BASE} SELECT token, seq, (sum(direction) OVER w)::BIGINT AS cum_direction FROM directed {W}",
    "c3_order_flow_imbalance": f"{FLOWED} SELECT token, seq, ofi, ofi_valid FROM flow",
    "c4_cumulative_ofi": f"{FLOWED} SELECT token, seq, (sum(ofi) OVER w)::BIGINT AS cum_ofi FROM flow {W}",
    "c5_ofi_normalised": f"{FLOWED} SELECT token, seq, {Q('ofi_norm')} AS ofi_norm FROM flow",
    "c6_vpin": f"{FLOWED}, {CLOCK} SELECT token, bucket, {Q('vpin')} AS vpin FROM vpin",
    "c7_volume_clock": f"{FLOWED}, {CLOCK} SELECT token, seq, buckets_completed, bucket_closed FROM clock",
    "c8_kyle_lambda": f"{FLOWED}, {KYLE} SELECT token, seq, {Q('kyle_lambda')} AS kyle_lambda, kyle_valid FROM kyle",
    "c9_depth_entropy": f"WITH {A.TICKS}, {ENTROPY % 'ticks'} SELECT token, seq, {Q('entropy')} AS entropy, {Q('entropy_norm')} AS entropy_norm FROM entropy",
    "c10_tick_snapshot": f"{_FULL}, {SNAP} SELECT token, seq, snap_direction, {', '.join(f'{Q(c)} AS {c}' for c in ('snap_ofi', 'snap_vpin', 'snap_kyle', 'snap_entropy'))} FROM snap",
    "c11_ofi_signals": f"""{FLOWED} SELECT token, seq, last_price AS price, sign(ofi)::INT AS action, {Q('abs(ofi_norm)')} AS confidence,
        1 AS strategy_id FROM flow WHERE ofi_valid AND abs(ofi) >= 300""",
    "c12_vpin_alerts": f"""{FLOWED}, {CLOCK} SELECT c.token, c.seq, last_price AS price, 0 AS action, {Q('vpin')} AS confidence, 2 AS strategy_id
        FROM clock c JOIN vpin v ON v.token = c.token AND v.bucket + 1 = c.buckets_completed WHERE bucket_closed AND vpin >= 0.25""",
    "c14_session_vpin": f"{_DAILY} SELECT token, session_id, bucket, {Q('vpin')} AS vpin FROM vpin",
    "c14_session_kyle": f"{_DAILY} SELECT token, seq, {Q('kyle_lambda')} AS kyle_lambda, kyle_valid FROM kyle",
    "c14_session_snapshot": f"{_DAILY}, {_DAILY_SNAP} SELECT token, seq, snap_direction, {', '.join(f'{Q(c)} AS {c}' for c in ('snap_ofi', 'snap_vpin', 'snap_kyle', 'snap_entropy'))} FROM snap",
    "d1_bars": f"""{BASE}, {BARS} SELECT token, bar_ts, open, high, low, close, volume, {Q('vwap')} AS vwap, buy_volume, sell_volume,
        tick_count, open_interest, {Q('bar_ofi')} AS bar_ofi FROM bars""",
    "d2_ohlcv": f"{BASE}, {BARS} SELECT token, bar_ts, open, high, low, close, volume, open_interest FROM bars",
    "d3_candle_ticks": f"""WITH {A.DAY_CANDLES} SELECT token, ts_ns + 59999000000 AS ts_ns, leg, p AS last_price FROM
        (SELECT *, unnest([open, high, low, close]) AS p, unnest([0, 1, 2, 3]) AS leg FROM candles)""",
    "d4_backfill_ticks": f"""WITH {A.DAY_CANDLES} SELECT token, ts_ns + 59999000000 AS ts_ns, leg, volume // 4 AS volume,
        floor(p * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS last_price, floor(p * 0.9999::DOUBLE * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS bid_price,
        floor(p * 1.0001::DOUBLE * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS ask_price, floor(vw * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS vwap
        FROM (SELECT *, unnest([open, high, low, close]) AS p, unnest([0, 1, 2, 3]) AS leg FROM
            (SELECT *, sum(close * volume) OVER w / sum(volume) OVER w AS vw FROM
                (SELECT * REPLACE (open * 0.9973::DOUBLE AS open, high * 0.9973::DOUBLE AS high, low * 0.9973::DOUBLE AS low, close * 0.9973::DOUBLE AS close) FROM candles) {W}))""",
    "d5_close_ticks": f"""WITH {A.DAY_CANDLES} SELECT symbol, token, ts_ns, volume, floor(close * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS last_price,
        floor((close - sp) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS bid_price, floor((close + sp) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS ask_price,
        floor((open + high + low + close) / 4 * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS vwap
        FROM (SELECT *, greatest(high - low, close * 0.0002::DOUBLE) * 0.1::DOUBLE AS sp FROM candles WHERE token < 4)""",
    "d6_bar_floor": f"""WITH {A.TICKS} SELECT token, seq, ts_ns // 60000000000 * 60000000000 AS bar_ts,
        (ts_ns + 19800000000000) // 60000000000 * 60000000000 AS bar_ts_local FROM ticks""",
    "d7_open_bars": f"""{BASE}, {BARS} SELECT token, bar_ts, tick_count FROM (SELECT *, max(bar_ts) OVER (PARTITION BY token) AS newest FROM allbars)
        WHERE bar_ts = newest""",
}
