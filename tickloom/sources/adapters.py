"""Deterministic adapters from the driver tables to the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.numeric import div, floor_to

SIX_HOURS = 21_600_000_000_000
DAY = 86_400_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ns(ts: Column) -> Column:
    """Nanoseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz")) * 1000


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks from ``events``: one token a user, quotes on a grid of 25 around the price."""
    return tick_rows(read(spark, sf_dir, "events"))


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    return spark.readStream.schema(read(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def tick_rows(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("token"),
        F.col("event_id").alias("seq"),
        epoch_ns(F.col("ts")).alias("ts_ns"),
        F.col("value").alias("last_price"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("last_quantity"),
        (F.floor(F.col("value") / 25) * 25.0).alias("bid_price"),
        (F.floor(F.col("value") / 25) * 25.0 + 25.0).alias("ask_price"),
        (100 + F.col("event_id") % 7 * 50).alias("bid_size"),
        (100 + F.col("event_id") % 5 * 50).alias("ask_size"),
        (F.col("event_id") % 11 * 75).cast("double").alias("open_interest"),
    )


TICKS = """ticks AS (
    SELECT user_id AS token, event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, value AS last_price,
           (props::JSON->>'$.k')::BIGINT + 1 AS last_quantity, floor(value / 25) * 25.0::DOUBLE AS bid_price,
           floor(value / 25) * 25.0::DOUBLE + 25.0::DOUBLE AS ask_price, 100 + event_id % 7 * 50 AS bid_size,
           100 + event_id % 5 * 50 AS ask_size, (event_id % 11 * 75)::DOUBLE AS open_interest
    FROM events)"""


def day_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles from ``orders``: a symbol for each priority."""
    o = read(spark, sf_dir, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * DAY
    price, at = F.col("o_totalprice").cast("double"), F.col("o_orderkey")
    return (
        o.groupBy(F.col("o_orderpriority").alias("symbol"), day.alias("ts_ns"))
        .agg(
            F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, at).alias("close"), F.count(F.lit(1)).alias("volume"),
        )
        .withColumn("token", F.substring("symbol", 1, 1).cast("long")).withColumn("seq", div(F.col("ts_ns"), DAY))
    )


DAY_CANDLES = """candles AS (
    SELECT o_orderpriority AS symbol, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 86400000000000 AS ts_ns,
           arg_min(o_totalprice::DOUBLE, o_orderkey) AS open, max(o_totalprice::DOUBLE) AS high, min(o_totalprice::DOUBLE) AS low,
           arg_max(o_totalprice::DOUBLE, o_orderkey) AS close, count(*) AS volume, substr(o_orderpriority, 1, 1)::BIGINT AS token,
           date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS seq
    FROM orders GROUP BY o_orderpriority, o_orderdate::DATE)"""


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option strikes from ``part``: a chain for each brand, the spot its mean strike."""
    p = read(spark, sf_dir, "part")
    spot = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("spot"))
    return p.join(spot, "p_brand").select(
        F.col("p_brand").alias("chain"), F.col("p_partkey").alias("ord"), "spot", F.col("p_retailprice").cast("double").alias("strike"),
        (0.10 + F.col("p_size") / 100).alias("iv_call"), (0.11 + F.col("p_size") / 100).alias("iv_put"),
        (F.col("p_partkey") % 500).alias("oi_call"), (F.col("p_partkey") % 300).alias("oi_put"),
    )


CHAINS = """chains AS (
    SELECT p_brand AS chain, p_partkey AS ord, avg(p_retailprice) OVER (PARTITION BY p_brand) AS spot, p_retailprice::DOUBLE AS strike,
           0.10::DOUBLE + p_size / 100.0::DOUBLE AS iv_call, 0.11::DOUBLE + p_size / 100.0::DOUBLE AS iv_put,
           p_partkey % 500 AS oi_call, p_partkey % 300 AS oi_put
    FROM part)"""


def orders_to_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from ``lineitem``: returned lines sell, the line number is the segment."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("token"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("side"),
        F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"),
        F.col("l_linenumber").cast("int").alias("segment"),
    )


ORDERS_TO_FILL = """fills AS (
    SELECT l_partkey AS token, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side, l_quantity::DOUBLE AS quantity,
           l_extendedprice::DOUBLE / l_quantity::DOUBLE AS price, l_linenumber::INT AS segment
    FROM lineitem)"""

__all__ = ["read", "epoch_ns", "ticks", "day_candles", "chains", "orders_to_fill", "floor_to"]
