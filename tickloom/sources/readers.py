"""Sources: candle and instrument JSON, CSV, tick scans and wire ticks; the form of binary tick files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schemas import INSTRUMENT

LEVELS = 5
#: The header of a binary tick file, its first eight bytes as a number, its version, and its records.
HEADER = np.dtype([("magic", "<u8"), ("version", "<u4"), ("token", "<u4"), ("first_ns", "<u8"), ("last_ns", "<u8"), ("count", "<u8"), ("size", "<u4"), ("flags", "<u4"), ("reserved", "<u8", 2)])
MAGIC, VERSION = 0x414C50484154494B, 1
RECORD = np.dtype([("ts_ns", "<u8"), ("token", "<u4"), ("last_price", "<f4"), ("bid_price", "<f4"), ("ask_price", "<f4"), ("vwap", "<f4"), ("volume", "<u4")])
TICK_SCHEMA = "path string, ts_ns long, token long, last_price float, bid_price float, ask_price float, vwap float, volume long"
CHUNK_RECORDS = 1 << 16


def iso_ns(text: Column) -> Column:
    """Nanoseconds of an ISO time; without an offset it is taken as +05:30; null if it can't be read."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("+05:30")))
    return F.unix_micros(F.try_to_timestamp(zoned)) * 1000


def iso_ns_or_zero(text: Column) -> Column:
    """As ``iso_ns``, with 0 for what can't be read; ``stamped`` gives such rows the time of writing."""
    return F.coalesce(iso_ns(text), F.lit(0).cast("long"))


def stamped(ts_ns: Column, now: Column | None = None) -> Column:
    """The time, or that of writing where it is 0."""
    written = F.unix_micros(F.current_timestamp()) * 1000 if now is None else now
    return F.when(ts_ns == 0, written).otherwise(ts_ns)


def candle_rows(raw: DataFrame) -> DataFrame:
    """Candles from answers (symbol, json) of the form {status, data: {candles: [[ts, o, h, l, c, v, oi?], ...]}}, oldest first."""
    kind = "struct<status:string,data:struct<candles:array<array<string>>>>"
    rows = (
        raw.select("symbol", F.from_json("json", kind).alias("j")).where("j.status = 'success'")
        .select("symbol", F.explode("j.data.candles").alias("c")).where(F.size("c") >= 6)
    )
    at = lambda i, kind: F.get("c", F.lit(i)).try_cast(kind)
    return rows.select(
        "symbol", iso_ns(F.get("c", F.lit(0))).alias("ts_ns"), *[at(i + 1, "double").alias(n) for i, n in enumerate(("open", "high", "low", "close"))],
        at(5, "long").alias("volume"), F.coalesce(at(6, "long"), F.lit(0)).alias("open_interest"),
    ).orderBy("symbol", "ts_ns")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of (gzipped) JSON: a record a line, one array on a line, or one array over many lines.

    Only an array or record that its first line doesn't close is read as a whole file; everything else is read by lines.
    """
    first = spark.read.text(path).where(F.trim("value") != "").head()
    start = first.value.strip() if first else ""
    whole = start.startswith("[") and not start.endswith("]") or start.startswith("{") and not start.endswith("}")
    return spark.read.schema(schema).option("multiLine", whole).json(path)


RAW_INSTRUMENT = (
    "instrument_key string, trading_symbol string, name string, exchange string, segment string, lot_size string, tick_size string, "
    "instrument_type string, expiry string, strike_price string"
)


def instruments(spark: SparkSession, path: str, day: Column | None = None) -> DataFrame:
    """Instrument list from (gzipped) JSON; records without a key are dropped, numbers that can't be read take their defaults."""
    return instrument_rows(json_records(spark, path, RAW_INSTRUMENT), F.current_date() if day is None else day)


def instrument_rows(raw: DataFrame, day: Column) -> DataFrame:
    """Rows of INSTRUMENT from raw records, all as text."""
    number = lambda c, kind, other: F.coalesce(F.col(c).try_cast("double"), F.lit(other)).cast(kind)
    lot = number("lot_size", "int", 0)
    rows = raw.where(F.coalesce(F.col("instrument_key"), F.lit("")) != "").select(
        day.alias("date"), "instrument_key", "trading_symbol", *[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "exchange", "segment")],
        F.when(lot == 0, 1).otherwise(lot).alias("lot_size"), number("tick_size", "double", 0.0).alias("tick_size"),
        F.coalesce("instrument_type", F.lit("")).alias("instrument_type"), number("expiry", "bigint", 0).alias("expiry_ms"),
        number("strike_price", "double", 0.0).alias("strike_price"),
    )
    return rows.select(*[c.split()[0] for c in INSTRUMENT.split(", ")])


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all as trimmed text; casts and alternative headers are for the parser."""
    return spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def depth(levels: Column) -> Column:
    """The first five levels of a book, filled up with zeros."""
    zero = F.struct(F.lit(0.0).alias("price"), F.lit(0).cast("long").alias("quantity"), F.lit(0).cast("long").alias("orders"))
    have = F.slice(F.coalesce(levels, F.array()), 1, LEVELS)
    return F.concat(have, F.array_repeat(zero, F.lit(LEVELS) - F.size(have)))


GREEK_NAMES = ("delta", "gamma", "theta", "vega", "rho", "iv")


def wire_ticks(raw: DataFrame, tokens: DataFrame) -> DataFrame:
    """Ticks from a map of feeds by instrument key; keys without a token are dropped.

    A feed may lack what its kind doesn't have: an index has a price only, a share no greeks. Sizes and prices that are missing
    are 0; the best quotes are those of the first level.
    """
    feeds = raw.select("received_ns", F.explode("feeds").alias("instrument_key", "f"))
    kinds = {f.name: f.dataType.simpleString() for f in feeds.schema["f"].dataType.fields}

    def of(name: str, kind: str) -> Column:
        return F.coalesce(F.col(f"f.{name}").cast(kind), F.lit(0).cast(kind)) if name in kinds else F.lit(0).cast(kind)

    empty = F.expr("cast(array() as array<struct<price:double,quantity:bigint,orders:bigint>>)")
    side = lambda name: depth(F.col(f"f.{name}") if name in kinds else empty)
    greek = lambda g: (F.coalesce(F.col(f"f.greeks.{g}").cast("double"), F.lit(0.0)) if f"{g}:" in kinds.get("greeks", "") else F.lit(0.0)).alias(g)
    ticks = feeds.join(tokens, "instrument_key").select(
        "token", F.col("received_ns").alias("ts_ns"), of("ltp", "double").alias("last_price"), of("ltq", "bigint").alias("last_quantity"),
        of("volume", "bigint").alias("total_volume"), of("atp", "double").alias("vwap"), of("oi", "double").alias("open_interest"),
        side("bids").alias("bids"), side("asks").alias("asks"), F.struct(*[greek(g) for g in GREEK_NAMES]).alias("greeks"),
    )
    best = {f"{b}_{c}": F.get(f"{b}s", F.lit(0))[n] for b in ("bid", "ask") for c, n in (("price", "price"), ("size", "quantity"))}
    return ticks.withColumns(best)


def consumed(raw: DataFrame, schema: str, observation=None) -> DataFrame:
    """Messages of a stream (payload as JSON text) as rows; those without a payload, that can't be parsed, or of token 0 are left out.

    Their number is reported by ``observation`` (or the name of one, for streams): messages, missing, parse_errors, unknown.
    """
    parsed = raw.withColumn("_row", F.from_json("payload", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    missing = F.col("payload").isNull()
    bad = ~missing & (F.col("_row").isNull() | F.col("_row._bad").isNotNull())
    unknown = ~missing & ~bad & (F.coalesce(F.col("_row.token"), F.lit(0)) == 0)
    if observation is not None:
        number = lambda c: F.count(F.when(c, 1))
        parsed = parsed.observe(observation, F.count(F.lit(1)).alias("messages"), number(missing).alias("missing"), number(bad).alias("parse_errors"), number(unknown).alias("unknown"))
    return parsed.where(~missing & ~bad & ~unknown).select("_row.*").drop("_bad")


def with_tokens(keys: DataFrame, dim: DataFrame) -> DataFrame:
    """Tokens of keys by the dimension, or, where it has none, their place in the list from 1."""
    return keys.join(dim, "instrument_key", "left").select(
        "instrument_key", F.coalesce("token", F.col("place") + 1).alias("token")
    )


def candle_scan(candles: DataFrame, symbol: str, interval: str, first_ns: int, last_ns: int) -> DataFrame:
    """Candles of a symbol and interval in an inclusive range, in order, with their typical price as vwap."""
    rows = candles.where((F.col("symbol") == symbol) & (F.col("interval") == interval) & F.col("ts_ns").between(first_ns, last_ns))
    return rows.withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3).orderBy("ts_ns")


def tick_scan(ticks: DataFrame, token: int, first_ns: int, last_ns: int) -> DataFrame:
    """Ticks of a token in an inclusive range, in order: both predicates reach the Parquet scan."""
    return ticks.where((F.col("token") == token) & F.col("ts_ns").between(first_ns, last_ns)).orderBy("ts_ns")


def time_range(ticks: DataFrame) -> DataFrame:
    """First and last time of each token."""
    return ticks.groupBy("token").agg(F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
