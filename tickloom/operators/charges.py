"""Segments, slippage, itemised charges, margins and simulated fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The charge schedule by segment (brokerage flat and rate, whether the lower of both holds, transaction tax
# on buying and selling, exchange, regulator, tax on services, stamp duty on buying, depository charge).
SCHEDULE_COLUMNS = "segment int, flat double, pct double, lower boolean, stt_buy double, stt_sell double, exchange double, sebi double, gst double, stamp double, dp double"
SCHEDULE = [
    (1, 20.0, 0.0003, True, 0.0, 0.00025, 0.0000297, 0.000001, 0.18, 0.00003, 0.0),
    (2, 0.0, 0.0, False, 0.001, 0.001, 0.0000297, 0.000001, 0.18, 0.00015, 15.93),
    (3, 20.0, 0.0, False, 0.0, 0.0001255, 0.0000173, 0.000001, 0.18, 0.00002, 0.0),
    (4, 20.0, 0.0, False, 0.0, 0.0001255, 0.0000173, 0.000001, 0.18, 0.00002, 0.0),
    (5, 20.0, 0.0, False, 0.0, 0.000625, 0.000325, 0.000001, 0.18, 0.00003, 0.0),
    (6, 20.0, 0.0, False, 0.0, 0.000625, 0.000325, 0.000001, 0.18, 0.00003, 0.0),
    (7, 20.0, 0.0, False, 0.0, 0.0, 0.0000035, 0.000001, 0.18, 0.000001, 0.0),
    (8, 20.0, 0.0, False, 0.0, 0.0, 0.000313, 0.000001, 0.18, 0.000001, 0.0),
    (9, 20.0, 0.0, False, 0.0, 0.0001, 0.000026, 0.000001, 0.18, 0.00002, 0.0),
]
# Slippage and margin (buying, selling) by segment.
SLIPPAGE = {1: 0.0001, 2: 0.0001, 3: 0.00005, 4: 0.00005, 5: 0.0005, 6: 0.0005, 7: 0.00005}
MARGIN = {1: (0.20, 0.20), 2: (1.0, 1.0), 3: (0.12, 0.12), 4: (0.15, 0.15), 5: (1.0, 12.0), 6: (1.0, 15.0), 7: (0.02, 0.02), 8: (1.0, 0.03), 9: (0.10, 0.10)}
LOTS = {"BANKNIFTY": 15, "FINNIFTY": 40, "NIFTY": 50, "SENSEX": 10}
STOCK_LOT, STAMP_CAP = 250, 1500.0


def chosen(key: Column, table: dict, otherwise) -> Column:
    """A constant table as a CASE."""
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def segment(symbol: Column) -> Column:
    """Segment number from a symbol: options by suffix, futures by FUT, each of an index or a stock; else intraday."""
    index = symbol.contains("NIFTY") | symbol.contains("SENSEX")
    option = symbol.endswith("CE") | symbol.endswith("PE")
    return (
        F.when(option & index, 5).when(option, 6).when(symbol.contains("FUT") & index, 3).when(symbol.contains("FUT"), 4).otherwise(1)
    )


def lot_size(symbol: Column) -> Column:
    """Units in a lot of the symbol's derivative; 1 for shares."""
    lot = F.lit(STOCK_LOT)
    for name in ("SENSEX", "NIFTY", "FINNIFTY", "BANKNIFTY"):  # the last that fits decides
        lot = F.when(symbol.contains(name), LOTS[name]).otherwise(lot)
    return F.when(segment(symbol) == 1, 1).otherwise(lot)


def registered(seen: DataFrame) -> DataFrame:
    """One row for each token, by the symbol it was first seen with."""
    first = seen.groupBy("token").agg(F.min_by("symbol", F.struct("ts_ns", "symbol")).alias("symbol"))
    return first.select("token", "symbol", segment(F.col("symbol")).alias("segment"), lot_size(F.col("symbol")).alias("lot"))


def fill_price(price: Column, side: Column, segment_no: Column) -> Column:
    """The price after slippage: buyers pay more, sellers get less."""
    return price * (1 + side * chosen(segment_no, SLIPPAGE, 0.0001))


def margin(notional: Column, side: Column, segment_no: Column) -> Column:
    buy = chosen(segment_no, {k: v[0] for k, v in MARGIN.items()}, 0.20)
    sell = chosen(segment_no, {k: v[1] for k, v in MARGIN.items()}, 0.20)
    return notional * F.when(side > 0, buy).otherwise(sell)


def charged(fills: DataFrame) -> DataFrame:
    """Fills (side, segment, turnover) with a struct of charges and their total.

    The schedule is a constant of nine rows, so it is broadcast; unknown segments get that of segment 1.
    """
    rates = F.broadcast(fills.sparkSession.createDataFrame(SCHEDULE, SCHEDULE_COLUMNS).withColumnRenamed("segment", "_seg"))
    known = F.when(F.col("segment").between(1, len(SCHEDULE)), F.col("segment")).otherwise(1)
    x = fills.withColumn("_key", known).join(rates, F.col("_key") == F.col("_seg"))
    t, buys = F.col("turnover"), F.col("side") > 0
    brokerage = F.when(F.col("lower"), F.least("flat", F.col("pct") * t)).otherwise(F.col("flat"))
    parts = {
        "brokerage": brokerage, "stt": F.when(buys, F.col("stt_buy")).otherwise(F.col("stt_sell")) * t,
        "exchange_fee": F.col("exchange") * t, "sebi_fee": F.col("sebi") * t,
    }
    x = x.withColumns(parts)
    x = x.withColumns({
        "gst_fee": F.col("gst") * (F.col("brokerage") + F.col("exchange_fee") + F.col("sebi_fee")),
        "stamp_fee": F.when(buys, F.least(F.lit(STAMP_CAP), F.col("stamp") * t)).otherwise(0.0),
        "dp_fee": F.when(buys, 0.0).otherwise(F.col("dp")),
    })
    items = ["brokerage", "stt", "exchange_fee", "sebi_fee", "gst_fee", "stamp_fee", "dp_fee"]
    total = sum((F.col(c) for c in items[1:]), F.col(items[0]))
    return x.withColumn("charges", F.struct(*items)).withColumn("total_charges", total).select(*fills.columns, "charges", "total_charges")


def simulate(orders: DataFrame, lot: Column | None = None) -> DataFrame:
    """Orders (token, side, quantity, price, segment) as fills: price, turnover, charges, net amount (paid +, received -)."""
    units = F.col("quantity") * (lot if lot is not None else 1)
    filled = orders.withColumn("fill", fill_price(F.col("price"), F.col("side"), F.col("segment"))).withColumn("turnover", units * F.col("fill"))
    out = charged(filled)
    if lot is not None:
        out = out.withColumn("lot", lot)
    return out.withColumn(
        "net_amount",
        F.when(F.col("side") > 0, F.col("turnover") + F.col("total_charges")).otherwise(-(F.col("turnover") - F.col("total_charges"))),
    )
