"""Positions, cash and snapshots from fills.

Fills need (token, ts_ns, seq, side, units, price, total_charges, net_amount), and may have lot, the shares in a unit (1 without
it), and segment. Average cost holds the charges of opening.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.numeric import running_total
from tickloom.operators import charges, folds

CAPITAL = 1_000_000.0


class Position:
    """Quantity, average cost and realised profit of a token after each fill.

    What opens or adds to a position carries its charges in the average cost, per unit; what closes pays them at once, and
    after a reversal the new position carries its part of them as well. A position keeps the lot size it was opened with.
    """

    outputs = "quantity long, avg_cost double, realized double, fees double"
    state, lists = "q long, cost double, real double, fees double, lot double", {}

    def init(self):
        return {"q": 0, "cost": 0.0, "real": 0.0, "fees": 0.0, "lot": 1.0}

    def step(self, s, row):
        n, price, fee = int(row["side"]) * int(row["units"]), row["price"], row["total_charges"]
        held, size = s["q"], abs(n)
        if held == 0:
            s["lot"] = row["lot"]
        lot = s["lot"]
        s["fees"] += fee
        s["q"] = held + n
        loaded = price + fee / size / lot
        if held * n >= 0:
            s["cost"] = (s["cost"] * abs(held) + loaded * size) / (abs(held) + size)
        else:
            way = 1 if held > 0 else -1
            s["real"] += min(size, abs(held)) * (price - s["cost"]) * lot * way - fee
            if s["q"] * held < 0:
                s["cost"] = loaded
        if s["q"] == 0:
            s["cost"] = 0.0
        return {"quantity": s["q"], "avg_cost": s["cost"], "realized": s["real"], "fees": s["fees"]}


def lot(fills: DataFrame) -> Column:
    return F.col("lot").cast("double") if "lot" in fills.columns else F.lit(1.0)


def positions(fills: DataFrame) -> DataFrame:
    """The position of the token after each fill, with its lot size and segment (1 where fills have none)."""
    segment = F.col("segment") if "segment" in fills.columns else F.lit(1)
    rows = fills.select("token", "ts_ns", "seq", "side", "units", "price", "total_charges", lot(fills).alias("lot"), segment.cast("int").alias("segment"))
    return folds.run(rows, [Position()], ["token", "ts_ns", "seq", "lot", "segment"], ["ts_ns", "seq"])


def cash_ledger(fills: DataFrame, capital: float = CAPITAL, margin_used: float = 0.0) -> DataFrame:
    """cash after each fill, over all tokens, and whether the cash and margin before it were short of what it needs.

    A purchase needs its margin and charges, for delivery (segment 2) its turnover and charges; a sale needs margin and
    charges unless it closes a short position, which needs its charges only. Fills without a segment or turnover count as
    intraday at their price.
    """
    held = F.coalesce(
        F.sum(F.col("side") * F.col("units")).over(W.partitionBy("token").orderBy("ts_ns", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    segment = F.col("segment") if "segment" in fills.columns else F.lit(1)
    turnover = F.col("turnover") if "turnover" in fills.columns else F.col("units") * F.col("price") * lot(fills)
    need = F.col("total_charges") + F.when((F.col("side") < 0) & (F.col("_held") < 0), 0.0).when(
        (F.col("side") > 0) & (segment == 2), turnover
    ).otherwise(charges.margin(turnover, F.col("side"), segment))
    total = running_total(fills.withColumn("_held", held), "net_amount", ["ts_ns", "seq"], "_spent")
    return (
        total.withColumn("cash", capital - F.col("_spent"))
        .withColumn("needed", need)
        .withColumn("insufficient_funds", F.col("needed") > F.col("cash") + F.col("net_amount") + margin_used)
        .drop("_spent", "_held")
    )


def last_prices(ticks: DataFrame) -> DataFrame:
    """The last positive price of each token."""
    return ticks.where("last_price > 0").groupBy("token").agg(F.max_by("last_price", F.struct("ts_ns", "seq")).alias("last_price"))


def latest(history: DataFrame) -> DataFrame:
    row = F.struct("quantity", "avg_cost", "realized", "fees", "lot", "segment")
    return history.groupBy("token").agg(F.max_by(row, F.struct("ts_ns", "seq")).alias("p")).select("token", "p.*")


def snapshot(history: DataFrame, fills: DataFrame, prices: DataFrame, capital: float = CAPITAL, margin_used: float = 0.0) -> DataFrame:
    """One row: open positions, their value (at average cost where no price is known) by lots, realised profit, charges, trades,
    margin, equity."""
    marked = latest(history).join(prices, "token", "left").withColumn("mark", F.coalesce("last_price", "avg_cost"))
    shares = F.col("quantity") * F.col("lot")
    held = marked.agg(
        F.count(F.when(F.col("quantity") != 0, 1)).alias("open_positions"),
        F.coalesce(F.sum(shares * F.col("mark")), F.lit(0.0)).alias("holdings"),
        F.coalesce(F.sum(shares * (F.col("mark") - F.col("avg_cost"))), F.lit(0.0)).alias("unrealized"),
        F.coalesce(F.sum("realized"), F.lit(0.0)).alias("realized"), F.coalesce(F.sum("fees"), F.lit(0.0)).alias("fees"),
    )
    cash = fills.agg((capital - F.coalesce(F.sum("net_amount"), F.lit(0.0))).alias("cash"), F.count(F.lit(1)).alias("total_trades"))
    # Both sides are aggregates of one row.
    return held.crossJoin(cash).withColumn("margin_used", F.lit(margin_used)).withColumn("equity", F.col("cash") + F.col("holdings"))


def square_off(history: DataFrame, prices: DataFrame, intraday_segment: int = 1, pnl_only: bool = False) -> DataFrame:
    """End of day: positions of the intraday segment close at their last price; the rest stay.

    cash_change is what the sale brings, lots times quantity times price. ``pnl_only`` restores the original's accounting, which
    credits the profit without the cost of the position.
    """
    marked = latest(history).join(prices, "token", "left")
    closes = (F.col("segment") == intraday_segment) & (F.col("quantity") != 0)
    shares, price = F.col("quantity") * F.col("lot"), F.coalesce("last_price", "avg_cost")
    gain = shares * (price - F.col("avg_cost"))
    return marked.select(
        "token", F.when(closes, 0).otherwise(F.col("quantity")).alias("quantity"),
        (F.col("realized") + F.when(closes, gain).otherwise(0.0)).alias("realized"),
        F.when(closes, gain if pnl_only else shares * price).otherwise(0.0).alias("cash_change"),
    )


def full_charge_trades(intents: DataFrame, segment: int = 1) -> DataFrame:
    """Trades of intents filled with slippage and all charges: fills that realise something, or leave or reverse a position."""
    orders = intents.select(
        "token", "ts_ns", "seq", "side", F.col("qty").alias("units"), F.col("qty").cast("double").alias("quantity"), "price",
        F.lit(segment).alias("segment"), "reason",
    )
    fills = charges.simulate(orders).withColumn("price", F.col("fill"))
    w = W.partitionBy("token").orderBy("ts_ns", "seq")
    booked = positions(fills).withColumn("pnl", F.col("realized") - F.coalesce(F.lag("realized").over(w), F.lit(0.0)))
    joined = booked.join(fills.select("token", "ts_ns", "seq", "side", "units", "price", "reason", "total_charges"), ["token", "ts_ns", "seq"])
    return joined.where((F.col("pnl") != 0) | F.col("reason").isin(2, 5)).select(
        "token", "ts_ns", "seq", "side", "units", "price", "reason", "total_charges", "pnl", "quantity"
    )


def full_charge_equity(intents: DataFrame, ticks: DataFrame, capital: float = CAPITAL, every: int = 100, segment: int = 1) -> DataFrame:
    """token, ts_ns, equity: cash and holdings of each token's own account, marked at each ``every``-th tick of the token."""
    orders = intents.select(
        "token", "ts_ns", "seq", "side", F.col("qty").alias("units"), F.col("qty").cast("double").alias("quantity"), "price", F.lit(segment).alias("segment")
    )
    fills = charges.simulate(orders).select("token", "ts_ns", "seq", (F.col("side") * F.col("units")).alias("moved"), F.col("net_amount").alias("paid"))
    w = W.partitionBy("token").orderBy("ts_ns", "seq")
    nth = ticks.withColumn("_n", F.row_number().over(w))
    both = nth.join(fills, ["token", "ts_ns", "seq"], "left")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    held, spent = (F.sum(F.coalesce(F.col(c), F.lit(0))).over(run) for c in ("moved", "paid"))
    marked = both.withColumns({"_held": held, "_spent": spent}).where(F.col("_n") % every == 0)
    return marked.select("token", "ts_ns", (F.lit(capital) - F.col("_spent") + F.col("_held") * F.col("last_price")).alias("equity"))
