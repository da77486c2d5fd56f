"""Numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quantised(x: Column, places: int = 6) -> Column:
    """Half-up to a number of places by floor, without negative zeros: the same in every engine. What is not finite stays."""
    scale = float(10**places)
    return F.when(F.abs(x) < float("inf"), F.floor(x * scale + 0.5) / scale).otherwise(x)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column, otherwise: Column | float = 0.0) -> Column:
    """a / b, or ``otherwise`` where b is zero or null."""
    return F.when(b != 0, a / b).otherwise(otherwise)


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating point has it: infinite or NaN where b is zero."""
    return F.when(b == 0, a * float("inf")).otherwise(a / b)


def div(a: Column, b: Column | int) -> Column:
    """Integer division of longs."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def floor_to(ts: Column, width_ns: int, offset_ns: int = 0) -> Column:
    """Start of the bar that a time falls in, after an optional shift of the clock."""
    shifted = ts + F.lit(offset_ns)
    return shifted - F.pmod(shifted, F.lit(width_ns))


SECOND, HOUR = 1_000_000_000, 3_600_000_000_000


def running_total(rows: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
    """The rows with the running total of a value over all of them in order, which begins with ts_ns.

    The order is global. Values are summed by second and by hour first: a task holds the rows of a second, or the seconds of an
    hour, and only the hours come together in one.
    """
    sliced = rows.withColumns({"_second": F.floor(F.col("ts_ns") / SECOND).cast("long"), "_hour": F.floor(F.col("ts_ns") / HOUR).cast("long")})
    before = lambda w: F.coalesce(F.sum("_sum").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    seconds = sliced.groupBy("_hour", "_second").agg(F.sum(value).alias("_sum"))
    hours = seconds.groupBy("_hour").agg(F.sum("_sum").alias("_sum")).select("_hour", before(W.orderBy("_hour")).alias("_hours"))
    within = seconds.select("_hour", "_second", before(W.partitionBy("_hour").orderBy("_second")).alias("_seconds"))
    carried = within.join(hours, "_hour").select("_second", (F.col("_hours") + F.col("_seconds")).alias("_before"))
    run = F.sum(value).over(W.partitionBy("_second").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = sliced.join(carried, "_second").withColumn(name, F.col("_before") + run)
    return out.drop("_second", "_hour", "_before")
