"""Read-side queries: latest and newest rows, deltas, tails, counts and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.numeric import ratio

DEAD_BAND, RECENT = 0.001, 300
DAY_US = 86_400_000_000


def newest(ticks: DataFrame, n: int) -> DataFrame:
    """The newest n rows: a top-k, not a sort."""
    return ticks.orderBy(F.desc("ts_ns"), F.desc("seq")).limit(n)


def latest_by_token(ticks: DataFrame, recent: int = RECENT) -> DataFrame:
    """The latest row of each token among the newest ``recent`` rows."""
    w = W.partitionBy("token").orderBy(F.desc("ts_ns"), F.desc("seq"))
    return newest(ticks, recent).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def price_moves(ticks: DataFrame) -> DataFrame:
    """move (-1, 0, 1) against the price before with a dead band, and the spread in basis points."""
    change = F.col("last_price") - F.lag("last_price").over(W.partitionBy("token").orderBy("ts_ns", "seq"))
    return ticks.withColumn("move", F.when(change > DEAD_BAND, 1).when(change < -DEAD_BAND, -1).otherwise(0)).withColumn(
        "spread_bps", ratio(F.col("ask_price") - F.col("bid_price"), F.col("bid_price")) * 10_000
    )


def tail(rows: DataFrame, last_id: int) -> DataFrame:
    return rows.where(F.col("seq") > last_id)


def depth_share(rows: DataFrame, capacity: int) -> DataFrame:
    """How full a bounded stream is."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.least(F.lit(1.0), F.count(F.lit(1)) / capacity).alias("share"))


def of_latest_date(dim: DataFrame, date: str, **only: list) -> DataFrame:
    """Rows of the newest date, with optional lists of allowed values."""
    newest_date = dim.agg(F.max(date).alias("_d"))
    out = dim.join(F.broadcast(newest_date), F.col(date) == F.col("_d")).drop("_d")  # one row
    for column, values in only.items():
        out = out.where(F.col(column).isin(values))
    return out


def day_bounds(date: Column) -> Column:
    """[start, end) in nanoseconds of a date in UTC."""
    start = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * DAY_US * 1000
    return F.struct(start.alias("start_ns"), (start + DAY_US * 1000).alias("end_ns"))


def count_between(rows: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    return rows.where((F.col("ts_ns") >= start_ns) & (F.col("ts_ns") < end_ns)).agg(F.count(F.lit(1)).alias("n"))


def range_scan(rows: DataFrame, column: str, values: list, start_ns: int, end_ns: int) -> DataFrame:
    """Rows of the given values in an inclusive range, in order of time: both predicates reach the Parquet scan."""
    return rows.where(F.col(column).isin(values) & F.col("ts_ns").between(start_ns, end_ns)).orderBy("ts_ns")


def updated_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """The table with ``values`` in the rows that the condition is true of."""
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def flat_positions(portfolios: DataFrame) -> DataFrame:
    """A row for each open position of portfolios with an array of them; a portfolio without any gives none."""
    plain = [c for c in portfolios.columns if c != "positions"]
    return portfolios.select(*plain, F.inline("positions"))


def injected_after(ticks: DataFrame, step_ns: int, n: int) -> DataFrame:
    """n synthetic ticks of each token at its newest price, step_ns apart, after its newest tick; seq goes on from there."""
    last = ticks.groupBy("token").agg(F.max_by(F.struct("ts_ns", "seq", "last_price"), F.struct("ts_ns", "seq")).alias("r")).select("token", "r.*")
    each = last.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    price = F.col("last_price")
    return each.select(
        "token", (F.col("seq") + F.col("_k")).alias("seq"), (F.col("ts_ns") + F.col("_k") * step_ns).alias("ts_ns"), price.alias("last_price"),
        (price - 0.05).alias("bid_price"), (price + 0.05).alias("ask_price"),
    )


def injected(token: int, price: float, start_ns: int, step_ns: int, n: int, spark) -> DataFrame:
    """n synthetic ticks of one token at a fixed price, step_ns apart."""
    return spark.range(n).select(
        F.lit(token).cast("long").alias("token"), F.col("id").alias("seq"), (F.col("id") * step_ns + start_ns).alias("ts_ns"),
        F.lit(price).alias("last_price"), F.lit(price - 0.05).alias("bid_price"), F.lit(price + 0.05).alias("ask_price"),
    )


def return_pct(equity: Column, capital: Column) -> Column:
    """Per cent gained on the capital; 0 without any."""
    return ratio((equity - capital) * 100.0, capital)


def progress(done: Column, total: Column) -> Column:
    """Per cent done, from 0 to 100."""
    return F.least(F.lit(100.0), ratio(done * 100.0, total))


#: The fields of a run's result: numbers are 0 and names empty where they are missing.
RESULT = {
    "double": "total_net_pnl total_gross_pnl total_commission starting_capital final_equity total_return_pct sharpe_ratio sortino_ratio calmar_ratio max_drawdown "
    "max_drawdown_pct win_rate profit_factor avg_trade_pnl avg_win avg_loss largest_win largest_loss expectancy",
    "bigint": "total_trades winning_trades losing_trades instrument_token run_timestamp_ns",
    "string": "symbol",
}
STATUS = {"int": "state", "bigint": "instrument_token ticks_processed total_ticks timestamp_ns", "double": "progress_pct", "string": "symbol message"}
#: States of a run, by number.
STATES = ("BACKTEST_IDLE", "BACKTEST_LOADING", "BACKTEST_RUNNING", "BACKTEST_DONE", "BACKTEST_ERROR")


def decoded(raw: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows of ``fields`` from JSON text (payload); what isn't JSON is left out."""
    typed = [(c, kind) for kind, names in fields.items() for c in names.split()]
    parsed = F.from_json("payload", ", ".join(f"{c} {kind}" for c, kind in typed) + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = raw.select(parsed.alias("r")).where("r IS NOT NULL AND r._bad IS NULL")
    return rows.select(*[F.coalesce(f"r.{c}", F.lit("" if kind == "string" else 0).cast(kind)).alias(c) for c, kind in typed])


def results(raw: DataFrame) -> DataFrame:
    return decoded(raw, RESULT)


def statuses(raw: DataFrame) -> DataFrame:
    """Statuses of runs with the name of their state and their progress worked out anew."""
    name = F.coalesce(F.get(F.array(*map(F.lit, STATES)), F.col("state")), F.lit("UNKNOWN"))
    return decoded(raw, STATUS).withColumns({"state_name": name, "progress_pct": progress(F.col("ticks_processed"), F.col("total_ticks"))})
