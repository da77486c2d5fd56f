"""Queries against their SQL on small event tables with what the given tables are poor in."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as contract

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, path, rows):
    """An event table of rows (hours since the start, token, price, quantity)."""
    start = dt.datetime(2024, 1, 1)
    made = [(i, start + dt.timedelta(hours=h), token, "view", price, f'{{"k": {n - 1}}}') for i, (h, token, price, n) in enumerate(rows)]
    spark.createDataFrame(made, EVENT).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def both(spark, path, name):
    """A query's rows and those of its SQL, as sorted text."""
    out = contract.queries()[name](spark, path)
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    db.execute(f"CREATE VIEW events AS FROM '{path}/events.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(out.columns)} FROM ({contract.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, map(tuple, out.collect()))), sorted(map(repr, want))


def prices(*values, token=1, n=3):
    """A tick each six hours."""
    return [(6 * i, token, float(v), n + i % 2) for i, v in enumerate(values)]


@pytest.mark.parametrize("name", ["e8_vwap_deviation", "e10_batch_bar_pipeline"])
def test_sessions_without_a_price(spark, tmp_path, name):
    """A session whose prices are all zero has a deviation of NaN, before and after it there are numbers."""
    made = events(spark, tmp_path, prices(10, 11, 12, 11, 0, 0, 13, 12, 11, 12, 13, 12) + prices(5, 6, 5, 6, 7, 6, token=2))
    got, want = both(spark, made, name)
    assert got == want and any("nan" in row for row in want)


def test_volatility_over_a_price_of_zero(spark, tmp_path):
    """Windows that hold a return from or to zero have no volatility, those after them have one again."""
    made = events(spark, tmp_path, prices(*(10 + i % 4 for i in range(24)), 0, 0, *(12 + i % 3 for i in range(30))))
    got, want = both(spark, made, "e14_annual_volatility")
    assert got == want and sum("nan" in row for row in want) == 21 and "nan" not in want[-1]


def test_rules_at_prices_of_zero(spark, tmp_path):
    """Bars without a price count as held and as rested."""
    made = events(spark, tmp_path, [(i, 1, 0.0 if i % 2 else 100.0 + i % 7, 2) for i in range(600)])
    got, want = both(spark, made, "h21_rule_strategy")
    assert got == want and want


#: Ticks (id, time, token, price, quantity) of two tokens whose second bars' scores cancel out but for rounding.
CANCELLING = [
    (746, "2024-01-01 00:53:42.779211", 1412, 0.98, 13), (4863, "2024-01-01 05:47:48.843322", 1412, 1.69, 20),
    (7188, "2024-01-01 08:31:23.262631", 1412, 0.33, 33), (11098, "2024-01-01 13:11:46.323226", 1412, 22.15, 25),
    (7626, "2024-01-01 09:00:52.954420", 8020, 2.1, 44), (8213, "2024-01-01 09:41:57.171688", 8020, 19.75, 33),
    (31771, "2024-01-02 13:57:15.961945", 8020, 2.79, 20), (41280, "2024-01-03 01:26:51.002528", 8020, 126.25, 81),
]


def test_scores_that_cancel_out(spark, tmp_path):
    """The action of a second bar whose score is zero but for rounding is that of its SQL."""
    made = [(i, dt.datetime.fromisoformat(at), token, "view", price, f'{{"k": {n - 1}}}') for i, at, token, price, n in CANCELLING]
    spark.createDataFrame(made, EVENT).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, str(tmp_path), "e10_bar_pipeline")
    assert got == want and len(want) == 4


#: Ticks whose session average lies at the edge of a rounding step, so that the order of its sums decides the last place.
AT_AN_EDGE = [
    (80124, "2024-01-05 00:08:00.489590", 3164, 323.09, 75), (82204, "2024-01-05 02:38:17.216890", 3164, 191.36, 14),
    (84127, "2024-01-05 04:56:50.956965", 3164, 3.58, 1), (85938, "2024-01-05 07:06:18.017682", 3164, 3.75, 70),
    (99000, "2024-01-05 19:00:00.000000", 3164, 20.0, 3),
]


@pytest.mark.parametrize("name", ["e8_vwap_deviation", "e10_batch_bar_pipeline"])
def test_bars_over_several_files(spark, tmp_path, name):
    """A bar whose ticks lie in two files is that of its SQL over one file, to the last place."""
    made = [(i, dt.datetime.fromisoformat(at), token, "view", price, f'{{"k": {n - 1}}}') for i, at, token, price, n in AT_AN_EDGE]
    whole, split = f"{tmp_path}/whole", f"{tmp_path}/split"
    spark.createDataFrame(made, EVENT).coalesce(1).write.parquet(f"{whole}/events.parquet")
    for part in (made[:1], made[1:]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(f"{split}/events.parquet")
    got, want = both(spark, whole, name)
    apart = sorted(map(repr, map(tuple, contract.queries()[name](spark, split).collect())))
    assert got == want == apart and len(want) == 2
