"""Hand-sized cases of the signal, trading and ingest operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tickloom.operators import backtest, bar_signals, charges, derived, folds, ingest, options, portfolio, strategy
from tickloom.operators import bars as bar_ops
from tickloom.operators import ticks as tick_ops
from tickloom.sources import binary, readers, sinks

QUOTE = "token long, seq long, ts_ns long, last_price double, last_quantity long, bid_price double, bid_size long, ask_price double, ask_size long"


def quotes(spark, rows):
    return spark.createDataFrame([(1, i, i, 100.0, 1, *r) for i, r in enumerate(rows)], QUOTE)


@pytest.mark.parametrize(
    ("rows", "ofi", "norm"),
    [
        ([(100.0, 200, 100.5, 200), (100.1, 300, 100.5, 200)], 300, 0.6),
        ([(100.0, 1000, 100.5, 100), (99.9, 50, 100.5, 100)], -1000, -1.0),
        ([(100.0, 50, 100.5, 1000), (100.0, 50, 100.6, 100)], 1000, 1.0),
    ],
)
def test_order_flow(spark, rows, ofi, norm):
    out = tick_ops.order_flow(quotes(spark, rows)).orderBy("seq").collect()
    assert (out[0].ofi, out[0].ofi_valid) == (0, False)
    assert out[1].ofi == ofi and out[1].ofi_norm == pytest.approx(norm)


@pytest.mark.parametrize(
    ("volumes", "want"), [([(9, 1)], []), ([(10, 1)], [1.0]), ([(10, -1)], [1.0]), ([(5, 1), (5, -1), (1, 1)], [0.0]), ([(10, 1)] * 3, [1.0] * 3), ([(0, 1), (35, 0)], [0.0] * 3)]
)
def test_vpin(spark, volumes, want):
    rows = [(1, i, i, v, d) for i, (v, d) in enumerate(volumes)]
    df = spark.createDataFrame(rows, "token long, seq long, ts_ns long, last_quantity long, direction int")
    assert tick_ops.bucket_size(500) == 10 and tick_ops.bucket_size(0) == 200_000 and tick_ops.bucket_size(7) == 1
    assert [r.vpin for r in tick_ops.vpin(df, 10).orderBy("bucket").collect()] == want


def test_kyle_and_entropy(spark):
    rows = [(1, i, i, 100 + 0.1 * i, 10) for i in range(22)]
    df = spark.createDataFrame(rows, "token long, seq long, ts_ns long, last_price double, ofi long")
    out = tick_ops.kyle_lambda(df).orderBy("seq").collect()
    assert out[21].kyle_lambda == pytest.approx(0.01) and out[20].kyle_valid and not out[19].kyle_valid
    book = spark.createDataFrame([(5, 5, 5, 5, 5), (5, 0, 0, 0, 0), (3, 3, 0, 0, 0), (0, 0, 0, 0, 0)], "a int, b int, c int, d int, e int")
    got = tick_ops.depth_entropy(book, [F.col(c) for c in "abcde"]).collect()
    assert [r.entropy for r in got] == pytest.approx([math.log(5), 0, math.log(2), 0], abs=1e-12)
    assert [r.entropy_valid for r in got] == [True, True, True, False]


def run_fold(fold, rows):
    state = fold.init()
    return [fold.step(state, r) for r in rows]


def test_kalman_and_cusum():
    out = run_fold(folds.Kalman(), [{"log_return": 0.01}, {"log_return": 0.02}])
    gain = (1 + 1e-5) / (1 + 1e-5 + 1e-3)
    assert out[1]["kalman_gain"] == pytest.approx(gain) and out[1]["level"] == pytest.approx(0.01 + 0.01 * gain)
    row = {"log_return": 0.01, "level": 0.005, "rv_var": 1e-4}
    steps = run_fold(folds.Cusum(), [row] * 6)
    h = math.log(50) - 2
    assert steps[0]["cusum_threshold"] == pytest.approx(h) and steps[0]["cusum_up"] == pytest.approx(0.375)
    assert [s["cusum_fired"] for s in steps].index(1) == math.ceil(h / 0.375) - 1
    assert steps[[s["cusum_fired"] for s in steps].index(1)]["cusum_up"] == 0


def test_rsi_and_macd_warm_up():
    rising = [{"close": 100.0 + i} for i in range(40)]
    rsi = run_fold(folds.Rsi(), rising)
    assert [r["rsi_valid"] for r in rsi].index(True) == 14 and rsi[14]["rsi"] == 100
    macd = run_fold(folds.Macd(), rising)
    assert [r["macd_valid"] for r in macd].index(True) == 33
    assert run_fold(folds.Macd(), [{"close": 5.0}] * 40)[-1]["macd_hist"] == pytest.approx(0)


def test_bands_and_normaliser(spark):
    flat = spark.createDataFrame([(1, i, 50.0) for i in range(21)], "token long, ts_ns long, close double")
    last = bar_signals.bollinger(flat).orderBy(F.desc("ts_ns")).first()
    assert last.bb_valid and last.pct_b == 0.5
    two = spark.createDataFrame([(1, 0, 0.0), (1, 1, 2.0)], "token long, ts_ns long, x double")
    z = derived.normalised(two, ["x"]).orderBy("ts_ns").collect()
    assert (z[0].z_x, z[0].norm_valid) == (0.0, False) and z[1].z_x == pytest.approx(1 / math.sqrt(2))
    assert derived.ic_weights([-1, -2]) == [0.5, 0.5]


def test_sizing_is_consistent_with_the_gate(spark):
    rows = spark.createDataFrame([(x / 10,) for x in range(-30, 31)], "z_s double")
    out = derived.composite(rows, ["s"], [1.0]).collect()
    for r in out:
        assert (r.kelly_half >= 0.10) == (r.score >= math.log(1.5)) and 0 <= r.kelly_half <= 0.5


def test_pnl_and_options(spark):
    one = spark.range(1)
    pnl = derived.unrealised_pnl(F.lit(105.0), F.lit(100.0), F.lit(100), F.lit(1))
    assert one.select(pnl.alias("x")).first().x == pytest.approx(437.375)
    g = one.select(options.gamma(F.lit(100.0), F.lit(100.0), 0.0, F.lit(0.2), 1.0).alias("g")).first().g
    strikes = spark.createDataFrame([("c", 0, 100.0, 100.0, 0.2, 0.2, 500, 300)], "chain string, ord long, spot double, strike double, iv_call double, iv_put double, oi_call long, oi_put long")
    none = spark.createDataFrame([], "chain string, low double, high double")
    assert options.gamma_exposure(strikes, none, 0.0, 1.0, 75).first().gex == pytest.approx(200 * g * 75)
    atm = spark.createDataFrame([(0.2, 0.22), (0.2, 0.0), (0.0, 0.0)], "iv_call double, iv_put double")
    assert [r.atm_iv for r in options.variance_premium(atm, F.lit(0.04)).collect()] == pytest.approx([0.21, 0.2, 0])


def test_charges(spark):
    fills = spark.createDataFrame([(1, s, 100_000.0) for s in range(1, 10)] + [(-1, 2, 100_000.0)], "side int, segment int, turnover double")
    out = {(r.side, r.segment): r for r in charges.charged(fills).collect()}
    assert len(out) == 10 and out[1, 1].charges.brokerage == 20 and out[-1, 2].charges.dp_fee == pytest.approx(15.93)
    assert out[1, 9].charges.stt == 0 and out[1, 8].charges.exchange_fee == pytest.approx(31.3)


def test_positions_and_intents(spark):
    rows = [(1, 0, 0, 1, 10, 100.0, 5.0), (1, 1, 1, 1, 10, 110.0, 5.0), (1, 2, 2, -1, 25, 120.0, 5.0), (1, 3, 3, 1, 5, 100.0, 5.0)]
    fills = spark.createDataFrame(rows, "token long, ts_ns long, seq long, side int, units long, price double, total_charges double")
    p = portfolio.positions(fills).orderBy("seq").collect()
    assert p[1].avg_cost == pytest.approx(105.5) and p[2].quantity == -5 and p[2].realized == pytest.approx(20 * 14.5 - 5)
    assert p[2].avg_cost == pytest.approx(120.2) and p[3].quantity == 0 and p[3].avg_cost == 0
    sig = [(1, 0, 0, 1, 0.5, 100.0), (1, 1, 1, 1, 0.52, 100.0), (1, 2, 2, 0, 0.9, 100.0), (1, 3, 3, -1, 0.01, 100.0)]
    signals = spark.createDataFrame(sig, "token long, ts_ns long, seq long, action int, confidence double, price double")
    out = strategy.intents(signals).orderBy("seq").collect()
    assert [(r.before, r.after, r.reason) for r in out] == [(0, 50, 1), (50, -1, 5)]
    assert strategy.intents(signals, loss_limit=1.0).count() == 0


def test_backtest_round_trip(spark):
    rows = [(1, i, i, p, 100, s, k, True) for i, (p, s, k) in enumerate([(100.0, 1.0, 0.1), (105.0, 1.0, 0.1), (110.0, -1.0, 0.3)])]
    df = spark.createDataFrame(rows, "token long, ts_ns long, seq long, last_price double, volume long, score double, kelly_half double, norm_valid boolean")
    free = backtest.Config(flat=0, exchange=0, sebi=0, slippage_bps=0)
    events = backtest.simulate(df, backtest.CompositeStrategy, free)
    trade = events.where("kind = 'trade'").collect()
    assert len(trade) == 1 and trade[0].qty == 10 and trade[0].net_pnl == pytest.approx(100, abs=1) and trade[0].entry_ts == 0
    stats = backtest.trade_statistics(events.where("kind = 'trade'")).first()
    assert stats.trades == 1 and stats.profit_factor == float("inf")


def test_drawdown_and_profit_factor(spark):
    eq = spark.createDataFrame([(1, i, i, float(x)) for i, x in enumerate([1000, 1200, 900, 1100])], "token long, ts_ns long, seq long, equity double")
    d = backtest.max_drawdown(eq).first()
    assert (d.max_drawdown, d.max_drawdown_pct) == (300, 25)
    t = spark.createDataFrame([(1, x, 0.0, x) for x in (300.0, 200.0, -100.0, -50.0)], "token long, gross_pnl double, commission double, net_pnl double")
    assert backtest.trade_statistics(t).first().profit_factor == pytest.approx(500 / 150)
    daily = spark.createDataFrame([(1, i * backtest.DAY_NS, i, 100.0 + i % 2) for i in range(6)], "token long, ts_ns long, seq long, equity double")
    assert backtest.risk_ratios(daily).first().sharpe is not None


def test_sources_and_sinks(spark, tmp_path):
    rows = [(i, 7, 1.5 + i, 1.0, 2.0, 1.25, 10 * i) for i in range(5)]
    t = spark.createDataFrame(rows, "ts_ns long, token long, last_price double, bid_price double, ask_price double, vwap double, volume long")
    (file,) = binary.write_tick_files(t, str(tmp_path / "ticks")).collect()
    back = binary.tick_files(spark, file.path).orderBy("ts_ns").collect()
    assert [(r.ts_ns, r.last_price, r.volume) for r in back] == [(i, 1.5 + i, 10 * i) for i in range(5)]
    sinks.write_by_day(t, str(tmp_path / "days"))
    assert spark.read.parquet(str(tmp_path / "days")).count() == 5
    candle = spark.createDataFrame([(1, 0, 0, 100.0, 110.0, 90.0, 105.0)], "token long, seq long, ts_ns long, open double, high double, low double, close double")
    assert [(r.ts_ns, r.last_price) for r in bar_ops.candle_ticks(candle).orderBy("leg").collect()] == [(59_999_000_000, x) for x in (100, 110, 90, 105)]


def test_csv_ingest(spark, tmp_path):
    path = tmp_path / "eq.csv"
    path.write_text('SYMBOL, SERIES, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, CLOSE_PRICE, TTL_TRD_QNTY, DELIV_QTY\nAAA, EQ, 1, 2, 0.5, "1,001.5", 100, -\n, EQ, 1, 1, 1, 1, 1, 1\nBBB, EQ, 1, 1, 1, x, 1, 1\n')
    out = ingest.equity_rows(readers.csv_rows(spark, str(path)), F.to_date(F.lit("2024-01-25"))).collect()
    assert [(r.symbol, r.close, r.volume, r.delivery_volume) for r in out] == [("AAA", 1001.5, 100, None)]


def test_full_charge_backtest(spark):
    rows = [(1, 0, 0, 10, 1, 1, 100.0), (1, 1, 1, 10, -1, 2, 110.0)]
    made = spark.createDataFrame(rows, "token long, ts_ns long, seq long, qty long, side int, reason int, price double")
    out = portfolio.full_charge_trades(made).collect()
    assert len(out) == 1 and out[0].quantity == 0 and 90 < out[0].pnl < 100


def test_filter_and_change_detection_wait_for_valid_bars():
    rows = [{"log_return": 0.0, "return_valid": False, "rv_var": 0.0, "rv_valid": False}, {"log_return": 0.01, "return_valid": True, "rv_var": 0.0, "rv_valid": False},
            {"log_return": 0.02, "return_valid": True, "rv_var": 1e-4, "rv_valid": True}, {"log_return": 0.0, "return_valid": False, "rv_var": 0.0, "rv_valid": False}]
    filtered = run_fold(folds.Kalman(), rows)
    assert [r["kalman_valid"] for r in filtered] == [False, False, True, False] and filtered[3]["level"] == 0.0
    fired = run_fold(folds.Cusum(), [r | f for r, f in zip(rows, filtered, strict=True)])
    assert [r["cusum_valid"] for r in fired] == [False, False, True, False] and fired[2]["cusum_up"] > 0 and fired[3]["cusum_up"] == 0.0


def test_funds_are_checked_before_the_fill(spark):
    rows = [(1, 0, 0, 1, 10, 100.0, 5.0, 1005.0, 1, 1000.0), (1, 1, 1, -1, 10, 100.0, 5.0, -995.0, 1, 1000.0), (1, 2, 2, -1, 10, 100.0, 5.0, -995.0, 5, 1000.0),
            (1, 3, 3, 1, 5, 100.0, 5.0, 505.0, 5, 500.0), (2, 4, 4, 1, 30, 100.0, 5.0, 3005.0, 2, 3000.0)]
    fills = spark.createDataFrame(rows, "token long, ts_ns long, seq long, side int, units long, price double, total_charges double, net_amount double, segment int, turnover double")
    out = portfolio.cash_ledger(fills, 1100.0).orderBy("seq").collect()
    assert [r.needed for r in out] == [205.0, 205.0, 12005.0, 505.0, 3005.0] and [round(r.cash) for r in out] == [95, 1090, 2085, 1580, -1425]
    assert [r.insufficient_funds for r in out] == [False, True, True, False, True]


def test_lots_and_square_off(spark):
    rows = [(1, 0, 0, 1, 2, 100.0, 50.0, 25.0, 3), (2, 1, 1, 1, 10, 10.0, 0.0, 1.0, 1)]
    fills = spark.createDataFrame(rows, "token long, ts_ns long, seq long, side int, units long, price double, total_charges double, lot double, segment int")
    history = portfolio.positions(fills)
    assert history.where("token = 1").first().avg_cost == pytest.approx(101.0)
    prices = spark.createDataFrame([(1, 103.0), (2, 12.0)], "token long, last_price double")
    one = portfolio.snapshot(history, fills.withColumn("net_amount", F.lit(100.0)), prices, 1000.0).first()
    assert (one.open_positions, one.holdings, one.total_trades, one.equity) == (2, 2 * 25 * 103.0 + 120.0, 2, 800.0 + 5270.0)
    closed = {r.token: r for r in portfolio.square_off(history, prices).collect()}
    assert (closed[1].quantity, closed[1].cash_change) == (2, 0.0) and (closed[2].quantity, closed[2].cash_change, closed[2].realized) == (0, 120.0, 20.0)
    assert {r.token: r.cash_change for r in portfolio.square_off(history, prices, pnl_only=True).collect()}[2] == 20.0


def test_statistics_of_even_trades_and_idle_tokens(spark):
    t = spark.createDataFrame([(1, x, 0.0, x) for x in (30.0, -10.0, 0.0, 0.0)] + [(2, 0.0, 0.0, 0.0)], "token long, gross_pnl double, commission double, net_pnl double")
    out = {r.token: r for r in backtest.trade_statistics(t, spark.range(1, 4).toDF("token")).collect()}
    assert (out[1].wins, out[1].losses, out[1].trades) == (1, 1, 4) and out[1].expectancy == pytest.approx(0.25 * 30 - 0.75 * 10)
    assert out[2].profit_factor == float("inf") and out[3].trades == 0 and out[3].profit_factor == 0 and out[3].expectancy == 0
    eq = spark.createDataFrame([(1, 0, 0, 5.0), (1, 1, 1, 6.0)], "token long, ts_ns long, seq long, equity double")
    assert [tuple(r) for r in backtest.risk_ratios(eq).collect()] == [(1, 0.0, 0.0)]


def test_clock_raises_and_errors_stay_with_their_token(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 4)], "token long, seq long, ts_ns long")
    with pytest.raises(Exception, match="time goes back at token 1, sequence 1"):
        backtest.in_time(rows).collect()
    df = spark.createDataFrame(
        [(k, i, i, 100.0, 100, None if k == 2 else 1.0, 0.1 * i, True) for k in (1, 2) for i in range(3)],
        "token long, ts_ns long, seq long, last_price double, volume long, score double, kelly_half double, norm_valid boolean",
    )
    events = backtest.simulate(df, backtest.CompositeStrategy)
    status = {r.token: (r.status, r.note is None) for r in backtest.run_status(events, df).collect()}
    assert status == {1: ("ok", True), 2: ("error", False)} and events.where("token = 1 AND kind = 'trade'").count() == 1


@pytest.mark.parametrize("form", ["lines", "array", "pretty"])
def test_instrument_files(spark, tmp_path, form):
    import gzip
    import json

    items = [{"instrument_key": f"K{i}", "trading_symbol": "T", "lot_size": i, "expiry": 5, "strike_price": "x" if i == 1 else 2.5} for i in range(3)] + [{"name": "no key"}]
    text = "\n".join(map(json.dumps, items)) if form == "lines" else json.dumps(items, indent=None if form == "array" else 2)
    for name, data in (("a.json", text.encode()), ("a.json.gz", gzip.compress(text.encode()))):
        (tmp_path / name).write_bytes(data)
        got = sorted((r.instrument_key, r.lot_size, r.strike_price, r.expiry_ms) for r in readers.instruments(spark, str(tmp_path / name)).collect())
        assert got == [("K0", 1, 2.5, 5), ("K1", 1, 0.0, 5), ("K2", 2, 2.5, 5)]


def test_binary_header_as_written_elsewhere(spark, tmp_path):
    import struct

    head = struct.pack("<QIIQQQIIQQ", 0x414C50484154494B, 1, 7, 10, 20, 2, 32, 0, 0, 0)
    (tmp_path / "x.bin").write_bytes(head + struct.pack("<QIffffI", 10, 7, 1.5, 1.0, 2.0, 1.25, 3) + struct.pack("<QIffffI", 20, 7, 2.5, 1.0, 2.0, 1.25, 4))
    got = [(r.ts_ns, r.token, r.last_price, r.volume) for r in binary.tick_files(spark, str(tmp_path / "x.bin")).collect()]
    assert got == [(10, 7, 1.5, 3), (20, 7, 2.5, 4)]
    (tmp_path / "y.bin").write_bytes(b"x" * 64)
    with pytest.raises(Exception, match="not a tick file"):
        binary.tick_files(spark, str(tmp_path / "y.bin")).collect()


def test_end_of_day_rows_that_cannot_be_read(spark):
    raw = spark.createDataFrame([("A", "1", "2"), ("B", "x", "2"), ("", "1", "2"), ("D", "", "-")], ["Index Name", "Open", "Volume"])
    day = F.lit("2024-01-25").cast("date")
    assert sorted((r.index_name, r.open, r.volume, r.pe_ratio) for r in ingest.index_rows(raw, day).collect()) == [("A", 1.0, 2, 0.0), ("D", 0.0, None, 0.0)]
    deals = spark.createDataFrame([("A", "5", "1,000.5"), ("B", "5.5", "1")], ["Symbol", "Quantity", "Trade Price"])
    assert [(r.symbol, r.deal_type, r.price, r.exchange) for r in ingest.deal_rows(deals, day, "bulk").collect()] == [("A", "BUY", 1000.5, "NSE")]
    table = ingest.index_rows(raw, day)
    again = ingest.load(table, table.withColumn("open", F.col("open") + 5).unionByName(table), "index").collect()
    assert sorted((r.index_name, r.open) for r in again) == [("A", 6.0), ("D", 5.0)]


def test_tables_by_day(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1_704_067_200_000_000_000 + i * 3_600_000_000_000, 1.0 + i) for i in range(30)], "token long, ts_ns long, price double")
    sinks.write_table(rows, str(tmp_path), "signals")
    back = spark.read.parquet(str(tmp_path / "signals"))
    assert back.count() == 30 and back.select("day").distinct().count() == 2 and back.where("action IS NULL").count() == 30
