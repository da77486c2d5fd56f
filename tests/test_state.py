"""Typed state of streams, and running operators by slices of time, against the batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tickloom.operators import backtest, blocked, charges, folds, portfolio, strategy, ticks
from tickloom.streaming import state as S

NS = 1_000_000_000
START = 1_700_000_000


@pytest.fixture(autouse=True)
def _rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def raw(spark, n=60, tokens=3):
    rows = [
        (k, (START + i * 60) * NS, i, 100.0 + (i * 7 + k) % 11, (i * 3 + k) % 9 + 1, 95.0 + (i * 5 + k) % 9, 105.0 + (i * 3 + k) % 7, 100 + i * 50 % 350, 100 + i * 70 % 250)
        for k in range(tokens) for i in range(n)
    ]
    kind = "token long, ts_ns long, seq long, last_price double, last_quantity long, bid_price double, ask_price double, bid_size long, ask_size long"
    return spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds(F.col("ts_ns") / NS))


def run(stream, path, name):
    query = stream.writeStream.format("parquet").trigger(availableNow=True).option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-cp").start()
    query.awaitTermination()
    return query


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_typed_state_equals_the_batch_across_restarts(spark, tmp_path):
    df = raw(spark)
    made = [folds.Flow(), folds.Vpin(10), folds.KyleLambda(), folds.Normaliser(["last_price", "ofi"], 15)]
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for part in range(3):  # each run reads one more file, from the state that the one before left
        df.where(F.floor(F.col("seq") / 20) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(S.folded(source(), made, ["token", "seq"], ["ts_ns", "seq"], at="ts"), tmp_path, "out")
    columns = ["token", "seq", "direction", "cum_ofi", "ofi_norm", "buckets_completed", "vpin", "kyle_lambda", "kyle_valid", "z_last_price", "z_ofi"]
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), *columns) == rows_of(folds.run(df, made, ["token", "seq"], ["ts_ns", "seq"]), *columns)


def test_flow_fold_equals_the_windows(spark):
    df = raw(spark)
    columns = ["token", "seq", "direction", "direction_valid", "cum_direction", "ofi", "ofi_valid", "cum_ofi", "ofi_norm"]
    assert rows_of(folds.run(df, [folds.Flow()], ["token", "seq"], ["ts_ns", "seq"]), *columns) == rows_of(ticks.order_flow(ticks.trade_direction(df)), *columns)


def test_idle_keys_expire_by_timer(spark, tmp_path):
    df = raw(spark, 4, 1)
    late = df.withColumns({"ts_ns": F.col("ts_ns") + 7200 * NS, "seq": F.col("seq") + 4, "ts": F.col("ts") + F.expr("interval 2 hours")})
    beat = df.limit(1).withColumns({"token": F.lit(9), "ts_ns": F.col("ts_ns") + 5400 * NS, "ts": F.col("ts") + F.expr("interval 90 minutes")}).select(df.columns)
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for part in (df, beat, late):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for name, idle in (("short", 3_600_000), ("long", 36_000_000)):
            run(S.folded(source(), [folds.Flow()], ["token", "seq"], ["ts_ns", "seq"], at="ts", idle_ms=idle), tmp_path, name)
    known = lambda name: {r.seq: r.ofi_valid for r in spark.read.parquet(str(tmp_path / name)).where("token = 0").collect()}
    assert known("short") == {i: i not in (0, 4) for i in range(8)}  # the state was dropped before the last four
    assert known("long") == {i: i != 0 for i in range(8)}


def test_chain_of_streams_equals_the_batch(spark, tmp_path):
    df = raw(spark)
    flow = ticks.order_flow(ticks.trade_direction(df))
    wanted = flow.where("ofi_valid").select(
        "token", "seq", "ts_ns", F.col("last_price").alias("price"), F.signum("ofi").cast("int").alias("action"), F.abs("ofi_norm").alias("confidence")
    )
    intents = strategy.intents(wanted)
    orders = intents.select("token", "ts_ns", "seq", "side", F.col("qty").alias("units"), F.col("qty").cast("double").alias("quantity"), "price", F.lit(1).alias("segment"))
    fills = charges.simulate(orders).withColumn("price", F.col("fill"))
    held = portfolio.positions(fills)
    for part in range(2):
        df.where(F.floor(F.col("seq") / 30) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # A tick of another token, far ahead, lets the watermark pass the end of the session.
    beat = df.limit(1).withColumns({"token": F.lit(-1), "ts_ns": F.col("ts_ns") + 7 * 86400 * NS, "ts": F.col("ts") + F.expr("interval 7 days")}).select(df.columns)
    beat.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed = S.folded(source, [folds.Flow()], ["token", "seq", "ts_ns", "last_price"], ["ts_ns", "seq"], at="ts")
    live = streamed.where("ofi_valid").select(
        "token", "seq", "ts_ns", "ts", F.col("last_price").alias("price"), F.signum("ofi").cast("int").alias("action"), F.abs("ofi_norm").alias("confidence")
    )
    made = S.intents(live, late=None)
    prices = source.select("token", "ts", "ts_ns", "seq", "last_price").withWatermark("ts", "10 seconds")
    run(S.accounts(S.fills(made), prices, late=None, close_ms=0, every_ms=7 * S.DAY_MS), tmp_path, "chain")
    got = spark.read.parquet(str(tmp_path / "chain"))
    columns = ["token", "seq", "quantity", "avg_cost", "realized", "fees"]
    assert rows_of(got.where("kind = 'fill'"), *columns) == rows_of(held, *columns)
    want = portfolio.square_off(held, portfolio.last_prices(df))
    assert rows_of(got.where("kind = 'square_off'"), "token", "quantity", "realized", "cash_change") == [
        tuple(pytest.approx(x) for x in r) for r in rows_of(want, "token", "quantity", "realized", "cash_change")
    ]


def test_session_ends_at_the_close_of_the_clock():
    a = S.Accounts(S.CLOSE_MS - S.IST_MS, S.DAY_MS, 1, False)
    close = 10 * 3_600_000  # 15:30 in India
    assert (a.ends(close - 1), a.ends(close), a.ends(0)) == (close, close + S.DAY_MS, close)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_slices_equal_whole_tokens(spark, width):
    df = raw(spark, 70)
    width_ns = width * 60 * NS
    same = lambda a, b, *c: rows_of(a, *c) == rows_of(b, *c)
    assert same(blocked.cumulative_direction(df, width_ns), ticks.trade_direction(df), "token", "seq", "direction", "direction_valid", "cum_direction")
    assert same(blocked.cumulative_flow(df, width_ns), ticks.order_flow(df), "token", "seq", "ofi", "ofi_valid", "cum_ofi")
    assert same(blocked.volume_clock(df, 10, width_ns), ticks.volume_clock(df, 10), "token", "seq", "buckets_completed", "bucket_closed")
    equity = df.withColumn("equity", F.col("last_price"))
    assert same(blocked.max_drawdown(equity, width_ns), backtest.max_drawdown(equity), "token", "max_drawdown", "max_drawdown_pct")
    bars = df.select("token", "ts_ns", "seq", F.col("last_price").alias("close"), F.col("last_quantity").alias("volume"),
                     ((F.col("last_price") - 104) / 500).alias("log_return"), (F.col("seq") % 7 > 0).alias("return_valid"),
                     ((F.col("seq") % 5) / 1000).alias("rv_var"), (F.col("seq") > 3).alias("rv_valid"))
    key = ["token", "seq"]
    for made, fold in ((blocked.rsi, folds.Rsi()), (blocked.macd, folds.Macd()), (blocked.kalman, folds.Kalman())):
        columns = [*key, *(c for c, _ in folds.fields(fold.outputs))]
        got, want = rows_of(made(bars, key, width_ns), *columns), rows_of(folds.run(bars, [fold], key, ["ts_ns", "seq"]), *columns)
        assert len(got) == len(want) == 210
        for a, b in zip(got, want, strict=True):
            assert a == tuple(x if isinstance(x, bool) else pytest.approx(x, abs=1e-9) for x in b), (made, b)


def test_no_task_of_a_sliced_scan_holds_a_token(spark):
    plan = blocked.cumulative_direction(raw(spark), NS)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    # Windows over a token alone run over one row for each slice: what a join has already summed up.
    assert windows and all("_slice" in line.split("windowspecdefinition")[1] for line in windows)


def test_sessions_of_typed_state_without_event_time(spark, tmp_path):
    rows = [(1, 0, 0, 5, 1), (1, 1, 0, 5, 1), (1, 3, 1, 5, 1), (1, 4, 1, 5, -1)]
    df = spark.createDataFrame(rows, "token long, ts_ns long, day long, last_quantity long, direction int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(S.folded(source, [folds.Vpin(10)], ["token", "ts_ns"], ["ts_ns"], session="day"), tmp_path, "out")
    got = rows_of(spark.read.parquet(str(tmp_path / "out")), "ts_ns", "buckets_completed", "vpin")
    assert [tuple(r) for r in got] == [(0, 0, None), (1, 1, 1.0), (3, 0, None), (4, 1, 0.0)]


class Store:
    """A handle to a store that counts the messages which go to it."""

    def __init__(self):
        self.calls, self.value = 0, None

    def getValueState(self, name, schema):  # noqa: N802
        return self

    getListState = getValueState  # noqa: N815

    def said(self, *args):
        self.calls += 1

    def get(self):
        self.calls += 1
        return self.value

    exists = put = update = clear = said


def test_messages_to_the_store():
    """A key without state costs a message to load, and one to save it and for each list that holds something."""
    store = Store()
    cells = S.Cells(store, [folds.Flow(), folds.Vpin(10), folds.KyleLambda()], "at_seq long")
    assert cells.load() == (None, None) and store.calls == 1
    states = cells.fresh()
    states[2]["pairs"] = [None]
    cells.save([1], states)
    assert store.calls == 3
