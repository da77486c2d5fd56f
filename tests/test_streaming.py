"""Streams give what batches give."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tickloom.operators import bar_signals, derived, folds, ticks
from tickloom.sources import readers, vendor
from tickloom.streaming import bars


def drain(spark, stream, mode, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_fold_over_a_stream_equals_the_batch(spark, tmp_path):
    rows = [(k, i, 100.0 + (i * 7 + k) % 11) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "token long, ts_ns long, close double")
    for part in range(2):
        df.where(F.floor(F.col("ts_ns") / 20) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed = drain(spark, bars.stream_fold(source, [folds.Macd()], ["token", "ts_ns"], ["ts_ns"]), "append", "folded", tmp_path)
    batch = folds.run(df, [folds.Macd()], ["token", "ts_ns"], ["ts_ns"])
    key = lambda r: (r.token, r.ts_ns)
    got, want = sorted(streamed.collect(), key=key), sorted(batch.collect(), key=key)
    assert len(got) == 120 and got == want


def test_bars_wait_for_the_watermark(spark, tmp_path):
    rows = [(1, i, float(i), 1, i * 20) for i in range(30)]
    df = spark.createDataFrame(rows, "token long, seq long, last_price double, last_quantity long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "ticks"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ticks"))
    out = drain(spark, bars.stream_bars(source), "append", "minute_bars", tmp_path).orderBy("bar_start").collect()
    assert out and (out[0].open, out[0].close, out[0].tick_count) == (0.0, 2.0, 3) and len(out) < 11


def test_window_folds_equal_the_window_operators(spark):
    rows = [(k, i, i, 100.0 + (i * 7 + k) % 11, (i * 3 + k) % 9 + 1, (i + k) % 3 - 1, float((i * 5) % 13 - 6)) for k in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "token long, ts_ns long, seq long, last_price double, last_quantity long, direction int, ofi double")
    keyed = lambda d, *c: {(r.token, r.seq): tuple(pytest.approx(r[x]) if r[x] is not None else None for x in c) for r in d.collect()}
    plain = lambda d, *c: {(r.token, r.seq): tuple(r[x] for x in c) for r in d.collect()}
    run = lambda fold, d=df: folds.run(d, [fold], ["token", "seq"], ["ts_ns", "seq"])
    clock = ("buckets_completed", "bucket_closed", "vpin")
    assert plain(run(folds.Vpin(10)), *clock) == keyed(ticks.vpin_by_tick(df, 10), *clock)
    kyle = ("kyle_lambda", "kyle_valid")
    assert plain(run(folds.KyleLambda()), *kyle) == keyed(ticks.kyle_lambda(df), *kyle)
    marked = df.withColumn("log_return", F.col("ofi") / 100).withColumn("return_valid", F.col("seq") % 7 > 0)
    rv = ("rv_var", "rv_sigma_ann", "rv_valid")
    assert plain(run(folds.Volatility(), marked), *rv) == keyed(bar_signals.realized_volatility(marked, skip_invalid=True), *rv)
    z = ("z_ofi", "z_last_price", "norm_valid")
    assert plain(run(folds.Normaliser(["ofi", "last_price"], 15)), *z) == keyed(derived.normalised(df, ["ofi", "last_price"], 15), *z)


def test_sessions_and_late_rows_of_a_stream(spark, tmp_path):
    kind = "token long, ts_ns long, day long, last_quantity long, direction int"
    first = [(1, 0, 0, 5, 1), (1, 1, 0, 5, 1), (1, 3, 1, 5, 1)]
    second = [(1, 2, 1, 9, -1), (1, 4, 1, 5, -1)]
    for part in (first, second):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.createDataFrame(first, kind).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = bars.stream_fold(source, [folds.Vpin(10)], ["token", "ts_ns"], ["ts_ns"], session="day", idle="2 hours")
    # A timeout asks for batches without end, so this one is stopped once the rows are there.
    query = out.writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.monotonic() + 60
    while spark.table("sessions").count() < 4 and time.monotonic() < until:
        time.sleep(0.5)
    query.stop()
    got = sorted((r.ts_ns, r.buckets_completed, r.vpin) for r in spark.table("sessions").collect())
    assert got == [(0, 0, None), (1, 1, 1.0), (3, 0, None), (4, 1, 0.0)]


def test_consumer_counts_what_it_leaves_out(spark):
    raw = spark.createDataFrame([('{"token":1,"seq":1}',), (None,), ('{"token":0}',), ('{"token":',), ('{"token":2,"seq":2}',)], "payload string")
    seen = Observation("consumed")
    assert sorted(r.token for r in readers.consumed(raw, "token long, seq long", seen).collect()) == [1, 2]
    assert seen.get == {"messages": 5, "missing": 1, "parse_errors": 1, "unknown": 1}


def test_vendor_source(spark, tmp_path):
    spark.dataSource.register(vendor.VendorSource)
    options = {"adapter": "tests.fake_vendor:Feed", "symbols": "A,B", "key": "secret"}
    past = spark.read.format("vendor").options(**options, first_ns=3, last_ns=5).load()
    assert sorted((r.symbol, r.ts_ns) for r in past.collect()) == [(s, t) for s in "AB" for t in (3, 4, 5)]
    live = spark.readStream.format("vendor").options(**options).load()
    query = live.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("live").count() == 12
