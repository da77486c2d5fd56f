"""Binary ranges, probes, committed streams, vendors, merges by day, archives, schedules and arrival order."""

from __future__ import annotations

import os
import random
import struct
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, folds, ingest, schedule
from tickloom.sources import archives, binary, merging, published, sinks, vendor

TICK = "ts_ns long, token long, last_price double, bid_price double, ask_price double, vwap double, volume long"


def ticks(spark, n, token=7, start=0):
    return spark.range(n).select(
        (F.col("id") + start).alias("ts_ns"), F.lit(token).cast("long").alias("token"), (F.col("id") % 100 / 4).alias("last_price"), F.lit(1.0).alias("bid_price"),
        F.lit(2.0).alias("ask_price"), F.lit(1.5).alias("vwap"), F.col("id").alias("volume"),
    )


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    n = 300_000
    (row,) = binary.write_tick_files(ticks(spark, n), str(tmp_path)).collect()
    assert (row.records, os.path.getsize(tmp_path / "7.ticks")) == (n, 64 + 32 * n)
    rows = binary.tick_files(spark, str(tmp_path), records=10_000)
    assert rows.rdd.getNumPartitions() == 30
    assert rows.agg(F.count("*"), F.sum("ts_ns"), F.sum("volume"), F.countDistinct("ts_ns")).first() == (n, n * (n - 1) // 2, n * (n - 1) // 2, n)
    wanted = rows.where("ts_ns >= 1000 AND ts_ns < 1010 AND token = 7")
    assert sorted(r.ts_ns for r in wanted.collect()) == list(range(1000, 1010))


def test_filters_reach_the_reader(tmp_path, spark):
    both = ticks(spark, 5000).union(ticks(spark, 100, 8, 10_000))
    assert {r.token: r.records for r in binary.write_tick_files(both, str(tmp_path)).collect()} == {7: 5000, 8: 100}
    reader = binary.TickReader({"path": str(tmp_path), "records": "1000"})
    left = list(reader.pushFilters([binary.EqualTo(("token",), 7), binary.GreaterThan(("ts_ns",), 99), binary.LessThanOrEqual(("ts_ns",), 104), binary.EqualTo(("volume",), 5)]))
    assert left == [binary.EqualTo(("volume",), 5)] and (reader.tokens, reader.low, reader.high) == ({7}, 100, 104)
    assert len(reader.partitions()) == 6
    got = [t for p in reader.partitions() for b in reader.read(p) for t in b.column("ts_ns").to_pylist()]
    assert got == [100, 101, 102, 103, 104]
    for ordered in ("true", "false"):
        rows = binary.tick_files(spark, str(tmp_path), ordered=ordered).where("ts_ns > 9999 AND token IN (7, 8)")
        assert rows.count() == 100


def test_header_probe_and_errors(spark, tmp_path):
    magic = 0x414C50484154494B
    good = struct.pack("<QIIQQQIIQQ", magic, 1, 9, 10, 20, 2, 32, 0, 0, 0) + bytes(64)
    (tmp_path / "a.ticks").write_bytes(good)
    assert [tuple(r)[1:] for r in binary.tick_headers(spark, str(tmp_path)).collect()] == [(9, 10, 20, 2)]
    for said, data in {
        "no header": good[:50], "not a tick file": b"x" * 128, "version 2": struct.pack("<QI", magic, 2) + good[12:],
        "records of 31 bytes": good[:40] + struct.pack("<I", 31) + good[44:], "cut off": good[:-1],
    }.items():
        (tmp_path / "a.ticks").write_bytes(data)
        for read in (binary.tick_files, binary.tick_headers):
            with pytest.raises(Exception, match=said):
                read(spark, str(tmp_path)).collect()


def test_footer_ranges(spark, tmp_path):
    spark.range(1000).select((F.col("id") * 3).alias("x"), F.lit(None).cast("long").alias("none")).repartition(3).write.parquet(str(tmp_path / "t"))
    rows = binary.footer_ranges(spark, str(tmp_path / "t"), "x").collect()
    assert sum(r.records for r in rows) == 1000 and min(int(r.first) for r in rows) == 0 and max(int(r.last) for r in rows) == 2997
    assert all(r.first is None for r in binary.footer_ranges(spark, str(tmp_path / "t"), "none").collect())


def test_replayed_batches_add_no_rows(spark, tmp_path):
    import pyarrow as pa

    writer = published.Writer({"path": str(tmp_path), "capacity": "10"})
    batch = lambda lo: pa.record_batch([pa.array(range(lo, lo + 6)), pa.array(range(lo, lo + 6))], names=["ts_ns", "seq"])
    seqs = lambda: sorted(r.seq for r in published.newest(spark, str(tmp_path)).collect())
    assert published.newest(spark, str(tmp_path)) is None
    writer.commit([writer.write(iter([batch(0)])), writer.write(iter([])), None], 0)
    assert seqs() == list(range(6))
    writer.commit([writer.write(iter([batch(0)]))], 0)  # the same batch once more
    writer.abort([writer.write(iter([batch(50)])), None], 1)  # a batch that fails
    assert seqs() == list(range(6)) and len(os.listdir(tmp_path / "rows")) == 1
    for k in range(1, 5):
        writer.commit([writer.write(iter([batch(6 * k)]))], k)
    assert seqs() == list(range(18, 30)) and len(os.listdir(tmp_path / "rows")) == 2
    assert sorted(r.seq for r in published.newest(spark, str(tmp_path), 10).collect()) == list(range(20, 30))


def test_each_symbol_resumes_at_its_own_offset(spark, tmp_path):
    spark.dataSource.register(vendor.VendorSource)
    options = {"adapter": "tests.fake_vendor:Feed", "key": "secret", "log": str(tmp_path / "log"), "position": str(tmp_path / "position")}

    def run(symbols, position):
        (tmp_path / "position").write_text(str(position))
        live = spark.readStream.format("vendor").options(**options, symbols=symbols).load()
        query = live.writeStream.format("parquet").trigger(availableNow=True).option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.awaitTermination()

    run("A,B", 4)
    run("A,B,C", 7)
    rows = sorted((r.symbol, r.ts_ns) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == sorted([(s, t) for s in "ABC" for t in range(7)])
    reads = [line.split() for line in (tmp_path / "log").read_text().splitlines()]
    assert sorted({(s, int(a), int(b)) for s, a, b, _ in reads}) == [("A", 0, 4), ("A", 4, 7), ("B", 0, 4), ("B", 4, 7), ("C", 0, 7)]
    assert str(os.getpid()) not in {pid for *_, pid in reads}


def test_merges_touch_only_their_days(spark, tmp_path):
    path = str(tmp_path / "table")
    kind = "date date, symbol string, close double"
    day = lambda n: datetime(2024, 1, n).date()
    spark.createDataFrame([(day(n), s, float(n)) for n in range(1, 9) for s in "AB"], kind).repartition("date").write.partitionBy("date").parquet(path)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    load = spark.createDataFrame([(day(3), "A", 33.0), (day(3), "C", 34.0), (day(20), "A", 35.0)], kind)
    merge = lambda table, fresh: ingest.upsert(table, fresh, ["date", "symbol"])
    merging.merge_days(spark, path, load, merge)
    after = files()
    assert {f for f in before - after} == {f for f in before if "2024-01-03" in f} and {f.split("date=")[1][:10] for f in after - before} == {"2024-01-03", "2024-01-20"}
    rows = {(r.date.day, r.symbol): r.close for r in spark.read.parquet(path).collect()}
    assert len(rows) == 18 and rows[3, "A"] == 33 and rows[3, "B"] == 3 and rows[3, "C"] == 34 and rows[20, "A"] == 35 and rows[4, "A"] == 4
    kept = {f: os.path.getmtime(f) for f in files()}
    bad = lambda table, fresh: merge(table, fresh).withColumn("close", F.when(F.col("symbol") == "C", F.raise_error(F.lit("no"))).otherwise(F.col("close")))
    with pytest.raises(Exception, match="no"):
        merging.merge_days(spark, path, load, bad)
    assert {f: os.path.getmtime(f) for f in files()} == kept


def test_zip_members(spark, tmp_path):
    big = "SYMBOL,CLOSE\n" + "".join(f"S{i},{i}\n" for i in range(20_000))
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.csv", "﻿SYMBOL, CLOSE\r\n\r\nA,1\r\n\"B, x\",2\r\nC\r\nD,4,5\r\n\r\nE,5")
        z.writestr("two.CSV", big)
        z.writestr("bad.csv", b"SYMBOL,CLOSE\nF,\xff\xfe\nG,7\n")
        z.writestr("readme.txt", "SYMBOL,CLOSE\nX,1")
        z.writestr("empty.csv", "")
    rows = archives.table_of(archives.zipped(spark, str(tmp_path / "a.zip")), ["SYMBOL", "CLOSE", "OPEN"])
    assert [(r.SYMBOL, r.CLOSE, r.OPEN) for r in rows.where("member = 'one.csv'").orderBy("line").collect()] == [("A", "1", None), ("B, x", "2", None), ("E", "5", None)]
    assert rows.groupBy("member").count().where("member = 'two.CSV'").first()["count"] == 20_000
    assert [(r.SYMBOL, r.CLOSE) for r in rows.where("member = 'bad.csv'").collect()] == [("G", "7")]
    (tmp_path / "b.zip").write_bytes(b"PK nothing")
    with pytest.raises(Exception, match="zip"):
        archives.zipped(spark, str(tmp_path / "b.zip")).collect()
    assert archives.member_rows(spark.createDataFrame([], "path string, content binary")).count() == 0


def fits(field, value, low, high):
    for part in field.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if span == "*" else (int(a), int(b) if b else high if step else int(a))
        if first <= value <= last and (value - first) % int(step or 1) == 0:
            return True
    return False


def brute_due(text, last, now):
    mi, h, dom, mo, dow = text.split()
    out, t = [], last + timedelta(minutes=1)
    while t <= now:
        x = t + timedelta(minutes=330)
        week = any(fits(dow, v, 0, 7) for v in ({x.isoweekday() % 7} | ({7} if x.isoweekday() == 7 else set())))
        month_day = fits(dom, x.day, 1, 31)
        day = month_day or week if dom[0] != "*" and dow[0] != "*" else month_day and week
        if fits(mi, x.minute, 0, 59) and fits(h, x.hour, 0, 23) and fits(mo, x.month, 1, 12) and day:
            out.append(t)
        t += timedelta(minutes=1)
    return out


def test_due_times_equal_a_scan_of_minutes(spark):
    rng = random.Random(8)
    times = [x for x in schedule.SCHEDULES.values() if x] + ["*/7 3-5 * * *", "0 0 1,15 * 1-5", "5,10-12 */6 */9 1-3/2 *", "30 22 29 2 *", "15 8 * * 7", "59 23 31 12 0"]
    last = datetime(2024, 1, 20, 3, 30)
    rows = [(f"{i} {t}", t, last + timedelta(minutes=rng.randrange(900)), datetime(2024, 3, 5, 1, 2)) for i, t in enumerate(times)]
    rows += [("never", None, last, rows[0][3])] + [(f"bad {x}", x, last, rows[0][3]) for x in ("60 * * * *", "* * * *", "a * * * *", "5-3 * * * *", "*/0 * * * *", "")]
    got = {}
    for r in schedule.due(spark.createDataFrame(rows, "job string, schedule string, last_run timestamp, now timestamp")).collect():
        got.setdefault(r.job, []).append(r.due)
    assert {k: sorted(v) for k, v in got.items()} == {j: w for j, t, a, b in rows[: len(times)] if (w := brute_due(t, a, b))}


def test_all_jobs_have_a_time_and_a_load():
    assert set(schedule.SCHEDULES) == set(ingest.JOBS) and len(ingest.JOBS) == 11


def test_jobs_of_every_kind(spark):
    day = F.lit("2024-01-25").cast("date")
    table = spark.createDataFrame([("NIFTY", "A", "", "", True), ("NIFTY", "B", "", "", True), ("BANK", "B", "", "", True)], "index_name string, symbol string, isin string, industry string, is_active boolean")
    raw = spark.createDataFrame([("NIFTY", "A", "I1", "Oil"), ("NIFTY", "C", "I2", "Tea")], ["Index", "Symbol", "ISIN Code", "Industry"])
    got = {(r.index_name, r.symbol): r.is_active for r in ingest.run_job("index_constituents", table, raw, day).collect()}
    assert got == {("NIFTY", "A"): True, ("NIFTY", "B"): False, ("NIFTY", "C"): True, ("BANK", "B"): True}
    wide = spark.createDataFrame([("A", "2024-01-02", 1.5, 0.0), ("B", "2024-01-03", 0.0, 2.0)], "symbol string, ex_date string, dividend double, split double")
    known = spark.createDataFrame([("A", "2024-01-02", "DIVIDEND", 9.0)], "symbol string, ex_date string, action string, value double")
    assert sorted((r.symbol, r.action, r.value) for r in ingest.run_job("yahoo_finance", known, wide, day).collect()) == [("A", "DIVIDEND", 9.0), ("B", "SPLIT", 2.0)]
    lines = spark.createDataFrame([("2024-01-02", "FII", "1,000", "5", "995"), ("2024-01-03", "DII", "1", "2", "-1")], "date string, category string, buyValue string, sellValue string, netValue string")
    flows = spark.createDataFrame([("2024-01-02", "FII", 1.0, 1.0, 0.0)], "date string, category string, buy_value double, sell_value double, net_value double")
    assert sorted((r.date, r.net_value) for r in ingest.run_job("fii_activity", flows, lines, day).collect()) == [("2024-01-02", 995.0), ("2024-01-03", -1.0)]
    off = spark.createDataFrame([(datetime(2024, 1, 26).date(), "CM", "old")], "date date, segment string, description string")
    said = spark.createDataFrame([('{"CM":[{"tradingDate":"26-Jan-2024","description":"Republic Day"}]}',)], ["json"])
    assert [r.description for r in ingest.run_job("holiday_calendar", off, said, day).collect()] == ["Republic Day"]


def test_late_ticks_go_into_the_open_bar(spark):
    m = bars.MINUTE
    # The third and fifth come late: into the bars of minutes 1 and 2, which are open then.
    rows = [(1, 0, 5, 10.0, 1), (1, 1, m + 1, 11.0, 2), (1, 2, 7, 9.0, 4), (1, 3, 2 * m, 12.0, 8), (1, 4, m + 9, 13.0, 16), (1, 5, 3 * m, 14.0, 32)]
    df = spark.createDataFrame(rows, "token long, seq long, ts_ns long, last_price double, last_quantity long").withColumn("direction", F.lit(1))
    got = [(r.bar_ts, r.open, r.high, r.low, r.close, r.volume, r.buy_volume, r.tick_count) for r in bars.arrival_bars(df).orderBy("bar_ts").collect()]
    assert got == [(0, 10, 10, 10, 10, 1, 1, 1), (m, 11, 11, 9, 9, 6, 6, 2), (2 * m, 12, 13, 12, 13, 24, 24, 2)]
    rng, seqs = random.Random(3), list(range(400))
    rng.shuffle(seqs)
    many = spark.createDataFrame([(i % 3, seqs[i], i * m // 4, float(i * 7 % 50), i % 5 + 1) for i in range(400)], df.drop("direction").schema)
    many = many.withColumn("direction", (F.col("seq") % 3 - 1).cast("int")).withColumn("open_interest", F.col("seq").cast("double"))
    columns = ["token", "bar_ts", "open", "high", "low", "close", "volume", "vwap", "buy_volume", "sell_volume", "tick_count", "open_interest"]
    plain = lambda x: sorted(tuple(r) for r in x.select(columns).collect())
    assert plain(folds.run(many, [folds.ArrivalBars()], ["token"], ["seq"]).where("bar_closed")) == plain(bars.arrival_bars(many))


def test_publish_stream(spark, tmp_path):
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).select(F.col("id").alias("seq"), (F.col("id") * 2).alias("ts_ns")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("seq long, ts_ns long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = sinks.publish(source, str(tmp_path / "out"), 12, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert sorted(r.seq for r in published.newest(spark, str(tmp_path / "out"), 12).collect()) == list(range(18, 30))
    assert len(os.listdir(tmp_path / "out" / "rows")) == 2


def test_predicates_of_a_tick_scan_reach_the_files(spark, tmp_path):
    from tickloom.sources import readers

    ticks(spark, 100).write.parquet(str(tmp_path / "t"))
    scan = readers.tick_scan(spark.read.parquet(str(tmp_path / "t")), 7, 10, 19)
    plan = spark._jvm.PythonSQLUtils.explainString(scan._jdf.queryExecution(), "formatted")
    assert "EqualTo(token,7)" in plan and "GreaterThanOrEqual(ts_ns,10)" in plan and "LessThanOrEqual(ts_ns,19)" in plan and scan.count() == 10


def test_upsert_of_a_table_with_any_names(spark):
    table = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k long, is_old string, is_new string")
    rows = spark.createDataFrame([(2, "e", "f"), (3, "g", "h")], table.schema)
    assert sorted(map(tuple, ingest.upsert(table, rows, ["k"]).collect())) == [(1, "a", "b"), (2, "e", "f"), (3, "g", "h")]
