"""Queries of sources and sinks that write what they read first, from the given tables, into the shared folder."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from tickloom.functions.folders import shared_folder
from tickloom.functions.numeric import quantised as q
from tickloom.operators import ingest as I  # noqa: E741
from tickloom.operators import schedule
from tickloom.operators import ticks as T
from tickloom.plans.ingest_queries import DAY, T0, tick_folder
from tickloom.plans.tick_queries import FLOWED, Q, flowed
from tickloom.sources import adapters as A
from tickloom.sources import archives, binary, merging, published, sinks, vendor
from tickloom.streaming.replay import replayed

END, FIRST_NS, LAST_NS = T0 + 31 * DAY, T0 + 5 * DAY, T0 + 12 * DAY
SYMBOLS = ("1", "2", "3", "7", "11")
NOW = "2024-02-12 12:00:00"


def vendor_rows(s, d, live):
    s.dataSource.register(vendor.VendorSource)
    options = {"adapter": "tickloom.sources.recorded:Recorded", "symbols": ",".join(SYMBOLS), "table": f"{d}/events.parquet"}
    if live:
        return replayed(s.readStream.format("vendor").options(**options, after=T0, position=END).load())
    return s.read.format("vendor").options(**options, first_ns=FIRST_NS, last_ns=LAST_NS).load()


def newest_ticks(s, d):
    rows = A.tick_rows(A.streamed(s, d, "events")).select("token", "seq", "ts_ns", "last_price")
    folder = shared_folder(s, "published")
    query = sinks.publish(rows, f"{folder}/out", 700, f"{folder}/progress")
    query.processAllAvailable()
    query.stop()
    return published.newest(s, f"{folder}/out", 700)


def written_tables(s, d):
    """Backtest ticks and signals in tables by day, as their sinks write them, read back."""
    folder = shared_folder(s, "tables")
    ticks = A.ticks(s, d).select("token", "ts_ns", "last_price", "bid_price", "ask_price", F.col("last_price").alias("vwap"), F.col("last_quantity").alias("volume"))
    sinks.write_table(ticks, folder, "backtest_ticks")
    sinks.write_table(T.ofi_signals(flowed(s, d), 300), folder, "signals")
    back, signals = (s.read.parquet(f"{folder}/{name}").groupBy("day") for name in ("backtest_ticks", "signals"))
    return back.agg(F.count(F.lit(1)).alias("ticks"), F.sum("volume").alias("volume"), F.count_distinct("token").alias("tokens")).join(
        signals.agg(F.count(F.lit(1)).alias("signals"), F.sum("action").alias("net_action")), "day"
    )


def by_day(s, d):
    e = A.read(s, d, "events")
    return e.groupBy(F.col("ts").cast("date").alias("date"), F.col("user_id").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


def merged_days(s, d):
    """A table of days, and a load that touches some of them: half of its keys are new."""
    folder = shared_folder(s, "days")
    rows = by_day(s, d)
    rows.where("symbol % 2 = 0").repartition("date").write.partitionBy("date").parquet(folder)
    load = rows.where("day(date) % 5 = 0 AND symbol % 3 = 0").withColumn("top", F.col("top") + 1)
    merging.merge_days(s, folder, load, lambda table, fresh: I.upsert(table, fresh, ["date", "symbol"]))
    return s.read.parquet(folder).select("date", "symbol", "n", q(F.col("top")).alias("top"))


def zip_archives(s, d):
    """Archives of the parts, by size, with a member for each manufacturer and one that isn't a table; each member has a bad line."""
    line = F.concat_ws(",", F.col("p_partkey"), F.concat(F.lit('"'), F.col("p_name"), F.lit(', inc"')), F.col("p_retailprice").cast("string"))
    members = A.read(s, d, "part").groupBy((F.col("p_size") % 10).alias("archive"), F.col("p_brand").alias("member")).agg(F.sort_array(F.collect_list(line)).alias("lines"))

    def pack(frame):
        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "not,a,table")
            for member, lines in zip(frame["member"], frame["lines"], strict=True):
                z.writestr(f"{member}.CSV", "\r\n".join(["SYMBOL,NAME,CLOSE", *lines, "cut,off", ""]))
        return pd.DataFrame({"path": [f"{frame['archive'][0]}.zip"], "content": [out.getvalue()]})

    return members.groupBy("archive").applyInPandas(pack, "path string, content binary")


def job_runs(s, d):
    """Runs of the jobs as the event table has them: an event is a run of the job that its user's number gives."""
    names = F.array(*[F.lit(x) for x in schedule.SCHEDULES])
    return A.read(s, d, "events").where("event_id % 7 = 0").select(F.get(names, (F.col("user_id") % len(schedule.SCHEDULES)).cast("int")).alias("job"), F.col("ts").cast("timestamp").alias("ran"))


def jobs(s):
    rows = [(job, when, "2024-01-01 00:00:00") for job, when in schedule.SCHEDULES.items()]
    return s.createDataFrame(rows, "job string, schedule string, since string").withColumn("since", F.to_timestamp("since"))


QUERIES = {
    "a9_binary_range": lambda s, d: binary.tick_files(s, tick_folder(s, d), records=1000).where(f"token IN (3, 7) AND ts_ns BETWEEN {FIRST_NS} AND {LAST_NS}").select(
        "token", "ts_ns", q(F.col("last_price").cast("double"), 2).alias("last_price")
    ),
    "a17_header_probe": lambda s, d: binary.tick_headers(s, tick_folder(s, d)).select("token", "first_ns", "last_ns", "records"),
    "a17_footer_range": lambda s, d: binary.footer_ranges(s, f"{d}/events.parquet", "ts").agg(
        F.sum("records").alias("records"), A.epoch_ns(F.to_timestamp_ntz(F.min("first"))).alias("first_ns"), A.epoch_ns(F.to_timestamp_ntz(F.max("last"))).alias("last_ns")
    ),
    "a18_vendor_history": lambda s, d: vendor_rows(s, d, False),
    "a18_vendor_live": lambda s, d: vendor_rows(s, d, True),
    "b1_published_stream": lambda s, d: newest_ticks(s, d),
    "b4_written_tables": written_tables,
    "b8_merge_days": merged_days,
    "a15_zip_members": lambda s, d: archives.table_of(archives.member_rows(zip_archives(s, d)), ["SYMBOL", "NAME", "CLOSE"]).select(
        "member", F.col("SYMBOL").cast("long").alias("symbol"), F.col("NAME").alias("name"), q(F.col("CLOSE").cast("double"), 2).alias("close")
    ),
    "i12_due_runs": lambda s, d: schedule.pending(jobs(s), job_runs(s, d), F.to_timestamp(F.lit(NOW))).select("job", F.unix_seconds("due").alias("due_s"), "missed"),
}
_TICKS = f"WITH {A.TICKS}"
_HISTORY = lambda a, b: f"{_TICKS} SELECT token::VARCHAR AS symbol, ts_ns, last_price, 1::BIGINT AS last_quantity FROM ticks WHERE token IN ({', '.join(SYMBOLS)}) AND ts_ns BETWEEN {a} AND {b}"
_JOBS = ", ".join(f"({i}, '{job}', {', '.join('NULL' if w is None else '-1' if x == '*' else x for x in (w or '* * * * *').split())})" for i, (job, w) in enumerate(schedule.SCHEDULES.items()))
ORACLES = {
    "a9_binary_range": f"{_TICKS} SELECT token, ts_ns, floor(last_price::FLOAT::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS last_price FROM ticks WHERE token IN (3, 7) AND ts_ns BETWEEN {FIRST_NS} AND {LAST_NS}",
    "a17_header_probe": f"{_TICKS} SELECT token, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, count(*) AS records FROM ticks GROUP BY token",
    "a17_footer_range": f"{_TICKS} SELECT count(*)::BIGINT AS records, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM ticks",
    "a18_vendor_history": _HISTORY(FIRST_NS, LAST_NS),
    "a18_vendor_live": _HISTORY(T0, END - 1000),
    "b1_published_stream": f"{_TICKS} SELECT token, seq, ts_ns, last_price FROM ticks ORDER BY ts_ns DESC, seq DESC LIMIT 700",
    "b4_written_tables": f"""{FLOWED}, s AS (SELECT ts_ns // {DAY} AS d, count(*) AS signals, sum(sign(ofi))::BIGINT AS net_action FROM flow WHERE ofi_valid AND abs(ofi) >= 300 GROUP BY d),
        t AS (SELECT ts_ns // {DAY} AS d, count(*) AS ticks, sum(last_quantity)::BIGINT AS volume, count(DISTINCT token) AS tokens FROM ticks GROUP BY d)
        SELECT DATE '1970-01-01' + d::INT AS day, ticks, volume, tokens, signals, net_action FROM t JOIN s USING (d)""",
    "b8_merge_days": f"""WITH r AS (SELECT ts::DATE AS date, user_id AS symbol, count(*) AS n, max(value) AS top FROM events GROUP BY ALL)
        SELECT date, symbol, n, {Q('CASE WHEN day(date) % 5 = 0 AND symbol % 3 = 0 THEN top + 1 ELSE top END')} AS top FROM r
        WHERE symbol % 2 = 0 OR day(date) % 5 = 0 AND symbol % 3 = 0""",
    "a15_zip_members": "SELECT p_brand || '.CSV' AS member, p_partkey AS symbol, p_name || ', inc' AS name, floor(p_retailprice::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS close FROM part",
    # Every minute of the time against every job.
    "i12_due_runs": f"""WITH j(i, job, mi, h, dom, mo, dow) AS (VALUES {_JOBS}),
        ran AS (SELECT user_id % 11 AS i, max(ts) AS ran FROM events WHERE event_id % 7 = 0 GROUP BY user_id % 11),
        m AS (SELECT t, t + INTERVAL 330 MINUTE AS l FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '{NOW}', INTERVAL 1 MINUTE)) AS t)),
        due AS (SELECT job, t FROM j LEFT JOIN ran USING (i) JOIN m ON t > coalesce(ran, TIMESTAMP '2024-01-01') AND (mi = -1 OR mi = minute(l)) AND (h = -1 OR h = hour(l))
            AND (dom = -1 OR dom = day(l)) AND (mo = -1 OR mo = month(l)) AND (dow = -1 OR dow = dayofweek(l)))
        SELECT job, epoch(max(t))::BIGINT AS due_s, count(*) - 1 AS missed FROM due GROUP BY job""",
}
