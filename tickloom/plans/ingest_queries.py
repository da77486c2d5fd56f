"""Queries and oracles of sources, sinks, end-of-day ingest and the read side."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.folders import shared_folder
from tickloom.functions.numeric import quantised as q
from tickloom.operators import backtest as K
from tickloom.operators import folds
from tickloom.operators import ingest as I  # noqa: E741
from tickloom.operators import readside as J
from tickloom.operators import ticks as T
from tickloom.plans.bar_queries import P as R
from tickloom.sources import adapters as A
from tickloom.sources import binary, sinks
from tickloom.sources import readers as S

DAY = 86_400_000_000_000
T0 = 1_704_067_200_000_000_000
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CANDLES_FROM, CANDLES_TO = 9000 * DAY, 9900 * DAY


def iso(zone):
    return F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))


def candle_json(s, d):
    e = A.read(s, d, "events")
    cells = F.concat_ws('","', iso("+05:30"), F.lit("1.5"), F.lit("2.5"), F.lit("0.5"), F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    good = F.when(F.col("event_id") % 10 == 0, "error").otherwise("success")
    return e.select(
        F.col("event_type").alias("symbol"), F.concat(F.lit('{"status":"'), good, F.lit('","data":{"candles":[["'), cells, F.lit('"],["x","1"]]}}')).alias("json")
    )


def customers(s, d):
    return A.read(s, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def table_and_rows(s, d):
    c = customers(s, d)
    fresh = c.where("c_custkey % 3 = 0").withColumns({"c_acctbal": F.col("c_acctbal") + 1, "c_mktsegment": F.lit("NEW")})
    return c.where("c_custkey % 2 = 0"), fresh


def ranges(s, d):
    day = F.col("o_orderdate").cast("date")
    return A.read(s, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.min(day).alias("first"), F.max(day).alias("last"))


def traded_days(s, d):
    day = F.col("o_orderdate").cast("date")
    o = A.read(s, d, "orders").where(F.dayofmonth(day) % 9 != 0)
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), day.alias("date")).agg(F.count(F.lit(1)).alias("bars"))


def new_years(s):
    return s.sql("SELECT explode(sequence(date'1992-01-01', date'1998-01-01', interval 1 year)) AS date")


def scd(s, d):
    o = A.read(s, d, "orders")
    table = o.where("o_custkey % 2 = 0").select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("member")).distinct()
    table = table.withColumn("is_active", F.lit(True)).withColumn("weight", F.lit(1))
    rows = o.where("o_custkey % 3 = 0 AND o_orderpriority < '3'").select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("member")).distinct()
    return I.replace_members(table, rows.withColumn("weight", F.lit(2)), ["grp", "member"], ["grp"])


def books(s, d):
    level = F.struct(F.col("value").alias("price"), F.col("event_id").alias("quantity"), F.lit(1).cast("long").alias("orders"))
    return A.read(s, d, "events").select("event_id", F.array_repeat(level, (F.col("event_id") % 8).cast("int")).alias("bids"))


def tick_folder(s, d):
    """A new folder of binary tick files, one for each token of the event table."""
    t = A.ticks(s, d).select("ts_ns", "token", "last_price", "bid_price", "ask_price", F.col("last_price").alias("vwap"), F.col("last_quantity").alias("volume"))
    folder = shared_folder(s, "ticks")
    binary.write_tick_files(t, folder).count()
    return folder


def binary_rows(s, d):
    return binary.tick_files(s, tick_folder(s, d), records=1000)


def end_of_day(s, d):
    """Raw rows as text under the newer headers; every tenth lacks its close."""
    price = F.format_number("p_retailprice", 2)
    return A.read(s, d, "part").select(
        F.concat(F.lit(" S"), F.col("p_partkey"), F.lit(" ")).alias("TckrSymb"), F.lit("EQ").alias("SctySrs"), price.alias("OpnPric"), price.alias("HghPric"),
        price.alias("LwPric"), F.when(F.col("p_partkey") % 10 != 0, price).otherwise("").alias("ClsPric"), F.col("p_size").cast("string").alias("TtlTradgVol"),
    )


def contracts(s, d):
    """Raw rows as text under the older headers; expiries in both forms, every seventh unreadable."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))
    expiry = F.when(F.col("p_partkey") % 7 == 0, "soon").when(F.col("p_partkey") % 2 == 0, F.upper(F.date_format(day, "dd-MMM-yyyy"))).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return A.read(s, d, "part").select(
        F.col("p_partkey").cast("string").alias("SYMBOL"), expiry.alias("EXPIRY_DT"), F.format_number("p_retailprice", 2).alias("STRIKE_PR"),
        F.lit("CE").alias("OPTION_TYP"), F.lit("1.5").alias("CLOSE"), F.format_number(F.col("p_partkey") * 1000, 0).alias("OPEN_INT"),
    )


def loaded_on():
    return F.lit("2024-01-25").cast("date")


def priced(s, d, where, plus, *names):
    """Raw rows as text from ``part``: a price under each of the headers given, plus something; every tenth's last one can't be read."""
    part = A.read(s, d, "part").where(where)
    price = F.format_number(F.col("p_retailprice") + plus, 2)
    cells = {n: price for n in names[:-1]} | {names[-1]: F.when(F.col("p_partkey") % 10 == 0, "n/a").otherwise(price)}
    return part.select("p_partkey", "p_size", "p_brand", *[c.alias(n) for n, c in cells.items()])


def index_file(s, d, where, plus):
    raw = priced(s, d, where, plus, "Open", "High", "Low", "Close")
    return raw.withColumns({"Index Name": F.concat(F.lit("IX"), F.col("p_partkey")), "Volume": F.col("p_size").cast("string"), "P/E": F.lit("")})


def contract_file(s, d, where, plus):
    raw = priced(s, d, where, plus, "OPEN", "HIGH", "LOW", "CLOSE")
    return raw.withColumns({
        "SYMBOL": F.col("p_partkey").cast("string"), "EXPIRY_DT": F.when(F.col("p_partkey") % 2 == 0, "25-JAN-2024").otherwise("2024-01-25"),
        "STRIKE_PR": F.lit("100"), "OPTION_TYP": F.lit("CE"), "SETTLE_PR": F.col("CLOSE"), "CONTRACTS": F.col("p_size").cast("string"), "OPEN_INT": F.lit(""),
    })


def stock_file(s, d, where, plus):
    raw = priced(s, d, where, plus, "FACE VALUE")
    return raw.withColumns({"SYMBOL": F.col("p_partkey").cast("string"), "ISIN NUMBER": F.lit("X"), "Security Name": F.concat(F.col("p_brand"), F.lit(f" {plus}")), "SERIES": F.lit("EQ")})


def margin_file(s, d, where, plus):
    raw = priced(s, d, where, plus, "VAR", "ELM")
    return raw.withColumn("Symbol", F.col("p_partkey").cast("string"))


def loaded(s, d, name, file, rows):
    """A table loaded from one file, then from another that overlaps it."""
    old, new = (rows(file(s, d, w, plus), loaded_on()) for w, plus in (("p_partkey % 2 = 0", 0), ("p_partkey % 3 = 0", 1)))
    return I.load(old, new, name)


def deals(s, d, kind):
    o = A.read(s, d, "orders").where(F.col("o_orderpriority") < "3" if kind == "bulk" else F.col("o_orderpriority") > "4")
    raw = o.select(
        F.concat(F.lit("S"), F.col("o_custkey") % 50).alias("SYMBOL"), F.col("o_custkey").cast("string").alias("Client Name"),
        F.when(F.col("o_orderkey") % 2 == 0, "SELL").otherwise("BUY").alias("DEAL_TYPE"), F.format_number("o_orderkey", 0).alias("Quantity"),
        F.when(F.col("o_orderkey") % 7 == 0, "free").otherwise(F.format_number("o_totalprice", 2)).alias("PRICE"),
    )
    return I.deal_rows(raw, loaded_on(), kind)


def activity_lines(s, d):
    label = F.element_at(F.array(*map(F.lit, ("Index Futures", "Stock futures", "INDEX OPTIONS total", "other"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return A.read(s, d, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("at"), label.alias("label"),
        F.col("o_custkey").cast("string").alias("buy"), F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_custkey") % 100).cast("string")).alias("sell"),
    )


def instrument_json(s, d):
    text = F.to_json(F.struct(
        F.when(F.col("p_partkey") % 9 > 0, F.concat(F.lit("K|"), F.col("p_partkey"))).alias("instrument_key"), F.col("p_name").alias("trading_symbol"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("lot_size"), F.lit("0.05").alias("tick_size"),
        F.when(F.col("p_partkey") % 5 > 0, F.col("p_retailprice").cast("string")).otherwise("none").alias("strike_price"), F.col("p_partkey").alias("expiry"),
    ))
    parsed = A.read(s, d, "part").select(F.from_json(text, S.RAW_INSTRUMENT).alias("r")).select("r.*")
    return S.instrument_rows(parsed, loaded_on())


def messages(s, d):
    body = F.to_json(F.struct(F.when(F.col("event_id") % 6 > 0, F.col("user_id")).otherwise(0).alias("token"), F.col("event_id").alias("seq"), F.col("value").alias("last_price")))
    payload = F.when(F.col("event_id") % 4 == 0, F.substring(body, 1, 9)).when(F.col("event_id") % 5 > 0, body)
    return S.consumed(A.read(s, d, "events").select(payload.alias("payload")), "token long, seq long, last_price double")


def feeds(s, d):
    """Maps of feeds: shares with a book of up to seven levels and greeks, every third an index with a price only."""
    level = F.struct(F.col("value").alias("price"), F.col("event_id").alias("quantity"), F.lit(1).cast("long").alias("orders"))
    whole = F.col("event_id") % 3 > 0
    feed = F.struct(
        F.col("value").alias("ltp"), F.when(whole, F.col("event_id")).alias("ltq"), F.when(whole, F.array_repeat(level, (F.col("event_id") % 8).cast("int"))).alias("bids"),
        F.lit(None).cast("array<struct<price:double,quantity:bigint,orders:bigint>>").alias("asks"), F.when(whole, F.struct(F.lit(0.5).alias("delta"), F.lit(0.2).alias("iv"))).alias("greeks"),
    )
    raw = A.read(s, d, "events").select(F.col("event_id").alias("received_ns"), F.create_map(F.concat(F.lit("K"), F.col("user_id")), feed).alias("feeds"))
    tokens = A.read(s, d, "events").where("user_id % 2 = 0").select(F.concat(F.lit("K"), F.col("user_id")).alias("instrument_key"), F.col("user_id").alias("token")).distinct()
    return S.wire_ticks(raw, tokens)


def run_text(s, d):
    """Results and statuses of runs as JSON text; every fifth is cut off."""
    body = F.to_json(F.struct(
        F.col("user_id").alias("instrument_token"), F.col("event_type").alias("symbol"), (F.col("event_id") % 9).alias("total_trades"), F.col("value").alias("total_net_pnl"),
        (F.col("event_id") % 6).alias("state"), F.col("event_id").alias("ticks_processed"), F.when(F.col("event_id") % 7 > 0, 8000).alias("total_ticks"),
    ))
    return A.read(s, d, "events").select(F.when(F.col("event_id") % 5 == 0, F.substring(body, 1, 9)).otherwise(body).alias("payload"))


def requests(s, d):
    return A.ticks(s, d).select(F.col("token").alias("source"), "seq", "ts_ns")


def portfolios(s, d):
    p = F.struct("seq", "last_price")
    return A.ticks(s, d).groupBy("token").agg(F.sum("last_quantity").alias("units"), F.filter(F.collect_list(p), lambda x: x["seq"] % 3 == 0).alias("positions"))


def by_day(ticks):
    return ticks.withColumn("session_id", F.floor(F.col("ts_ns") / DAY).cast("long"))


QUERIES = {
    "a2_token_lookup": lambda s, d: S.with_tokens(
        A.read(s, d, "nation").select(F.col("n_name").alias("instrument_key"), F.col("n_nationkey").cast("long").alias("place")),
        A.read(s, d, "nation").where("n_regionkey < 3").select(F.col("n_name").alias("instrument_key"), (F.col("n_nationkey") + 100).cast("long").alias("token")),
    ),
    "a4_depth_mapping": lambda s, d: books(s, d).select("event_id", S.depth(F.col("bids")).alias("b")).select(
        "event_id", F.size("b").alias("levels"), F.aggregate("b", F.lit(0).cast("long"), lambda t, x: t + x["quantity"]).alias("quantity")
    ),
    "a1_wire_ticks": lambda s, d: feeds(s, d).select(
        "token", "ts_ns", "last_price", "last_quantity", "bid_price", "bid_size", "ask_price", "ask_size", "open_interest", "greeks.delta", "greeks.gamma", "greeks.iv"
    ),
    "a3_stream_consumer": messages,
    "a16_ring_pop": lambda s, d: sinks.popped(A.ticks(s, d), 5, "token").select("token", "seq"),
    "b3_overflow": lambda s, d: sinks.overflow(A.ticks(s, d), 60, "token"),
    "a5_candle_json": lambda s, d: S.candle_rows(candle_json(s, d)),
    "a6_candle_times": lambda s, d: A.read(s, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "bad").otherwise(iso("+00:00")).alias("t")).select(
        "event_id", S.iso_ns_or_zero(F.col("t")).alias("ts_ns"), S.stamped(S.iso_ns_or_zero(F.col("t")), F.lit(T0)).alias("written_ns")
    ),
    "a9_binary_scan": lambda s, d: binary_rows(s, d).select("token", "ts_ns", "volume", *[q(F.col(c).cast("double"), 2).alias(c) for c in ("last_price", "bid_price", "ask_price")]),
    "a15_equity_csv": lambda s, d: I.equity_rows(end_of_day(s, d), F.lit("2024-01-25").cast("date")).select("date", "symbol", "series", "open", "close", "volume"),
    "a15_derivatives_csv": lambda s, d: I.derivative_rows(contracts(s, d), F.lit("2024-01-25").cast("date")).select("symbol", "expiry", "strike", "option_type", "close", "open_interest"),
    "a7_iso_times": lambda s, d: A.read(s, d, "events").select("event_id", S.iso_ns(iso("Z")).alias("utc_ns"), S.iso_ns(iso("")).alias("local_ns")),
    "a8_request_chunks": lambda s, d: I.chunks(ranges(s, d), "15m"),
    "a10_tick_scan": lambda s, d: S.tick_scan(A.ticks(s, d), 7, T0, T0 + 10 * DAY).select("token", "seq", "ts_ns"),
    "a11_first_signal": lambda s, d: K.with_signals(
        A.ticks(s, d).select("token", "seq", "ts_ns"), A.ticks(s, d).select("token", "ts_ns", F.col("last_price").alias("first_price")), A.SIX_HOURS
    ).select("token", "seq", "first_price"),
    "a12_candle_scan": lambda s, d: S.candle_scan(A.day_candles(s, d).withColumn("interval", F.lit("day")), "2-HIGH", "day", CANDLES_FROM, CANDLES_TO).select(
        "symbol", "ts_ns", q(F.col("vwap"), 3).alias("vwap")
    ),
    "a13_universe": lambda s, d: J.of_latest_date(A.read(s, d, "orders"), "o_orderdate", o_orderstatus=["O", "F", "P"]).orderBy("o_orderkey").limit(20).select("o_orderkey", "o_custkey"),
    "a14_instrument_json": lambda s, d: instrument_json(s, d).select("date", "instrument_key", "trading_symbol", "lot_size", "tick_size", "expiry_ms", "strike_price"),
    "a17_time_range": lambda s, d: S.time_range(A.ticks(s, d)),
    "b2_latest_snapshot": lambda s, d: sinks.latest_snapshot(A.ticks(s, d), "token").select("token", "seq", "last_price"),
    "b3_drop_oldest": lambda s, d: sinks.drop_oldest(A.ticks(s, d), 5, "token").select("token", "seq"),
    "c14_session_reset": lambda s, d: T.trade_direction(by_day(A.ticks(s, d)), session=True).select("token", "seq", "cum_direction"),
    "i1_insert_ignore": lambda s, d: I.insert_ignore(*table_and_rows(s, d), ["c_custkey"]),
    "i2_upsert": lambda s, d: I.upsert(*table_and_rows(s, d), ["c_custkey"], ["c_acctbal"]),
    "i3_dates": lambda s, d: A.read(s, d, "orders").select(
        "o_orderkey", I.a_date(F.when(F.col("o_orderkey") % 2 == 0, F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("d")
    ),
    "i3_derivatives_load": lambda s, d: loaded(s, d, "derivatives", contract_file, I.derivative_rows).select("symbol", "expiry", "strike", "open", "close", "settle_price", "volume", "open_interest"),
    "i4_numbers": lambda s, d: A.read(s, d, "orders").select("o_orderkey", q(I.number(F.format_number("o_totalprice", 2)), 2).alias("price")),
    "i4_index_load": lambda s, d: loaded(s, d, "index", index_file, I.index_rows).select("date", "index_name", "open", "close", "volume", "pe_ratio"),
    "i5_deals": lambda s, d: I.append(deals(s, d, "bulk"), deals(s, d, "block")),
    "i6_stock_master": lambda s, d: loaded(s, d, "stock_master", stock_file, lambda raw, _: I.stock_rows(raw)),
    "i10_margin": lambda s, d: loaded(s, d, "margin", margin_file, I.margin_rows),
    "i6_partial_update": lambda s, d: I.partial_update(*table_and_rows(s, d), ["c_custkey"], ["c_acctbal"]),
    "i7_corporate_actions": lambda s, d: I.actions(A.read(s, d, "part").select(
        F.col("p_partkey").alias("symbol"), F.lit("2024-01-25").alias("ex_date"), (F.col("p_size") - 25).cast("double").alias("dividend"),
        (F.col("p_partkey") % 3).cast("double").alias("split"),
    )),
    "i8_activity": lambda s, d: I.derivative_activity(activity_lines(s, d)),
    "i8_cash_activity": lambda s, d: I.cash_activity(A.read(s, d, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"), F.when(F.col("o_custkey") % 2 == 0, "FII").when(F.col("o_custkey") % 3 == 0, "DII").alias("category"),
        F.col("o_orderkey").cast("string").alias("buyValue"), F.col("o_custkey").cast("string").alias("sellValue"), F.lit(None).cast("string").alias("netValue"),
    )),
    "i9_constituents": scd,
    "i11_holidays": lambda s, d: I.holidays(A.read(s, d, "nation").select(F.concat(
        F.lit('{"CM":[{"tradingDate":"'), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"), F.lit('-Jan-2024","description":"'), F.col("n_name"), F.lit('"}],"FO":[]}')
    ).alias("json"))),
    "i13_gap_planner": lambda s, d: I.gaps(I.chunks(ranges(s, d), "15m"), new_years(s), traded_days(s, d), "day"),
    "i14_learned_holidays": lambda s, d: I.learned_holidays(
        I.chunks(ranges(s, d), "15m"), traded_days(s, d).select("date").distinct().select(F.explode(F.array(*map(F.lit, PRIORITIES))).alias("symbol"), "date")
    ),
    "i15_throttle": lambda s, d: I.throttled(A.ticks(s, d).select(F.col("token").alias("source"), "seq", "ts_ns"), 3, DAY).select("source", "seq", "sent", "waits"),
    "i15_sliding_window": lambda s, d: folds.run(requests(s, d), [I.SlidingWindow(3, 20 * DAY, DAY)], ["source", "seq"], ["ts_ns", "seq"], key="source"),
    "i15_token_bucket": lambda s, d: folds.run(requests(s, d), [I.TokenBucket(1 / 172_800, 2.0)], ["source", "seq"], ["ts_ns", "seq"], key="source").select(
        "source", "seq", q(F.col("sent_ns") / 1e9, 3).alias("sent_s"), q(F.col("tokens"), 5).alias("tokens")
    ),
    "i15_backoff": lambda s, d: A.read(s, d, "events").select(
        "event_id", I.backoff_seconds(F.element_at(F.array(*map(F.lit, (200, 429, 500, 503))), (F.col("event_id") % 4 + 1).cast("int")), F.col("event_id") % 5 + 1).alias("seconds")
    ),
    "j1_latest_by_token": lambda s, d: J.latest_by_token(A.ticks(s, d)).select("token", "seq", "last_price"),
    "j2_newest": lambda s, d: J.newest(A.ticks(s, d), 50).select("token", "seq"),
    "j3_price_moves": lambda s, d: J.price_moves(A.ticks(s, d).where("bid_price > 0")).select("token", "seq", "move", q(F.col("spread_bps"), 4).alias("spread_bps")),
    "j4_stream_depth": lambda s, d: J.depth_share(A.ticks(s, d), 50_000),
    "j5_equity_return": lambda s, d: A.ticks(s, d).groupBy("token").agg(q(J.return_pct(F.max_by("last_price", "seq"), F.min_by("last_price", "seq")), 3).alias("return_pct")),
    "j10_range_scan": lambda s, d: J.range_scan(A.ticks(s, d), "token", [3, 5, 7], T0, T0 + 10 * DAY).select("token", "seq", "ts_ns"),
    "j12_update_where": lambda s, d: J.updated_where(
        customers(s, d), F.col("c_mktsegment") == "BUILDING", {"c_acctbal": F.col("c_acctbal") * 2, "c_mktsegment": F.lit("DONE")}
    ),
    "j14_flat_positions": lambda s, d: J.flat_positions(portfolios(s, d)),
    "j14_injected_ticks": lambda s, d: J.injected_after(A.ticks(s, d), 1_000_000_000, 25).select("token", "seq", "ts_ns", "last_price"),
    "j6_tail": lambda s, d: J.tail(A.ticks(s, d), 900).select("token", "seq"),
    "j7_latest_date": lambda s, d: J.of_latest_date(A.read(s, d, "orders"), "o_orderdate").select("o_orderkey"),
    "j8_distinct_times": lambda s, d: A.read(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().orderBy("day"),
    "j9_count_between": lambda s, d: J.count_between(A.ticks(s, d), T0, T0 + 7 * DAY),
    "j11_day_bounds": lambda s, d: A.read(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().select("day", J.day_bounds(F.col("day")).alias("b")).select("day", "b.*"),
    "j13_results": lambda s, d: J.results(run_text(s, d)).select("instrument_token", "symbol", "total_trades", "total_net_pnl", "sharpe_ratio", "winning_trades"),
    "j13_statuses": lambda s, d: J.statuses(run_text(s, d)).select("instrument_token", "state_name", "ticks_processed", q(F.col("progress_pct"), 3).alias("progress_pct")),
    "i12_jobs": lambda s, d: I.run_job(
        "index_bhavcopy", I.index_rows(index_file(s, d, "p_partkey % 2 = 0", 0), loaded_on()), index_file(s, d, "p_partkey % 3 = 0", 1), loaded_on()
    ).select("index_name", "close"),
    "j13_progress": lambda s, d: A.ticks(s, d).groupBy("token").agg(q(J.progress(F.count(F.lit(1)), F.lit(80)), 3).alias("pct")),
}

TK = f"WITH {A.TICKS}"
_UP = """WITH o AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 2 = 0),
    n AS (SELECT c_custkey, c_name, c_acctbal + 1 AS c_acctbal, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0)"""
_RANGES = "r AS (SELECT o_orderpriority AS symbol, min(o_orderdate::DATE) AS f, max(o_orderdate::DATE) AS l FROM orders GROUP BY 1)"
_CHUNKS = f"""{_RANGES}, ch AS (SELECT symbol, s::DATE AS chunk_first, least(l, s::DATE + 74) AS chunk_last
    FROM (SELECT symbol, l, unnest(generate_series(f, l, INTERVAL 75 DAY)) AS s FROM r))"""
_WK = "unnest(generate_series(chunk_first, chunk_last, INTERVAL 1 DAY))::DATE"
_PART = lambda w, plus, cells: f"SELECT p_partkey, p_size, p_brand, round(p_retailprice + {plus}, 2)::DOUBLE AS price, {cells} FROM part WHERE p_partkey % {w} = 0 AND p_partkey % 10 <> 0"
_LOAD = lambda cells, key: f"WITH o AS ({_PART(2, 0, cells)}), n AS ({_PART(3, 1, cells)}), j AS (SELECT {key} AS k, o.price AS op, n.price AS np, coalesce(n.price, o.price) AS p, coalesce(o.price, n.price) AS fp, coalesce(o.p_size, n.p_size) AS size, coalesce(o.p_brand, n.p_brand) AS brand FROM o FULL JOIN n USING (p_partkey))"
_SENT = f"""rq AS MATERIALIZED (SELECT token AS source, seq, ts_ns, row_number() OVER (PARTITION BY token ORDER BY ts_ns, seq) AS n FROM ticks)"""
ORACLES = {
    "a1_wire_ticks": """SELECT user_id AS token, event_id AS ts_ns, value AS last_price, CASE WHEN event_id % 3 > 0 THEN event_id ELSE 0 END::BIGINT AS last_quantity,
        CASE WHEN event_id % 3 > 0 AND event_id % 8 > 0 THEN value ELSE 0.0::DOUBLE END AS bid_price, CASE WHEN event_id % 3 > 0 AND event_id % 8 > 0 THEN event_id ELSE 0 END::BIGINT AS bid_size,
        0.0::DOUBLE AS ask_price, 0::BIGINT AS ask_size, 0.0::DOUBLE AS open_interest, CASE WHEN event_id % 3 > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS delta, 0.0::DOUBLE AS gamma,
        CASE WHEN event_id % 3 > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS iv FROM events WHERE user_id % 2 = 0""",
    "a3_stream_consumer": "SELECT user_id AS token, event_id AS seq, value AS last_price FROM events WHERE event_id % 4 > 0 AND event_id % 5 > 0 AND event_id % 6 > 0 AND user_id <> 0",
    "a16_ring_pop": f"{TK} SELECT token, seq FROM ticks QUALIFY row_number() OVER (PARTITION BY token ORDER BY ts_ns, seq) <= 5",
    "b3_overflow": f"{TK} SELECT token, greatest(0, count(*) - 60)::BIGINT AS dropped FROM ticks GROUP BY token",
    "i3_derivatives_load": f"""{_LOAD('1', 'p_partkey::VARCHAR')} SELECT k AS symbol, DATE '2024-01-25' AS expiry, 100.0::DOUBLE AS strike, p AS open, p AS close, fp AS settle_price,
        size::BIGINT AS volume, 0::BIGINT AS open_interest FROM j""",
    "i4_index_load": f"{_LOAD('1', 'p_partkey')} SELECT DATE '2024-01-25' AS date, 'IX' || k AS index_name, p AS open, p AS close, size::BIGINT AS volume, 0.0::DOUBLE AS pe_ratio FROM j",
    "i6_stock_master": f"{_LOAD('1', 'p_partkey::VARCHAR')} SELECT k AS symbol, 'X' AS isin, brand || CASE WHEN np IS NULL THEN ' 0' ELSE ' 1' END AS name, 'EQ' AS series, p AS face_value FROM j",
    "i10_margin": f"{_LOAD('1', 'p_partkey::VARCHAR')} SELECT DATE '2024-01-25' AS date, k AS symbol, fp AS var_margin, fp AS extreme_loss_margin, 0.0::DOUBLE AS applicable_margin FROM j",
    "i8_cash_activity": """SELECT o_orderdate::DATE AS date, CASE WHEN o_custkey % 2 = 0 THEN 'FII' ELSE 'DII' END AS category, o_orderkey::DOUBLE AS buy_value, o_custkey::DOUBLE AS sell_value,
        0.0::DOUBLE AS net_value FROM orders WHERE o_custkey % 2 = 0 OR o_custkey % 3 = 0""",
    "i15_sliding_window": f"""WITH RECURSIVE {A.TICKS}, {_SENT}, sw AS (SELECT source, seq, n, ts_ns AS sent_ns, [ts_ns] AS l FROM rq WHERE n = 1
        UNION ALL SELECT source, seq, n, w, (l || [w])[-3:] FROM (SELECT r.source, r.seq, r.n, s.l, greatest(r.ts_ns, s.sent_ns + {DAY}, CASE WHEN len(s.l) >= 3 THEN s.l[-3] + 20 * {DAY} ELSE 0 END) AS w
            FROM sw s JOIN rq r ON r.source = s.source AND r.n = s.n + 1)) SELECT source, seq, sent_ns FROM sw""",
    "i15_token_bucket": f"""WITH RECURSIVE {A.TICKS}, {_SENT}, tb AS (SELECT source, seq, n, ts_ns AS sent, 1.0::DOUBLE AS tokens FROM rq WHERE n = 1
        UNION ALL SELECT source, seq, n, came + w, least(2.0::DOUBLE, t + w / 172800e9::DOUBLE) - 1 FROM (SELECT *, CASE WHEN t < 1 THEN ceil((1 - t) * 172800e9::DOUBLE)::BIGINT ELSE 0 END AS w
            FROM (SELECT r.source, r.seq, r.n, greatest(r.ts_ns, b.sent) AS came, least(2.0::DOUBLE, b.tokens + (greatest(r.ts_ns, b.sent) - b.sent) / 172800e9::DOUBLE) AS t FROM tb b JOIN rq r ON r.source = b.source AND r.n = b.n + 1)))
        SELECT source, seq, {R('sent / 1e9::DOUBLE', 3)} AS sent_s, {R('tokens', 5)} AS tokens FROM tb""",
    "i15_backoff": "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 65.0::DOUBLE WHEN 0 THEN NULL ELSE 2.0::DOUBLE * 2.0::DOUBLE ^ (event_id % 5) END AS seconds FROM events",
    "a2_token_lookup": "SELECT n_name AS instrument_key, CASE WHEN n_regionkey < 3 THEN n_nationkey + 100 ELSE n_nationkey + 1 END::BIGINT AS token FROM nation",
    "a4_depth_mapping": "SELECT event_id, 5 AS levels, event_id * least(5, event_id % 8) AS quantity FROM events",
    "a5_candle_json": """SELECT event_type AS symbol, (epoch_us(date_trunc('second', ts)) - 19800000000) * 1000 AS ts_ns, 1.5::DOUBLE AS open, 2.5::DOUBLE AS high, 0.5::DOUBLE AS low,
        event_id::DOUBLE AS close, user_id::BIGINT AS volume, 0::BIGINT AS open_interest FROM events WHERE event_id % 10 <> 0""",
    "a6_candle_times": f"""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0 ELSE epoch_us(date_trunc('second', ts)) * 1000 END AS ts_ns,
        CASE WHEN event_id % 10 = 0 THEN {T0} ELSE epoch_us(date_trunc('second', ts)) * 1000 END AS written_ns FROM events""",
    "a9_binary_scan": f"{TK} SELECT token, ts_ns, last_quantity AS volume, " + ", ".join(f"{R(f'{c}::FLOAT::DOUBLE', 2)} AS {c}" for c in ("last_price", "bid_price", "ask_price")) + " FROM ticks",
    "a15_equity_csv": """SELECT DATE '2024-01-25' AS date, 'S' || p_partkey AS symbol, 'EQ' AS series, round(p_retailprice, 2)::DOUBLE AS open, round(p_retailprice, 2)::DOUBLE AS close,
        p_size::BIGINT AS volume FROM part WHERE p_partkey % 10 <> 0""",
    "a15_derivatives_csv": """SELECT p_partkey::VARCHAR AS symbol, DATE '2024-01-01' + p_size::INT AS expiry, round(p_retailprice, 2)::DOUBLE AS strike, 'CE' AS option_type, 1.5::DOUBLE AS close,
        (p_partkey * 1000)::BIGINT AS open_interest FROM part WHERE p_partkey % 7 <> 0""",
    "i5_deals": """SELECT DATE '2024-01-25' AS date, CASE WHEN o_orderpriority < '3' THEN 'bulk' ELSE 'block' END AS kind, 'S' || (o_custkey % 50) AS symbol, o_custkey::VARCHAR AS client_name,
        CASE WHEN o_orderkey % 2 = 0 THEN 'SELL' ELSE 'BUY' END AS deal_type, o_orderkey::BIGINT AS quantity, round(o_totalprice, 2)::DOUBLE AS price, 'NSE' AS exchange
        FROM orders WHERE (o_orderpriority < '3' OR o_orderpriority > '4') AND o_orderkey % 7 <> 0""",
    "j5_equity_return": f"""{TK} SELECT token, {R('CASE WHEN arg_min(last_price, seq) <> 0 THEN (arg_max(last_price, seq) - arg_min(last_price, seq)) * 100.0::DOUBLE / arg_min(last_price, seq) ELSE 0.0::DOUBLE END', 3)}
        AS return_pct FROM ticks GROUP BY token""",
    "j10_range_scan": f"{TK} SELECT token, seq, ts_ns FROM ticks WHERE token IN (3, 5, 7) AND ts_ns BETWEEN {T0} AND {T0 + 10 * DAY}",
    "j12_update_where": """SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'DONE' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
    "j14_flat_positions": f"{TK} SELECT token, (sum(last_quantity) OVER (PARTITION BY token))::BIGINT AS units, seq, last_price FROM ticks QUALIFY seq % 3 = 0",
    "j14_injected_ticks": f"""{TK}, l AS (SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY token ORDER BY ts_ns DESC, seq DESC) = 1)
        SELECT token, seq + i AS seq, ts_ns + i * 1000000000 AS ts_ns, last_price FROM l, range(1, 26) t(i)""",
    "a7_iso_times": """SELECT event_id, epoch_us(date_trunc('second', ts)) * 1000 AS utc_ns, (epoch_us(date_trunc('second', ts)) - 19800000000) * 1000 AS local_ns FROM events""",
    "a8_request_chunks": f"WITH {_CHUNKS} SELECT symbol, chunk_first, chunk_last FROM ch",
    "a10_tick_scan": f"{TK} SELECT token, seq, ts_ns FROM ticks WHERE token = 7 AND ts_ns BETWEEN {T0} AND {T0 + 10 * DAY}",
    "a11_first_signal": f"""{TK} SELECT token, seq, first_value(last_price) OVER (PARTITION BY token, ts_ns // {A.SIX_HOURS} ORDER BY ts_ns, seq) AS first_price FROM ticks""",
    "a12_candle_scan": f"WITH {A.DAY_CANDLES} SELECT symbol, ts_ns, {R('(high + low + close) / 3', 3)} AS vwap FROM candles WHERE symbol = '2-HIGH' AND ts_ns BETWEEN {CANDLES_FROM} AND {CANDLES_TO}",
    "a13_universe": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders) ORDER BY o_orderkey LIMIT 20",
    "a14_instrument_json": """SELECT DATE '2024-01-25' AS date, 'K|' || p_partkey AS instrument_key, p_name AS trading_symbol, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 1 END::INT AS lot_size,
        0.05::DOUBLE AS tick_size, p_partkey::BIGINT AS expiry_ms, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice::DOUBLE ELSE 0.0::DOUBLE END AS strike_price FROM part WHERE p_partkey % 9 > 0""",
    "a17_time_range": f"{TK} SELECT token, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM ticks GROUP BY token",
    "b2_latest_snapshot": f"{TK} SELECT token, max(seq) AS seq, arg_max(last_price, seq) AS last_price FROM ticks GROUP BY token",
    "b3_drop_oldest": f"{TK} SELECT token, seq FROM ticks QUALIFY row_number() OVER (PARTITION BY token ORDER BY ts_ns DESC, seq DESC) <= 5",
    "c14_session_reset": f"""{TK}, x AS (SELECT *, CASE WHEN last_price >= lag(ask_price) OVER w THEN 1 WHEN last_price <= lag(bid_price) OVER w THEN -1 ELSE 0 END AS dr
        FROM ticks WINDOW w AS (PARTITION BY token ORDER BY ts_ns, seq)) SELECT token, seq, (sum(dr) OVER (PARTITION BY token, ts_ns // {DAY} ORDER BY ts_ns, seq))::BIGINT AS cum_direction FROM x""",
    "i1_insert_ignore": f"{_UP} SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)",
    "i2_upsert": f"""{_UP} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal,
        coalesce(o.c_mktsegment, n.c_mktsegment) AS c_mktsegment FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""",
    "i3_dates": "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders",
    "i4_numbers": f"SELECT o_orderkey, {R('round(o_totalprice::DECIMAL(18,2), 2)::DOUBLE', 2)} AS price FROM orders",
    "i6_partial_update": f"{_UP} SELECT o.c_custkey, o.c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, o.c_mktsegment FROM o LEFT JOIN n ON o.c_custkey = n.c_custkey",
    "i7_corporate_actions": """SELECT p_partkey AS symbol, '2024-01-25' AS ex_date, 'DIVIDEND' AS action, (p_size - 25)::DOUBLE AS value FROM part WHERE p_size > 25
        UNION ALL SELECT p_partkey, '2024-01-25', 'SPLIT', (p_partkey % 3)::DOUBLE FROM part WHERE p_partkey % 3 > 0""",
    "i8_activity": "SELECT o_orderdate::DATE AS date, " + ", ".join(
        f"arg_max({v}, o_orderkey) FILTER (o_orderkey % 4 = {k})::BIGINT AS {c}"
        for k, (_, *columns) in enumerate(I.DERIVATIVE_MEASURES) for v, c in zip(("o_custkey", "CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 100 ELSE 0 END"), columns, strict=True)
    ) + " FROM orders WHERE o_orderkey % 4 < 3 GROUP BY 1",
    "i9_constituents": """WITH t AS (SELECT DISTINCT o_orderpriority AS grp, o_custkey AS member FROM orders WHERE o_custkey % 2 = 0),
        n AS (SELECT DISTINCT o_orderpriority AS grp, o_custkey AS member FROM orders WHERE o_custkey % 3 = 0 AND o_orderpriority < '3')
        SELECT coalesce(t.grp, n.grp) AS grp, coalesce(t.member, n.member) AS member, n.grp IS NOT NULL OR t.grp >= '3' AS is_active,
        CASE WHEN n.grp IS NOT NULL THEN 2 ELSE 1 END AS weight FROM t FULL JOIN n ON t.grp = n.grp AND t.member = n.member""",
    "i11_holidays": "SELECT DATE '2024-01-01' + n_nationkey::INT AS date, 'CM' AS segment, n_name AS description FROM nation",
    "i13_gap_planner": f"""WITH {_CHUNKS}, dd AS (SELECT symbol, chunk_first, chunk_last, {_WK} AS date FROM ch),
        od AS (SELECT * FROM dd WHERE isodow(date) < 6 AND NOT (month(date) = 1 AND day(date) = 1 AND year(date) BETWEEN 1992 AND 1998)),
        pr AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS date, count(*) AS bars FROM orders WHERE day(o_orderdate::DATE) % 9 <> 0 GROUP BY 1, 2),
        g AS (SELECT symbol, chunk_first, chunk_last, count(DISTINCT date) AS days, coalesce(sum(bars), 0)::BIGINT AS bars FROM od LEFT JOIN pr USING (symbol, date) GROUP BY 1, 2, 3)
        SELECT *, greatest(1, floor(0.9::DOUBLE * days)::BIGINT) AS needed FROM g WHERE bars < greatest(1, floor(0.9::DOUBLE * days)::BIGINT)""",
    "i14_learned_holidays": f"""WITH {_CHUNKS}, ob AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE day(o_orderdate::DATE) % 9 <> 0)
        SELECT DISTINCT date FROM (SELECT {_WK} AS date FROM ch WHERE EXISTS (SELECT 1 FROM ob WHERE date BETWEEN chunk_first AND chunk_last))
        WHERE isodow(date) < 6 AND date NOT IN (SELECT date FROM ob)""",
    "i15_throttle": f"""{TK}, x AS (SELECT token AS source, seq, count(*) OVER (PARTITION BY token ORDER BY ts_ns RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS sent FROM ticks)
        SELECT source, seq, sent, sent > 3 AS waits FROM x""",
    "j1_latest_by_token": f"""{TK}, n AS (SELECT * FROM ticks ORDER BY ts_ns DESC, seq DESC LIMIT 300) SELECT token, seq, last_price FROM n
        QUALIFY row_number() OVER (PARTITION BY token ORDER BY ts_ns DESC, seq DESC) = 1""",
    "j2_newest": f"{TK} SELECT token, seq FROM ticks ORDER BY ts_ns DESC, seq DESC LIMIT 50",
    "j3_price_moves": f"""{TK}, x AS (SELECT *, last_price - lag(last_price) OVER (PARTITION BY token ORDER BY ts_ns, seq) AS ch FROM ticks WHERE bid_price > 0)
        SELECT token, seq, CASE WHEN ch > 0.001::DOUBLE THEN 1 WHEN ch < -0.001::DOUBLE THEN -1 ELSE 0 END AS move, {R('(ask_price - bid_price) / bid_price * 10000', 4)} AS spread_bps FROM x""",
    "j4_stream_depth": "SELECT count(*) AS n, least(1.0::DOUBLE, count(*) / 50000.0::DOUBLE) AS share FROM events",
    "j6_tail": f"{TK} SELECT token, seq FROM ticks WHERE seq > 900",
    "j7_latest_date": "SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)",
    "j8_distinct_times": "SELECT DISTINCT o_orderdate::DATE AS day FROM orders",
    "j9_count_between": f"{TK} SELECT count(*) AS n FROM ticks WHERE ts_ns >= {T0} AND ts_ns < {T0 + 7 * DAY}",
    "j11_day_bounds": """SELECT DISTINCT o_orderdate::DATE AS day, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 86400000000000 AS start_ns,
        (date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT + 1) * 86400000000000 AS end_ns FROM orders""",
    "j13_results": """SELECT user_id AS instrument_token, event_type AS symbol, event_id % 9 AS total_trades, value AS total_net_pnl, 0.0::DOUBLE AS sharpe_ratio, 0::BIGINT AS winning_trades
        FROM events WHERE event_id % 5 > 0""",
    "j13_statuses": f"""SELECT user_id AS instrument_token, CASE event_id % 6 WHEN 0 THEN 'BACKTEST_IDLE' WHEN 1 THEN 'BACKTEST_LOADING' WHEN 2 THEN 'BACKTEST_RUNNING' WHEN 3 THEN 'BACKTEST_DONE' WHEN 4 THEN 'BACKTEST_ERROR' ELSE 'UNKNOWN' END AS state_name,
        event_id AS ticks_processed, {R('CASE WHEN event_id % 7 > 0 THEN least(100.0::DOUBLE, event_id * 100.0::DOUBLE / 8000) ELSE 0.0::DOUBLE END', 3)} AS progress_pct FROM events WHERE event_id % 5 > 0""",
    "i12_jobs": f"{_LOAD('1', 'p_partkey')} SELECT 'IX' || k AS index_name, p AS close FROM j",
    "j13_progress": f"{TK} SELECT token, {R('least(100.0::DOUBLE, count(*) * 100.0::DOUBLE / 80)', 3)} AS pct FROM ticks GROUP BY token",
}
