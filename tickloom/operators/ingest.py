"""End-of-day ingest: parsing rows of files, and how they are merged into tables, without row loops.

A table is a DataFrame; each merge returns its next state, to be written to a new Parquet path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bars of a full day, and days per request, by interval.
BARS_PER_DAY = {"1m": 375, "5m": 75, "15m": 25, "30m": 13, "60m": 7, "1h": 7, "day": 1, "week": 1, "month": 1}
DAYS_PER_REQUEST = {"1m": 4, "5m": 24, "15m": 75, "30m": 150, "60m": 300, "1h": 300}
ENOUGH = 0.9


def pick(df: DataFrame, *names: str) -> Column:
    """The first of the alternative headers that a file has, trimmed; null if it has none."""
    found = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def number(text: Column, kind: str = "double") -> Column:
    """A number from text with thousands separators; null where it isn't one."""
    return F.regexp_replace(text, ",", "").try_cast(kind)


def a_date(text: Column) -> Column:
    """A date in ISO form or as 25-Jan-2024."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(F.initcap(F.lower(text)), "dd-MMM-yyyy"))


def parsed(raw: DataFrame, fixed: dict[str, Column], fields: dict[str, tuple], needed: list[str]) -> DataFrame:
    """Rows of a file by ``fields``: name -> (type, default, headers). A header that the file lacks gives the default; a cell that
    can't be read as its type drops the row, as does an empty cell of ``needed``. Other empty cells take the default, and a dash
    stands for an unknown value: null."""
    out, keep = dict(fixed), F.lit(True)
    for name, (kind, default, *headers) in fields.items():
        have = [h for h in headers if h in raw.columns]
        if kind == "string":
            cell = F.coalesce(pick(raw, *headers), F.lit(default)) if default is not None else pick(raw, *headers)
        elif not have:
            cell = F.lit(default).cast(kind)
        else:
            cell = a_date(pick(raw, *headers)) if kind == "date" else number(pick(raw, *headers), kind)
            if default is not None and name not in needed:
                cell = F.when(pick(raw, *headers).isNull(), F.lit(default).cast(kind)).otherwise(cell)
            keep &= cell.isNotNull() | F.coalesce(pick(raw, *headers) == "-", F.lit(False))
        if name in needed:
            keep &= cell.isNotNull() & (cell.cast("string") != "")
        out[name] = cell
    return raw.where(keep).select(*[c.alias(n) for n, c in out.items()])


def equity_rows(raw: DataFrame, day: Column) -> DataFrame:
    """Equity rows from a CSV with either header style; rows without symbol or close are dropped."""
    price = lambda *h: ("double", 0.0, *h)
    count = lambda *h: ("bigint", 0, *h)
    return parsed(raw, {"date": day}, {
        "symbol": ("string", None, "SYMBOL", "Symbol", "TckrSymb"), "isin": ("string", "", "ISIN"), "series": ("string", "", "SERIES", "SctySrs"),
        "open": price("OPEN", "OPEN_PRICE", "OpnPric"), "high": price("HIGH", "HIGH_PRICE", "HghPric"), "low": price("LOW", "LOW_PRICE", "LwPric"),
        "close": ("double", None, "CLOSE", "CLOSE_PRICE", "ClsPric"), "prev_close": price("PREVCLOSE", "PREV_CLOSE", "PrvsClsgPric"),
        "volume": count("TOTTRDQTY", "TTL_TRD_QNTY", "TtlTradgVol"), "turnover": price("TOTTRDVAL", "TURNOVER_LACS", "TtlTrfVal"),
        "trades": count("TOTALTRADES", "NO_OF_TRADES", "TtlNbOfTxsExctd"), "delivery_volume": count("DELIV_QTY"), "delivery_percentage": price("DELIV_PER"),
    }, ["symbol", "close"])


def derivative_rows(raw: DataFrame, day: Column) -> DataFrame:
    """Futures and options rows, with expiries in either date form."""
    price = lambda *h: ("double", 0.0, *h)
    count = lambda *h: ("bigint", 0, *h)
    return parsed(raw, {"date": day}, {
        "symbol": ("string", None, "SYMBOL", "Symbol", "TckrSymb"), "expiry": ("date", None, "EXPIRY_DT", "Expiry_Dt", "XpryDt"),
        "instrument_type": ("string", "", "INSTRUMENT", "FinInstrmTp"), "strike": price("STRIKE_PR", "StrkPric"), "option_type": ("string", "", "OPTION_TYP", "OptnTp"),
        "open": price("OPEN", "OpnPric"), "high": price("HIGH", "HghPric"), "low": price("LOW", "LwPric"), "close": price("CLOSE", "ClsPric"),
        "settle_price": price("SETTLE_PR", "SttlmPric"), "volume": count("CONTRACTS", "TtlTradgVol"), "turnover": price("VAL_INLAKH", "TtlTrfVal"),
        "open_interest": count("OPEN_INT", "OpnIntrst"), "change_in_oi": count("CHG_IN_OI", "ChngInOpnIntrst"),
    }, ["symbol", "expiry"])


def index_rows(raw: DataFrame, day: Column) -> DataFrame:
    """Index rows; rows without a name are dropped."""
    price = lambda *h: ("double", 0.0, *h)
    return parsed(raw, {"date": day}, {
        "index_name": ("string", None, "Index Name", "index_name"), "open": price("Open"), "high": price("High"), "low": price("Low"), "close": price("Close"),
        "volume": ("bigint", 0, "Volume"), "turnover": price("Turnover"), "pe_ratio": price("P/E"), "pb_ratio": price("P/B"), "div_yield": price("Div Yield"),
    }, ["index_name"])


def deal_rows(raw: DataFrame, day: Column, kind: str) -> DataFrame:
    """Bulk or block deals."""
    return parsed(raw, {"date": day, "kind": F.lit(kind)}, {
        "symbol": ("string", None, "Symbol", "SYMBOL"), "client_name": ("string", "", "Client Name", "CLIENT_NAME"), "deal_type": ("string", "BUY", "Buy/Sell", "DEAL_TYPE"),
        "quantity": ("bigint", 0, "Quantity", "QUANTITY"), "price": ("double", 0.0, "Trade Price", "PRICE"), "exchange": ("string", "NSE", "Exchange"),
    }, ["symbol"])


def margin_rows(raw: DataFrame, day: Column) -> DataFrame:
    """Daily margins of a symbol."""
    price = lambda *h: ("double", 0.0, *h)
    return parsed(raw, {"date": day}, {
        "symbol": ("string", None, "Symbol", "SYMBOL"), "var_margin": price("VAR Margin", "VAR"), "extreme_loss_margin": price("Extreme Loss Margin", "ELM"),
        "applicable_margin": price("Applicable Margin", "MTM"),
    }, ["symbol"])


def stock_rows(raw: DataFrame) -> DataFrame:
    """Rows of the stock master."""
    return parsed(raw, {}, {
        "symbol": ("string", None, "SYMBOL", "Symbol"), "isin": ("string", "", "ISIN", "ISIN NUMBER"), "name": ("string", "", "NAME OF COMPANY", "Security Name"),
        "series": ("string", "", "SERIES"), "face_value": ("double", 0.0, "FACE VALUE"),
    }, ["symbol"])


#: What a load of each table is keyed by, and what it updates in rows that are there (None: nothing, they stay).
LOADS = {
    "equity": (["date", "symbol"], ["open", "high", "low", "close", "volume", "delivery_volume"]),
    "derivatives": (["date", "symbol", "expiry", "strike", "option_type"], ["open", "high", "low", "close", "open_interest", "change_in_oi"]),
    "index": (["date", "index_name"], ["open", "high", "low", "close"]),
    "margin": (["date", "symbol"], None),
    "stock_master": (["symbol"], ["isin", "name", "series", "face_value"]),
}


def load(table: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The next state of one of LOADS' tables; of rows with one key in a file the last in order of its cells counts."""
    keys, updated = LOADS[name]
    once = last_of_key(rows, keys)
    return insert_ignore(table, once, keys) if updated is None else upsert(table, once, keys, updated)


def instrument_load(table: DataFrame, raw: DataFrame, day: Column) -> DataFrame:
    from tickloom.sources.readers import instrument_rows

    return insert_ignore(table, instrument_rows(raw, day), ["date", "instrument_key"])


def constituent_rows(raw: DataFrame) -> DataFrame:
    """Members of an index from a file of one of its lists."""
    return parsed(raw, {}, {
        "index_name": ("string", None, "Index", "index_name"), "symbol": ("string", None, "Symbol", "SYMBOL"), "isin": ("string", "", "ISIN Code", "ISIN"),
        "industry": ("string", "", "Industry"),
    }, ["index_name", "symbol"])


def of_file(read, name: str):
    return lambda table, raw, day: load(table, read(raw, day), name)


#: The end-of-day jobs by name: the next state of a job's table from its raw file of a day. ``schedule.SCHEDULES`` says when they are due.
JOBS = {
    "instrument_loader": instrument_load,
    "equity_bhavcopy": of_file(equity_rows, "equity"),
    "fno_bhavcopy": of_file(derivative_rows, "derivatives"),
    "index_bhavcopy": of_file(index_rows, "index"),
    "stock_master": of_file(lambda raw, _: stock_rows(raw), "stock_master"),
    "deals_worker": lambda table, raw, day: append(table, deal_rows(raw, day, "bulk")),
    "yahoo_finance": lambda table, raw, _: insert_ignore(table, actions(raw), ["symbol", "ex_date", "action"]),
    "fii_activity": lambda table, raw, _: upsert(table, last_of_key(cash_activity(raw), ["date", "category"]), ["date", "category"]),
    "index_constituents": lambda table, raw, _: replace_members(table, constituent_rows(raw), ["index_name", "symbol"], ["index_name"]),
    "margin_data": of_file(margin_rows, "margin"),
    "holiday_calendar": lambda table, raw, _: upsert(table, last_of_key(holidays(raw), ["date", "segment"]), ["date", "segment"]),
}


def run_job(name: str, table: DataFrame, raw: DataFrame, day: Column) -> DataFrame:
    """The next state of a job's table after its file of a day; a KeyError for an unknown name."""
    return JOBS[name](table, raw, day)


def last_of_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, the greatest by its other cells, so that the choice does not hang on the order of reading."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def unused(table: DataFrame, name: str) -> str:
    """The name, or, where the table has it, a longer one that it hasn't."""
    while name in table.columns:
        name = f"_{name}"
    return name


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], updated: list[str] | None = None) -> DataFrame:
    """New keys are added; known ones take the ``updated`` columns (all by default) of the new row."""
    change = set(updated if updated is not None else [c for c in table.columns if c not in keys])
    is_old, is_new = unused(table, "is_old"), unused(table, "is_new")
    old = table.withColumn(is_old, F.lit(True)).alias("o")
    new = rows.select(*table.columns).withColumn(is_new, F.lit(True)).alias("n")
    joined = old.join(new, keys, "full")
    have = lambda c: F.coalesce(F.col(c), F.lit(False))
    value = lambda c: (
        F.when(have(is_new) & (~have(is_old) | F.lit(c in change)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    )
    return joined.select(*[F.col(c) if c in keys else value(c) for c in table.columns])


def append(table: DataFrame, *parts: DataFrame) -> DataFrame:
    """All rows of all parts after those of the table, by name; columns that a part lacks are null."""
    for part in parts:
        table = table.unionByName(part.select([c for c in part.columns if c in table.columns]), allowMissingColumns=True)
    return table


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of unknown keys are added; known keys keep their row."""
    fresh = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def replace_members(table: DataFrame, rows: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """Members of the scopes in ``rows`` that aren't in them become inactive; those in them are upserted as active."""
    hit = unused(table, "is_hit")
    touched = rows.select(*scope).distinct().withColumn(hit, F.lit(True))
    off = table.join(touched, scope, "left").withColumn("is_active", F.col("is_active") & F.col(hit).isNull()).select(*table.columns)
    return upsert(off, rows.withColumn("is_active", F.lit(True)), keys)


def partial_update(table: DataFrame, rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Known keys take the non-null values of ``columns``; unknown keys are not added."""
    new = rows.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return table.join(new, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def actions(wide: DataFrame) -> DataFrame:
    """symbol, ex_date, action, value: dividends and splits over zero from a wide table."""
    long = wide.unpivot(["symbol", "ex_date"], ["dividend", "split"], "action", "value").where("value > 0")
    return long.withColumn("action", F.upper("action"))


def cash_activity(lines: DataFrame) -> DataFrame:
    """date, category, buy_value, sell_value, net_value from labelled lines as text; lines without a category are dropped."""
    value = lambda c: F.coalesce(number(F.col(c)), F.lit(0.0))
    return lines.where(F.coalesce(F.col("category"), F.lit("")) != "").select(
        "date", "category", value("buyValue").alias("buy_value"), value("sellValue").alias("sell_value"), value("netValue").alias("net_value")
    )


#: Measures of derivative activity: what a line's label has to hold, and the columns that its buy and sell go to.
DERIVATIVE_MEASURES = (
    ("index_futures", "index_futures_long", "index_futures_short"),
    ("stock_futures", "stock_futures_long", "stock_futures_short"),
    ("index_options", "index_options_call_long", "index_options_put_long"),
)


def derivative_activity(lines: DataFrame) -> DataFrame:
    """date with the six DERIVATIVE_MEASURES from lines (date, at, label, buy, sell): labels are read in lower case with underscores,
    the first that fits counts, and of lines with one measure the last (by ``at``)."""
    label = F.replace(F.lower(F.coalesce("label", F.lit(""))), F.lit(" "), F.lit("_"))
    which = F.lit(None).cast("string")
    for name, _, _ in reversed(DERIVATIVE_MEASURES):
        which = F.when(label.contains(name), name).otherwise(which)
    cell = lambda c: F.coalesce(number(F.col(c), "bigint"), F.lit(0)).alias(c)
    marked = lines.select("date", "at", which.alias("which"), F.struct(cell("buy"), cell("sell")).alias("v")).where("which IS NOT NULL")
    last = lambda name: F.max_by("v", F.when(F.col("which") == name, F.col("at")))
    found = marked.groupBy("date").agg(*[F.when(F.max(F.col("which") == name), last(name)).alias(name) for name, _, _ in DERIVATIVE_MEASURES])
    return found.select("date", *[F.col(f"{name}.{c}").alias(column) for name, *columns in DERIVATIVE_MEASURES for c, column in zip(("buy", "sell"), columns, strict=True)])


def holidays(raw: DataFrame) -> DataFrame:
    """date, segment, description from JSON of the form {segment: [{tradingDate, description}]}."""
    kind = "map<string,array<struct<tradingDate:string,description:string>>>"
    return (
        raw.select(F.explode(F.from_json("json", kind)).alias("segment", "days")).select("segment", F.inline("days"))
        .select(a_date(F.col("tradingDate")).alias("date"), "segment", "description").where("date IS NOT NULL")
    )


def weekdays(first: Column, last: Column) -> Column:
    """The weekdays from first to last, both included."""
    return F.filter(F.sequence(first, last), lambda d: F.weekday(d) < 5)


def chunks(ranges: DataFrame, interval: str) -> DataFrame:
    """Ranges (symbol, first, last) cut into request-sized chunks with both ends included."""
    days = DAYS_PER_REQUEST.get(interval, 0)
    if not days:
        return ranges.select("symbol", F.col("first").alias("chunk_first"), F.col("last").alias("chunk_last"))
    starts = F.explode(F.sequence("first", "last", F.expr(f"interval {days} days")))
    return ranges.select("symbol", "last", starts.alias("chunk_first")).select(
        "symbol", "chunk_first", F.least("last", F.date_add("chunk_first", days - 1)).alias("chunk_last")
    )


def gaps(parts: DataFrame, holiday: DataFrame, present: DataFrame, interval: str) -> DataFrame:
    """Chunks that lack data: fewer bars present (symbol, date, bars) than nine tenths of those of their trading days."""
    days = parts.withColumn("date", F.explode(weekdays(F.col("chunk_first"), F.col("chunk_last"))))
    open_days = days.join(holiday.select("date").distinct(), "date", "left_anti")
    full = BARS_PER_DAY.get(interval, 375)
    have = open_days.join(present, ["symbol", "date"], "left").groupBy("symbol", "chunk_first", "chunk_last").agg(
        F.count_distinct("date").alias("days"), F.coalesce(F.sum("bars"), F.lit(0)).alias("bars")
    )
    need = F.greatest(F.lit(1), F.floor(F.lit(full * ENOUGH) * F.col("days")).cast("long"))
    return have.withColumn("needed", need).where("bars < needed")


def learned_holidays(parts: DataFrame, observed: DataFrame) -> DataFrame:
    """Weekdays of a chunk that a non-empty answer (symbol, date) left out; an empty answer teaches nothing."""
    # A chunk is some days long, so its days meet the answers by equality.
    days = parts.withColumn("date", F.explode(F.sequence("chunk_first", "chunk_last")))
    answered = days.join(observed.distinct(), ["symbol", "date"], "left_semi").select("symbol", "chunk_first", "chunk_last").distinct()
    expected = answered.withColumn("date", F.explode(weekdays(F.col("chunk_first"), F.col("chunk_last"))))
    return expected.join(observed, ["symbol", "date"], "left_anti").select("date").distinct()


def throttled(requests: DataFrame, most: int, window_ns: int) -> DataFrame:
    """Requests with the number sent in the window up to each, and whether it would have had to wait."""
    w = W.partitionBy("source").orderBy("ts_ns").rangeBetween(-window_ns + 1, 0)
    return requests.withColumn("sent", F.count(F.lit(1)).over(w)).withColumn("waits", F.col("sent") > most)


class SlidingWindow:
    """When each request of a source may go: ``gap_ns`` after the one before, and with at most ``most`` in any ``window_ns``."""

    outputs = "sent_ns long"
    state, lists = "", {"sent": "x long"}

    def __init__(self, most: int, window_ns: int = 60_000_000_000, gap_ns: int = 0):
        self.most, self.window, self.gap = most, window_ns, gap_ns

    def init(self):
        return {"sent": []}

    def step(self, s, row):
        sent = s["sent"]
        at = row["ts_ns"]
        if sent:
            at = max(at, sent[-1] + self.gap)
        if len(sent) >= self.most:
            at = max(at, sent[-self.most] + self.window)
        s["sent"] = [*sent[1 - self.most :], at] if self.most > 1 else [at]
        return {"sent_ns": at}


class TokenBucket:
    """When each request of a source may go, with tokens that fill at a rate up to a burst; each takes one."""

    outputs = "sent_ns long, tokens double"
    state, lists = "tokens double, last long", {}

    def __init__(self, rate_per_second: float, burst: float):
        self.rate, self.burst = rate_per_second / 1e9, burst

    def init(self):
        return {"tokens": self.burst, "last": None}

    def step(self, s, row):
        at = row["ts_ns"] if s["last"] is None else max(row["ts_ns"], s["last"])
        tokens = s["tokens"] if s["last"] is None else min(self.burst, s["tokens"] + (at - s["last"]) * self.rate)
        if tokens < 1:
            wait = math.ceil((1 - tokens) / self.rate)
            at, tokens = at + wait, min(self.burst, tokens + wait * self.rate)
        s["tokens"], s["last"] = tokens - 1, at
        return {"sent_ns": at, "tokens": s["tokens"]}


def backoff_seconds(status: Column, attempt: Column) -> Column:
    """Seconds to wait before the next attempt (from 1): a fixed rest after 429, doubling ones after server errors, null for none."""
    return F.when(status == 429, 65.0).when(status >= 500, 2.0 * F.pow(F.lit(2.0), attempt - 1))
