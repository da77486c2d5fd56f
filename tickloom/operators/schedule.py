"""When end-of-day jobs are due: cron fields matched against a calendar of days, hours and minutes, by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "Asia/Kolkata"
#: The jobs' times (minute, hour, day of month, month, day of week, in India); none for a job that runs when asked.
SCHEDULES = {
    "instrument_loader": "0 6 * * *", "equity_bhavcopy": "30 19 * * *", "fno_bhavcopy": "45 19 * * *", "index_bhavcopy": "0 20 * * *",
    "stock_master": "0 9 * * 0", "deals_worker": "0 19 * * *", "yahoo_finance": None, "fii_activity": "15 20 * * *",
    "index_constituents": "0 10 * * 0", "margin_data": "0 21 * * *", "holiday_calendar": "0 0 1 * *",
}
LIMITS = (("minute", 0, 59), ("hour", 0, 23), ("dom", 1, 31), ("month", 1, 12), ("dow", 0, 7))


def values(field: Column, low: int, high: int) -> Column:
    """The numbers that a cron field stands for: lists of numbers, ranges and steps; null if it is none."""

    def part(text: Column) -> Column:
        span, step = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
        first, last = F.split_part(span, F.lit("-"), F.lit(1)), F.split_part(span, F.lit("-"), F.lit(2))
        number = lambda c: c.try_cast("int")
        # A number with a step runs to the end of the field.
        a = F.when(span == "*", low).otherwise(number(first))
        b = F.when(span == "*", high).when(last != "", number(last)).when(step != "", high).otherwise(number(first))
        by = F.when(step == "", 1).otherwise(number(step))
        good = text.rlike(r"^(\*|[0-9]+(-[0-9]+)?)(/[0-9]+)?$") & (a >= low) & (b <= high) & (a <= b) & (by > 0)
        return F.when(good, F.sequence(a, b, F.when(by > 0, by).otherwise(1)))

    parts = F.transform(F.split(field, ","), part)
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_distinct(F.flatten(parts)))


def due(jobs: DataFrame, zone: str = ZONE) -> DataFrame:
    """job, due (UTC timestamp): when each job (job, schedule, last_run and now as UTC timestamps) should have run after its last run, up to now.

    A day counts if it fits the day of the month or, where both are restricted, the day of the week (0 and 7 are Sunday). Local times that
    the zone skips are due when the clock has moved on. Jobs without a schedule, or with one that can't be read, are never due.
    """
    fields = F.split(F.trim("schedule"), r"\s+")
    cells = {n: F.get(fields, F.lit(i)) for i, (n, _, _) in enumerate(LIMITS)}
    read = jobs.where(F.size(fields) == 5).select(
        "job", "last_run", "now", *[values(cells[n], low, high).alias(n) for n, low, high in LIMITS],
        *[(~cells[n].startswith("*")).alias(f"{n}_set") for n in ("dom", "dow")],
    ).dropna(subset=[n for n, _, _ in LIMITS])
    local = lambda c: F.from_utc_timestamp(c, zone).cast("date")
    days = read.withColumn("day", F.explode(F.sequence(local(F.col("last_run")), local(F.col("now")))))
    of_month, of_week = F.array_contains("dom", F.dayofmonth("day")), F.array_contains(F.transform("dow", lambda d: d % 7), F.dayofweek("day") - 1)
    fits = F.when(F.col("dom_set") & F.col("dow_set"), of_month | of_week).otherwise(of_month & of_week)
    kept = days.where(F.array_contains("month", F.month("day")) & fits)
    at = kept.select("job", "last_run", "now", "day", F.explode("hour").alias("h"), "minute").select("job", "last_run", "now", "day", "h", F.explode("minute").alias("m"))
    clock = F.expr("cast(day as timestamp_ntz) + make_dt_interval(0, h, m)").cast("string")
    return at.select("job", "last_run", "now", F.to_utc_timestamp(clock, zone).alias("due")).where("due > last_run AND due <= now").select("job", "due").distinct()


def pending(jobs: DataFrame, runs: DataFrame, now: Column, zone: str = ZONE) -> DataFrame:
    """job, due, missed: of the jobs (job, schedule, since) what is due by ``now`` after the newest run (job, ran) there is; the newest due
    time of each, and how many came before it."""
    last = runs.groupBy("job").agg(F.max("ran").alias("ran"))
    known = jobs.join(last, "job", "left").select("job", "schedule", F.coalesce("ran", "since").alias("last_run"), now.alias("now"))
    return due(known, zone).groupBy("job").agg(F.max("due").alias("due"), (F.count(F.lit(1)) - 1).alias("missed"))
