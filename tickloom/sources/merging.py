"""Merges into tables that are partitioned by day: only the days that a load touches are read and written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import ingest

#: Days of a load that are listed on the driver; a load of more goes by a semi-join, which reads the days' partitions alone as well.
LISTED = 4096


def merge_days(spark: SparkSession, path: str, rows: DataFrame, make: Callable[[DataFrame, DataFrame], DataFrame], day: str = "date") -> None:
    """The table at ``path``, partitioned by ``day``, after ``make(table, rows)`` over the days of ``rows``.

    Spark writes the new partitions aside and puts them in place of the old ones when the job commits, so that a merge that fails
    leaves the old state, and the files of other days stay as they are. ``make`` must keep the rows' days.
    """
    table = spark.read.parquet(path)
    touched = rows.select(F.col(day).cast(dict(table.dtypes)[day]).alias(day)).distinct()
    listed = [r[0] for r in touched.limit(LISTED + 1).collect()]
    # Partitions of a null day can't be compared with; Spark keeps them under a name of their own.
    null = F.col(day).isNull() if None in listed else F.lit(False)
    days = [d for d in listed if d is not None]
    old = table.where(F.col(day).isin(days) | null) if len(listed) <= LISTED else table.join(touched, table[day].eqNullSafe(touched[day]), "left_semi")
    new = make(old, rows.select([F.col(c).cast(t).alias(c) for c, t in table.dtypes]))
    new.select(table.columns).repartitionByRange(day, *[c for c in table.columns if c != day][:1]).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(day).parquet(path)


def load_days(spark: SparkSession, path: str, rows: DataFrame, name: str) -> None:
    """As ``ingest.load`` for one of its dated tables, in place."""
    merge_days(spark, path, rows, lambda table, fresh: ingest.load(table, fresh, name))
