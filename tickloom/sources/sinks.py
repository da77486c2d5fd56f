"""Sinks: partitioned tables, keyed snapshots, bounded streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.sources.published import Published

#: Tables that are written by day, with their columns.
TABLES = {"candles": schemas.CANDLE, "backtest_ticks": schemas.BACKTEST_TICK, "bars": schemas.ENHANCED_BAR, "signals": schemas.SIGNAL}


def write_by_day(rows: DataFrame, path: str, mode: str = "append", within: str = "token") -> None:
    """Parquet by UTC day of ts_ns; only the days written are replaced when overwriting.

    Rows are dealt by ranges of day and ``within`` and time, so that a day may take as many tasks and files as it needs.
    """
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts_ns") / 86_400_000_000_000).cast("int"))
    dealt = rows.withColumn("day", day).repartitionByRange("day", within, "ts_ns").sortWithinPartitions("day", within, "ts_ns")
    dealt.write.mode(mode).partitionBy("day").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_table(rows: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Rows into one of TABLES, by its columns and types; columns that the rows lack are null, others are left out."""
    fields = [f.split() for f in TABLES[name].split(", ")]
    cells = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in fields]
    write_by_day(rows.select(*cells), f"{root}/{name}", mode, "token" if any(c == "token" for c, _ in fields) else "symbol")


def publish(stream: DataFrame, path: str, capacity: int, checkpoint: str):
    """A stream of which the newest ``capacity`` rows are kept, by a sink that commits each micro-batch once; the result is the query.

    ``published.newest`` reads it.
    """
    stream.sparkSession.dataSource.register(Published)
    return stream.writeStream.format("published").option("path", path).option("capacity", capacity).option("checkpointLocation", checkpoint).start()


def overflow(rows: DataFrame, capacity: int, key: str) -> DataFrame:
    """How many rows of each key a ring of the capacity has dropped."""
    return rows.groupBy(key).agg(F.greatest(F.lit(0), F.count(F.lit(1)) - capacity).alias("dropped"))


def popped(rows: DataFrame, n: int, key: str) -> DataFrame:
    """The oldest n rows of each key: what a reader of its ring takes next."""
    w = W.partitionBy(key).orderBy("ts_ns", "seq")
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def drop_oldest(rows: DataFrame, capacity: int, key: str | None = None) -> DataFrame:
    """What a ring of the capacity still holds: the newest rows, of each key where one is given."""
    if key is None:
        return rows.orderBy(F.desc("ts_ns"), F.desc("seq")).limit(capacity)
    w = W.partitionBy(key).orderBy(F.desc("ts_ns"), F.desc("seq"))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= capacity).drop("_rn")


def latest_snapshot(rows: DataFrame, key: str) -> DataFrame:
    """The newest row of each key, as a keyed store would hold it."""
    row = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(row, F.struct("ts_ns", "seq")).alias("r")).select(key, "r.*")
