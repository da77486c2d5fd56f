"""Structured Streaming: time bars with a watermark, and folds over stored state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators import folds


def stream_bars(ticks: DataFrame, width: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """Bars of a tick stream (token, ts timestamp, seq, last_price, last_quantity), emitted once the watermark has passed.

    Rows later than the watermark are dropped, where a batch would still count them.
    """
    at = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("token", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("last_price", at).alias("open"), F.max("last_price").alias("high"), F.min("last_price").alias("low"),
            F.max_by("last_price", at).alias("close"), F.sum("last_quantity").alias("volume"), F.count(F.lit(1)).alias("tick_count"),
        )
        .select("token", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume", "tick_count")
    )


def stream_fold(
    rows: DataFrame, made: list, keep: list[str], order: list[str], key: str = "token", session: str | None = None, idle: str | None = None
) -> DataFrame:
    """The folds of the batch operators over a stream: one state for each key, in the state store.

    Rows are folded in order within a micro-batch; the state that a key keeps does not grow with its history. A row that comes
    in a later micro-batch than rows after it is left out: what they gave has gone out already. With ``session`` (a column) the
    state begins anew where its value changes; with ``idle`` (a time such as "2 hours") the state of a key that has had no rows
    for so long is dropped.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), *(f.outputs for f in made)])
    columns = [c for c, _ in folds.fields(schema)]
    rest = milliseconds(idle) if idle else None

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        states, last, part = folds.load(state.get[0]) if state.exists else (None, None, None)
        frame = pd.concat(list(frames)).sort_values(order, kind="stable")
        names = list(frame.columns)
        out = []
        for values in zip(*(frame[c].tolist() for c in names), strict=True):
            row = dict(zip(names, values, strict=True))
            at = tuple(row[c] for c in order)
            if last is not None and at < last:
                continue
            if states is None or session and row[session] != part:
                states = [f.init() for f in made]
            last, part = at, row[session] if session else None
            folds.advance(made, states, row)
            out.append([row[c] for c in columns])
        state.update((folds.dump((states, last, part)),))
        if rest:
            state.setTimeoutDuration(rest)
        yield pd.DataFrame(out, columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if rest else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(step, schema, "state binary", "append", timeout)


def milliseconds(text: str) -> int:
    """A time such as "10 seconds" or "2 hours"."""
    n, unit = text.split()
    return int(float(n) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])


def latest_every(rows: DataFrame, key: str, order: list[str], period: str, path: str, checkpoint: str):
    """The newest row of each key of a stream, written whole to ``path`` every period; the result is the query."""
    row = F.struct(*[c for c in rows.columns if c != key])
    newest = rows.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_r")).select(key, "_r.*")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return newest.writeStream.outputMode("complete").trigger(processingTime=period).foreachBatch(write).option("checkpointLocation", checkpoint).start()
