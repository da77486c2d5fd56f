"""What lets queries keep up with large tables: how much their plans and tasks do, with the same results."""

from __future__ import annotations

import re
import statistics

import pyarrow as pa
import pytest

import __spark_entry__ as contract
from tickloom.operators import blocked, derived


def test_scores_of_short_and_long_tokens(spark):
    """Scores go over a whole window only beyond a token's first rows, and are those of the window's rows."""
    values = {token: [float((i * 7 + token) % 11) for i in range(n)] for token, n in ((1, 3), (2, 5), (3, 6), (4, 17))}
    rows = [(t, i, x) for t, xs in values.items() for i, x in enumerate(xs)]
    scored = derived.normalised(spark.createDataFrame(rows, "token long, ts_ns long, x double"), ["x"], 5)
    for r in scored.collect():
        seen = values[r.token][max(0, r.ts_ns - 4) : r.ts_ns + 1]
        want = (r.x - statistics.fmean(seen)) / statistics.stdev(seen) if len(seen) > 1 else r.x
        assert r.z_x == pytest.approx(want, abs=1e-12) and r.norm_valid == (len(seen) > 1)
    assert scored.columns == ["token", "ts_ns", "x", "z_x", "norm_valid"]
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"avg\(x#\d+\) windowspecdefinition\(token#\d+L, ts_ns#\d+L ASC NULLS FIRST, specifiedwindowframe\(RowFrame, unboundedpreceding", plan)


@pytest.mark.parametrize("name", ["h22_composite_strategy", "h32_backtest_by_token"])
def test_bars_are_made_once_for_scores_and_trades(spark, name):
    """The event table is read for the bars, the tick signals and the buckets, and not again for the bars that are traded."""
    plan = contract.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3


class Dealt:
    """Stands for a data frame; keeps what a task runs over its batches."""

    def select(self, *_):
        return self

    repartition = sortWithinPartitions = select

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_slices_of_a_batch_leave_together():
    """A batch of many small slices gives one batch, not one for each; a slice may go over batches."""
    work = lambda held: [(held[0]["token"], held[0]["_slice"], [float(len(held))])]
    run = blocked.by_slice(Dealt(), ["ts_ns"], ["token", "_slice", "ts_ns"], work, "token long, _slice long, map array<double>")
    parts = [[(1, 1, 1), (1, 2, 2), (1, 2, 3), (2, 2, 1)], [(2, 2, 2), (2, 3, 3), (3, 1, 1)]]
    made = list(run(iter(pa.RecordBatch.from_pylist([dict(zip(("token", "_slice", "ts_ns"), r, strict=True)) for r in p]) for p in parts)))
    assert [b.num_rows for b in made] == [2, 2, 1]
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == [(1, 1, [1.0]), (1, 2, [2.0]), (2, 2, [2.0]), (2, 3, [1.0]), (3, 1, [1.0])]
