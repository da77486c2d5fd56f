"""Helpers shared by the corpus operators: tables, cut lineage, grouped Arrow passes, components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HUBS, SALTS = 1000, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader, so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder that all executors share: the session's, or, in a local run without one, one of our own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = folder or tempfile.mkdtemp(prefix="tickloom-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that later steps don't depend on lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts``: the split into training and held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def pack(lists, dtype) -> pa.Array:
    """A binary column from arrays of one numeric type."""
    return pa.array([x.astype(dtype, copy=False).tobytes() for x in lists], pa.binary())


def grouped(
    df: DataFrame,
    keys: list[str],
    work: Callable[[pa.Table], pa.RecordBatch | None],
    schema: str,
    partitions: int | None = None,
) -> DataFrame:
    """Apply ``work`` to the rows of each key, one Arrow table at a time.

    Rows are dealt and sorted by ``keys`` and cut into runs as they stream, which costs far less for many small groups
    than a grouped map. Callers bound the size of a group.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                if batch.num_rows > 1:
                    a = c.to_numpy(zero_copy_only=False)
                    change[1:] |= a[1:] != a[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                key = tuple(c[lo].as_py() for c in columns)
                if held and key != last:
                    if (out := work(pa.Table.from_batches(held))) is not None and out.num_rows:
                        yield out
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = key
        if held and (out := work(pa.Table.from_batches(held))) is not None and out.num_rows:
            yield out

    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(runs, schema)


def met(left: DataFrame, right: DataFrame, key: str, spread: str, total: int) -> DataFrame:
    """``left`` joined with ``right`` on a key that is unique there; right's n is how many rows of left have it, ``total`` of all.

    A key with over a HUBS-th of all rows is a hub: there are at most HUBS of them, so their list is broadcast, and each one's
    rows are salted by ``spread`` over SALTS keys.
    """
    hub = F.col("n") > max(total // HUBS, 64)
    hubs = F.broadcast(right.where(hub).select(key, F.lit(True).alias("_hub")))
    salt = F.when(F.col("_hub"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.explode(F.when(hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    salted = left.join(hubs, key, "left").withColumn("_salt", salt).drop("_hub")
    return salted.join(right.withColumn("_salt", salts).drop("n"), [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): rows (node, component), component the smallest node.

    Alternating large-star and small-star steps over edges only, until nothing changes; each round is a few shuffles of id
    pairs and keeps one edge for each node at the end. Nodes without an edge (or with loops only) don't appear. Nothing goes
    to the driver but one checksum a round.
    """
    star = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**40))).alias("h")]
    before, now = None, star.agg(*sums).first()
    while now != before and now.n:
        before = now
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        large = cut(met(both.where("v > u"), least, "u", "v", 2 * now.n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = met(large, low, "u", "v", now.n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        star = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = star.agg(*sums).first()
    return star.select(F.col("u").alias("node"), F.col("v").alias("component"))


#: A CTE of DuckDB with the 256 remainders that ``crc_sql`` needs.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of the UTF-8 of a string of characters under U+0800, with ``crc`` joined in."""
    size = f"list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], flatten({size})), lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1])))"
