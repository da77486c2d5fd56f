"""Near duplicates among embeddings by collision-counting projections.

1. Vectors are scaled to length one; equal ones form a class with one representative.
2. Each representative gets a number of signatures of BITS projection signs. A table's signature is a coarse cell in which near
   vectors meet; BITS grows with the logarithm of the number of vectors, so that a cell holds about CELL of them, and the
   number of tables follows from it: a pair at the threshold misses all of them with probability MISS at most.
3. Inside a cell, PROJECTIONS one-dimensional projections are sorted, and the window of half-width WIDTH around each
   query's value counts a collision for every vector in it. Pairs with at least ``needed()`` collisions, the count that a
   pair at the threshold reaches but with probability MISS, are verified by their cosine in double precision.
   A pair that meets in several tables counts in the first of them only.
4. A cell of more than BLOCK vectors is cut into blocks, and each pair of its blocks is a task. A task gives counts of links
   and a spanning forest of them, never the pairs; components of the forests give the groups.

Defined results: vectors that are null, empty, of length zero or with null or non-finite components link with nothing;
vectors of different lengths don't link; ids may be of any type that sorts, and keep it; rows of one vec_id with different
vectors, and rows without an id, are told apart inside (a class is known by 128 bits of its vector, and has a number of its
own); a group without any id has null for its smallest, and its rows are kept; extra columns are ignored; an empty table
stays empty. Recall against brute force is tested, as is precision.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm._common import components, cut, grouped, met

THRESHOLD, CELL, MISS, PROJECTIONS, WIDTH, BLOCK = 0.9, 1024, 1e-4, 32, 0.7, 1024
LISTED = 200_000


def plan(n: int) -> tuple[int, int]:
    """Signs in a signature and number of tables for ``n`` vectors."""
    bits = min(24, max(0, round(math.log2(max(n, 1) / CELL))))
    meet = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(MISS) / math.log1p(-meet))


def needed() -> int:
    """The collisions that a pair at the threshold has at least, but with probability MISS."""
    p = math.erf(WIDTH / math.sqrt(2 - 2 * THRESHOLD) / math.sqrt(2))
    below, k = 0.0, 0
    while True:
        below += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if below > MISS:
            return k
        k += 1


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def encoded(x: np.ndarray) -> bytes:
    """The components in 4 bytes each where that loses nothing, else in 8."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return (small if (small == x).all() else x).tobytes()


def decoded(raw: bytes, dim: int) -> np.ndarray:
    """The vector scaled to length one, in double precision."""
    x = np.frombuffer(raw, np.float32 if len(raw) == 4 * dim else np.float64).astype(np.float64)
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def collisions(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Counts of window collisions, left x right, of their projections (rows by PROJECTIONS), by sorted windows."""
    out = np.zeros((len(left), len(right)), np.int8)
    for k in range(left.shape[1]):
        order = np.argsort(right[:, k])
        value = right[order, k]
        lo = np.searchsorted(value, left[:, k] - WIDTH, "left").astype(np.uint16)
        hi = np.searchsorted(value, left[:, k] + WIDTH, "right").astype(np.uint16)
        place = np.empty(len(order), np.uint16)
        place[order] = np.arange(len(order), dtype=np.uint16)
        # Places before the window wrap around to large numbers.
        out += (place - lo[:, None] < (hi - lo)[:, None]).view(np.int8)
    return out


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """rows x tables: the cell of each vector in each table, by the signs of ``bits`` projections."""
    if not bits or not tables:
        return np.zeros((len(x), tables), np.uint32)
    sign = (x @ directions(x.shape[1], tables * bits, 9) > 0).reshape(len(x), tables, bits)
    return (sign @ (1 << np.arange(bits, dtype=np.int64))).astype(np.uint32)


def compare(task: pa.Table, bits: int, tables: int) -> pa.RecordBatch | None:
    """Links within a cell, or a pair of its blocks: rows (node, links, null) and forest edges (node, 0, other)."""
    dim, low, high = (task.column(c)[0].as_py() for c in ("dim", "lo", "hi"))
    table = task.column("tab")[0].as_py()
    node = task.column("node").to_numpy()
    if len(node) < 2:
        return None
    copies = task.column("copies").to_numpy()
    x = np.stack([decoded(raw, dim) for raw in task.column("vec").to_pylist()])
    cells = signatures(x, bits, tables)[:, :table]
    h = x @ directions(dim, PROJECTIONS, 5)
    first = task.column("blk").to_numpy() == low
    left = np.flatnonzero(first)
    right = left if low == high else np.flatnonzero(~first)
    links, label = np.zeros(len(node), np.int64), np.arange(len(node))
    edges: list[tuple[int, int]] = []
    least = needed()
    for at in range(0, len(left), 256):
        some = left[at : at + 256]
        i, j = np.nonzero(collisions(h[some], h[right]) >= least)
        i, j = some[i], right[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        if table:
            new = np.ones(len(i), bool)
            for a in range(0, len(i), 1 << 16):
                p = slice(a, a + (1 << 16))
                new[p] = ~(cells[i[p]] == cells[j[p]]).any(1)
            i, j = i[new], j[new]
        near = np.zeros(len(i), bool)
        for a in range(0, len(i), 1 << 14):
            p = slice(a, a + (1 << 14))
            near[p] = np.einsum("ij,ij->i", x[i[p]], x[j[p]]) >= THRESHOLD
        i, j = i[near], j[near]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        while len(i):
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if len(i):
                label[label == label[j[0]]] = label[i[0]]
                edges.append((int(node[i[0]]), int(node[j[0]])))
    linked = np.flatnonzero(links)
    if not len(linked):
        return None
    return pa.record_batch(
        [pa.array([*node[linked].tolist(), *(e[0] for e in edges)], pa.int64()),
         pa.array([*links[linked].tolist(), *([0] * len(edges))], pa.int64()),
         pa.array([*([None] * len(linked)), *(e[1] for e in edges)], pa.int64())],
        names=["node", "links", "other"],
    )


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, a, b (128 bits that stand for the vector, null if it can't link), dim, vec (its components)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            marks, dims, data = [], [], []
            for v in batch.column(1).to_pylist():
                x = np.array(v if v and None not in v else [np.nan], np.float64)
                if not np.isfinite(x).all() or not x.any():
                    marks.append((None, None)), dims.append(None), data.append(None)
                    continue
                x += 0.0  # no negative zeros
                mark = xxhash.xxh3_128_intdigest(x.tobytes())
                marks.append(((mark >> 64) - 2**63, (mark & (2**64 - 1)) - 2**63))
                dims.append(len(x))
                data.append(encoded(x))
            sides = [pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1)]
            yield pa.record_batch([batch.column(0), *sides, pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "a", "b", "dim", "vec"])

    kind = dict(vectors.dtypes)["vec_id"]
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, a long, b long, dim int, vec binary")


def celled(heads: DataFrame, bits: int, tables: int) -> DataFrame:
    """The rows (node, copies, dim, vec) once for each table, with its number ``tab`` and their cell in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            raw = batch.column("vec")
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                code = signatures(np.stack([decoded(raw[r].as_py(), dim) for r in rows.tolist()]), bits, tables)
                part = batch.take(pa.array(rows))
                for t in range(tables):
                    yield pa.record_batch(
                        [*part.columns, pa.array(np.full(len(rows), t, np.int32)), pa.array(code[:, t].astype(np.int64))],
                        names=[*part.schema.names, "tab", "cell"],
                    )

    return heads.select("node", "copies", "dim", "vec").mapInArrow(run, "node long, copies long, dim int, vec binary, tab int, cell long")


def dedup(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding)."""
    found = cut(prepared(vectors))
    good = found.where("a IS NOT NULL")
    # The checkpoint keeps the classes' numbers as they are; the components are the same in all rows of a class.
    classes = cut(
        good.groupBy("a", "b", "dim").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    bits, tables = plan(classes.count())
    dealt = celled(classes, bits, tables)
    sizes = dealt.groupBy("dim", "tab", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blks"))
    # The list of cells is known to be no longer than this; a short one needs no shuffle of the vectors.
    if classes.select("dim").distinct().count() * (tables << bits) <= LISTED:
        sizes = F.broadcast(sizes)
    tasks = (
        dealt.join(sizes, ["dim", "tab", "cell"]).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blks") - 1)))
        .withColumn("lo", F.least("blk", "with"))
        .withColumn("hi", F.greatest("blk", "with"))
        .select("dim", "tab", "cell", "lo", "hi", "blk", "node", "copies", "vec")
    )
    work = functools.partial(compare, bits=bits, tables=tables)
    parts = cut(grouped(tasks, ["dim", "tab", "cell", "lo", "hi"], work, "node long, links long, other long"))
    links = parts.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    tops = components(parts.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    tied = classes.drop("vec").join(links, "node", "left").join(tops, "node", "left").select(
        "a", "b", "dim", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("top")
    )
    tied = cut(tied)
    least = tied.groupBy("top").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    known = met(tied, least, "top", "a", tied.count()).select("a", "b", "dim", "n_links", "component_id")
    linked = good.select("vec_id", "a", "b", "dim").join(known, ["a", "b", "dim"]).select("vec_id", "n_links", "component_id")
    alone = found.where("a IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: DuckDB SQL for ``dedup`` over embeddings, by all pairs: for small tables.
SQL = f"""
    WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    n AS (SELECT * FROM v WHERE list_count(e) = len(e) AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
    l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
    r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.c)
    SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM r GROUP BY vec_id
"""
