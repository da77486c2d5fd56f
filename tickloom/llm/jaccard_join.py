"""N-gram Jaccard join of whole texts with Bayesian pruning of candidates (shingles of five words, similarity 0.8).

1. Every text becomes the set of its shingles' 64-bit hashes. Texts with equal sets form a class; its smallest id stands
   for it, so copies never meet in a join.
2. Representatives get MinHash values; BANDS bands of ROWS values are keys. Keys that two or more share link their
   members, and connected components of those links are the groups within which pairs are compared.
3. A group is cut into blocks of about BLOCK members and every pair of its blocks is one task. Where texts that merely
   have a passage in common have chained a group of more than WIDE blocks together, and its bands' own members, cut
   likewise, make fewer rows to deal, these are the tasks instead; a pair then counts in the first band that it shares.
   Within a task, pairs that share a band compare their MinHash values STEP at a time, and are dropped as soon as the posterior probability that their
   similarity reaches the threshold (uniform prior) is under TOLERANCE. The rest are verified exactly by their sets.
   A task returns, for each member, the documents it is linked with by number, and a spanning forest of the links.
4. Components of the forests are the near-duplicate groups.

No pair is dropped but by the posterior, no group is capped, and no task holds more than about two blocks.

Defined results: null texts and texts without words have no shingles and link with nothing; texts of one to four words
have one shingle of all their words; repeated rows count as copies; ids may be of any type that sorts, and keep it; rows of
one id with different texts, and rows without an id, are told apart inside (a class is known by the size and 128 bits of its
set, and has a number of its own); a class or group without any id has null for its smallest, and its rows are kept;
extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import _text
from tickloom.llm._common import components, cut, grouped, met

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 40, 7, 40, 1e-5
HASHES = BANDS * ROWS
BLOCK, WIDE, PIECE = 512, 8, 1 << 20


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    a = rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
    return a, rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a batch: first and last row, distinct shingle hashes sorted by row and value, and row offsets."""
    _, offsets = _text.utf8(column)
    for lo, hi in _text.pieces(offsets, PIECE):
        raw, part = _text.utf8(column.slice(lo, hi - lo))
        h, row, _, _ = _text.words(raw, part)
        s, r = _text.shingles(h, row, hi - lo, SHINGLE)
        order = np.lexsort((s, r))
        s, r = s[order], r[order]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
        s, r = s[keep], r[keep]
        yield lo, hi, s, np.searchsorted(r, np.arange(hi - lo + 1))


def signatures(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values (rows x HASHES, uint32) of non-empty sets given by offsets."""
    x = (_text.mix(s) >> np.uint64(32)).astype(np.uint32)
    a, b = coefficients()
    out = np.empty((len(at) - 1, HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(x * a[k] + b[k], at[:-1])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """rows x BANDS keys of 64 bits, each of its band's values and number."""
    x = np.zeros((len(sig), BANDS), np.uint64)
    for i in range(ROWS):
        x = _text.mix(x * np.uint64(0x9FB21C651E98DF25) + sig[:, i::ROWS][:, :BANDS].astype(np.uint64))
    return _text.mix(x + np.arange(BANDS, dtype=np.uint64))


@functools.cache
def least_equal() -> list[int]:
    """For each number of values compared (a multiple of STEP): the least equal ones for a pair to stay.

    With a uniform prior the similarity's posterior after m equal of n is Beta(m + 1, n - m + 1); its upper tail at the
    threshold is a binomial sum.
    """

    def tail(m: int, n: int) -> float:
        t = THRESHOLD
        return sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))

    return [next(m for m in range(n + 1) if tail(m, n) >= TOLERANCE) for n in range(STEP, HASHES + 1, STEP)]


def fingerprints(s: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of hashes that stand for each non-empty set."""
    a = np.add.reduceat(_text.mix(s + np.uint64(3)), ends[:-1])
    b = np.add.reduceat(_text.mix(s ^ np.uint64(0xABCDEF0123456789)), ends[:-1])
    return a.view(np.int64), b.view(np.int64)


def filled(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a non-empty set, and the offsets of these."""
    some = np.flatnonzero(np.diff(at) > 0)
    return some, np.r_[at[:-1][some], len(s)]


def keyed(texts: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text), a, b (128 bits that stand for the row's set), n (its size) and keys (of its bands;
    none if it is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, s, at in sets(batch.column(2)):
                some, ends = filled(s, at)
                a, b = np.zeros((2, hi - lo), np.int64)
                size = np.diff(at)
                keys = np.zeros(0, np.uint64)
                if len(some):
                    a[some], b[some] = fingerprints(s, ends)
                    keys = band_keys(signatures(s, ends)).ravel()
                offsets = np.r_[0, np.cumsum((size > 0) * BANDS)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.record_batch(
                    [*(batch.column(c).slice(lo, hi - lo) for c in (0, 1)), pa.array(a), pa.array(b), pa.array(size, pa.int64()), lists],
                    names=["doc_id", "row", "a", "b", "n", "keys"],
                )

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, row long, a long, b long, n long, keys array<long>")


def loaded(members: DataFrame) -> DataFrame:
    """The members with their MinHash values and sets as binary columns instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, s, at in sets(batch.column("text")):
                some, ends = filled(s, at)
                if not len(some):
                    continue
                # Another text of the same hash isn't the member.
                own = np.ones(len(some), bool)
                for name, values in zip("ab", fingerprints(s, ends), strict=True):
                    own &= values == batch.column(name).slice(lo, hi - lo).to_numpy()[some]
                sig = signatures(s, ends)
                at_rows = pa.array(lo + some[own])
                yield pa.record_batch(
                    [*(batch.column(c).take(at_rows) for c in ("node", "copies", "grp", "tasks")),
                     pa.array([x.tobytes() for x in sig[own]], pa.binary()),
                     pa.array([s[ends[i] : ends[i + 1]].tobytes() for i in np.flatnonzero(own)], pa.binary())],
                    names=["node", "copies", "grp", "tasks", "sig", "set"],
                )

    tasks = "array<struct<band:int,key:bigint,blk:int,blks:int>>"
    return members.mapInArrow(run, f"node long, copies long, grp long, tasks {tasks}, sig binary, set binary")


def compare(task: pa.Table) -> pa.RecordBatch | None:
    """Links within a pair of blocks: rows (node, links, null) and forest edges (node, 0, other)."""
    nodes = task.column("node").to_numpy()
    node, one = np.unique(nodes, return_index=True)  # a row may be there twice, as its document was
    copies = task.column("copies").to_numpy()[one]
    low, high, band = (task.column(c)[0].as_py() for c in ("lo", "hi", "band"))
    first = task.column("blk").to_numpy()[one] == low
    if len(node) < 2:
        return None
    sigs, texts = task.column("sig"), task.column("set")
    sig = np.frombuffer(b"".join(sigs[i].as_py() for i in one.tolist()), np.uint32).reshape(len(node), HASHES)
    held = [np.frombuffer(texts[i].as_py(), np.uint64) for i in one.tolist()]
    size = np.array([len(x) for x in held])
    keys = band_keys(sig)
    left = np.flatnonzero(first)
    right = left if low == high else np.flatnonzero(~first)
    if not len(left) or not len(right):
        return None
    # Each set as places in one sorted list of values: an intersection is then a sum of flags.
    values, places = np.unique(np.concatenate(held), return_inverse=True)
    starts = np.r_[0, np.cumsum(size)]
    span = lambda i: places[starts[i] : starts[i + 1]]
    flat = np.concatenate([span(j) for j in right])
    cuts = np.r_[0, np.cumsum(size[right])][:-1]
    links, label = np.zeros(len(node), np.int64), np.arange(len(node))
    flag = np.zeros(len(values), bool)
    edges: list[tuple[int, int]] = []
    for i in left.tolist():
        k = np.flatnonzero(right > i) if low == high else np.arange(len(right))
        j = right[k]
        a, b = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        ok = a >= THRESHOLD * b
        j, k = j[ok], k[ok]
        if band < 0:
            ok = (keys[j] == keys[i]).any(1)
        else:
            ok = (keys[j, band] == keys[i, band]) & ~(keys[j, :band] == keys[i, :band]).any(1)
        j, k = j[ok], k[ok]
        equal = np.zeros(len(j), np.int64)
        for at, least in enumerate(least_equal()):
            if not len(j):
                break
            part = slice(at * STEP, (at + 1) * STEP)
            equal += (sig[j, part] == sig[i, part]).sum(1)
            ok = equal >= least
            j, k, equal = j[ok], k[ok], equal[ok]
        if not len(j):
            continue
        flag[span(i)] = True
        if len(j) * 4 < len(right):
            both = np.array([flag[span(x)].sum() for x in j])
        else:
            both = np.add.reduceat(flag[flat].astype(np.int64), cuts)[k]
        flag[span(i)] = False
        j = j[both / (size[i] + size[j] - both) >= THRESHOLD]
        links[i] += copies[j].sum()
        links[j] += copies[i]
        for x in j[label[j] != label[i]].tolist():
            if label[x] != label[i]:
                label[label == label[x]] = label[i]
                edges.append((int(node[i]), int(node[x])))
    some = np.flatnonzero(links)
    if not len(some):
        return None
    return pa.record_batch(
        [pa.array([*node[some].tolist(), *(e[0] for e in edges)], pa.int64()),
         pa.array([*links[some].tolist(), *([0] * len(edges))], pa.int64()),
         pa.array([*([None] * len(some)), *(e[1] for e in edges)], pa.int64())],
        names=["node", "links", "other"],
    )


def blocks(rows):
    """The number of blocks that ``rows`` members are cut into."""
    return F.ceil(rows / BLOCK).cast("int")


def block(blks):
    """The block of a node, by its hash."""
    return F.pmod(F.xxhash64("node"), blks).cast("int")


def dealt(bands: DataFrame, groups: DataFrame) -> DataFrame:
    """node, grp, tasks: what each member of a group is compared in, as (band or -1, its key or 0, block, blocks)."""
    whole = groups.unionAll(groups.select(F.col("component").alias("node"), "component").distinct())
    sizes = whole.groupBy("component").agg(F.count(F.lit(1)).alias("rows")).withColumn("blks", blocks(F.col("rows")))
    one = F.array(F.struct(F.lit(-1).alias("band"), F.lit(0).cast("long").alias("key"), block(F.col("blks")).alias("blk"), "blks"))
    by_group = whole.join(sizes, "component").select("node", F.col("component").alias("grp"), one.alias("tasks"))
    wide = cut(sizes.where(F.col("blks") > WIDE))
    if wide.isEmpty():
        return by_group
    inside = cut(bands.join(whole.join(wide, "component").select("node", "component"), "node"))
    buckets = (
        inside.groupBy("component", "band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blks", blocks(F.col("n")))
    )
    cost = buckets.groupBy("component").agg(F.sum(F.col("n") * F.col("blks")).alias("cost"))
    loose = cut(wide.join(cost, "component").where("cost < rows * blks").select("component"))
    by_band = (
        inside.join(buckets.join(loose, "component").select("band", "key", "blks"), ["band", "key"])
        .groupBy("node", F.col("component").alias("grp"))
        .agg(F.collect_list(F.struct("band", "key", block(F.col("blks")).alias("blk"), "blks")).alias("tasks"))  # BANDS at most
    )
    return by_group.join(loose.withColumnRenamed("component", "grp"), "grp", "left_anti").select("node", "grp", "tasks").unionAll(by_band)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_links, component_id, kept, class_id: one row for each row of ``docs``.

    n_links counts the other rows linked directly, copies included; component_id is the smallest id reachable by links;
    kept is doc_id = component_id; class_id is the smallest id with an equal set.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    found = cut(keyed(rows))
    same = ["a", "b", "n"]
    # The checkpoint keeps the classes' numbers as they are; the keys are the same in all rows of a class, and any of its texts does.
    numbered = cut(
        found.where("n > 0").groupBy(*same)
        .agg(F.min("doc_id").alias("class_id"), F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes, bands = numbered.drop("keys"), numbered.select("node", F.posexplode("keys").alias("band", "key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v < w")
    near = bands.join(shared, "key").where("node <> v").select(F.col("node").alias("a"), F.col("v").alias("b"))
    members = dealt(bands, components(near)).join(classes.select("node", "row", "a", "b", "copies"), "node")
    # A text that stands in many rows of one id comes once: the join has dealt and sorted the rows by their hash already.
    texts = rows.select("row", "text").join(members, "row").groupBy("row").agg(*[F.first(c).alias(c) for c in ("text", "node", "a", "b", "copies", "grp", "tasks")])
    data = loaded(texts)
    tasks = (
        data.select("node", "copies", "grp", "sig", "set", F.inline("tasks"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blks") - 1)))
        .withColumn("lo", F.least("blk", "with"))
        .withColumn("hi", F.greatest("blk", "with"))
        .select("node", "copies", "grp", "band", "key", "blk", "lo", "hi", "sig", "set")
    )
    parts = cut(grouped(tasks, ["grp", "band", "key", "lo", "hi"], compare, "node long, links long, other long"))
    links = parts.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    tops = components(parts.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    tied = (
        classes.join(links, "node", "left").join(tops, "node", "left")
        .select(*same, "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("top"))
    )
    tied = cut(tied)
    least = tied.groupBy("top").agg(F.min("class_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    known = met(tied.withColumnRenamed("n", "size"), least, "top", "a", tied.count()).drop("top").withColumnRenamed("size", "n")
    linked = found.where("n > 0").select("doc_id", *same).join(known, same)
    alone = found.where("n = 0").select(
        "doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id")
    )
    out = linked.select("doc_id", "n_links", "component_id", "class_id").unionAll(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_UPPER = "".join(c for c in map(chr, (*range(65, 91), *range(0xC0, 0xDF))) if c != "×")
#: A character of a word (after which more may come), for Java and for DuckDB.
WORD = "[0-9A-Za-zÀ-῿₀-⿿぀-\\x{10ffff}]"
_WORDS = f"{WORD}+"
#: DuckDB SQL for ``join`` over documents, by all shingles that two texts share: for small tables.
SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORDS}') AS w FROM documents),
    s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
    k AS MATERIALIZED (SELECT s, min(doc_id) AS k, count(*) AS copies, len(s) AS size FROM s WHERE len(s) > 0 GROUP BY s),
    e AS MATERIALIZED (SELECT k, size, unnest(s) AS h FROM k),
    l AS MATERIALIZED (SELECT a.k AS x, b.k AS y FROM e a JOIN e b ON a.h = b.h AND a.k <> b.k GROUP BY a.k, b.k, a.size, b.size HAVING count(*) / (a.size + b.size - count(*)) >= {THRESHOLD}),
    r AS (SELECT k, k AS c FROM k UNION SELECT r.k, l.y FROM r JOIN l ON l.x = r.c),
    g AS (SELECT k, min(c) AS component_id FROM r GROUP BY k),
    n AS (SELECT k.k, k.copies - 1 + coalesce(sum(o.copies), 0) AS n_links FROM k LEFT JOIN (SELECT l.x, k.copies FROM l JOIN k ON k.k = l.y) o ON o.x = k.k GROUP BY k.k, k.copies)
    SELECT s.doc_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, s.doc_id) AS component_id, coalesce(k.k, s.doc_id) AS class_id, s.doc_id = coalesce(component_id, s.doc_id) AS kept
    FROM s LEFT JOIN k ON k.s = s.s LEFT JOIN g ON g.k = k.k LEFT JOIN n ON n.k = k.k
"""
