"""Removal of long repeated passages of words, by compaction of a de Bruijn graph.

A window is WINDOW consecutive words; one whose words also start in a document of a smaller id is repeated, and its words go.

1. Copies first: documents with equal word sequences form a class. All but those of its smallest id lose every word, and one
   text stands for the class from here on.
2. Token k-mers (K words) are the edges that documents walk along. Of them those are kept as nodes of the sparse graph whose
   least SEED words stand at their beginning or end (closed syncmers): the choice depends on the k-mer alone, each window holds
   one at least, and two that follow each other leave no word between them. Counting nodes by the smallest and largest
   id of their documents leaves the repeated ones; a node all of whose occurrences have the same neighbours, at the same
   distances, is nonbranching.
3. The nodes are joined back to the documents. Runs of nonbranching nodes with their two ends are the compacted paths: every
   window inside one that holds a nonbranching node is in the same documents as the path, so a path is one row, however long
   it is. Windows around branching nodes are rows of their own, unless a node in them is not repeated.
4. Paths and windows are known by 128 bits of all their words at their source coordinates. The smallest id of each, joined back,
   says what each document loses.

Hot passages are summed up by task before they meet, and joined by sort-merge joins, which adaptive execution splits.

Defined results: null texts have no words; rows without an id lose nothing and take nothing from others; rows of one id do not take from
each other; texts under WINDOW words stay; repeated rows have equal results; ids may be of any type that sorts; a text may be
of any length; extra columns are ignored, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import _text
from tickloom.llm._common import cut
from tickloom.llm._tokens import Tokens, digests, prefix_hash, stretch_hash
from tickloom.llm.periodic_runs import window_minima

#: A window holds a closed syncmer as long as 2 K - SEED - 1 <= WINDOW.
WINDOW, K, SEED = 50, 27, 3
SEEDS = K - SEED + 1
PIECE = 1 << 20
BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


class Walk:
    """The words of a piece of a batch with running hashes, and its nodes."""

    def __init__(self, column: pa.Array):
        self.tokens = Tokens(column)
        self.sums = [prefix_hash(h, base) for h, base in zip(self.tokens.hashes(), BASES, strict=True)]

    def hashed(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the words from a to b."""
        size = (b - a).astype(np.uint64)
        return tuple(_text.mix(stretch_hash(*s, a, b) + size) for s in self.sums)

    def nodes(self) -> np.ndarray:
        """Places of the nodes of the texts of a window at least."""
        t = self.tokens
        count = np.where(t.count >= WINDOW, t.count - K + 1, 0)
        at = np.repeat(t.first[:-1] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        if not len(at):
            return at
        every = np.arange(len(t.start) - SEED + 1)
        value = _text.mix(stretch_hash(*self.sums[0], every, every + SEED))
        least = window_minima(value, SEEDS)
        return at[(value[at] == least[at]) | (value[at + SEEDS - 1] == least[at])]


def lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, a, b (128 bits of the words), sha (of the words), keys and places of the nodes of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            _, offsets = _text.utf8(texts)
            for lo, hi in _text.pieces(offsets, PIECE):
                w = Walk(texts.slice(lo, hi - lo))
                t, at = w.tokens, w.nodes()
                a, b = (x.view(np.int64) for x in w.hashed(t.first[:-1], t.first[1:]))
                cuts = np.searchsorted(at, t.first)
                keys = w.hashed(at, at + K)[0].view(np.int64)
                places = (at - t.first[t.row[at]]).astype(np.int32)
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(t.count, pa.int64()), pa.array(a), pa.array(b),
                     pa.array(digests(*t.kept(np.ones(len(t.start), bool)))), lists(keys, cuts), lists(places, cuts)],
                    names=["doc_id", "text_hash", "n", "a", "b", "sha", "keys", "places"],
                )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, n long, a long, b long, sha string, keys array<long>, places array<int>"
    return hashed_texts(docs).mapInArrow(work, schema)


def hashed_texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def occurrences(classes: DataFrame) -> DataFrame:
    """class, id, key, place, context of every node of every class; context: its neighbours and how far away they are."""
    key, place = (lambda i: F.get("keys", i)), (lambda i: F.get("places", i))
    each = F.transform(
        "keys",
        lambda k, i: F.struct(
            k.alias("key"), place(i).alias("place"),
            F.xxhash64(key(i - 1), place(i) - place(i - 1), key(i + 1), place(i + 1) - place(i), F.lit(1)).alias("context"),
        ),
    )
    return classes.select("class", "id", F.inline(each))


def repeats(marked: DataFrame) -> DataFrame:
    """h1, h2, class, id, first, windows: the paths and the single windows that may be repeated, of each marked text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            _, offsets = _text.utf8(texts)
            for lo, hi in _text.pieces(offsets, PIECE):
                own = batch.slice(lo, hi - lo)
                w = Walk(own.column("text"))
                row, first, count, h1, h2 = candidates(w, own.column("marks"))
                take = pa.array(row)
                yield pa.record_batch(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), own.column("class").take(take), own.column("id").take(take),
                     pa.array(first - w.tokens.first[row], pa.int64()), pa.array(count, pa.int64())],
                    names=["h1", "h2", "class", "id", "first", "windows"],
                )

    kind = dict(marked.dtypes)["id"]
    return marked.mapInArrow(work, f"h1 long, h2 long, class long, id {kind}, first long, windows long")


def candidates(w: Walk, marks: pa.ListArray):
    """Row, first window, number of windows and 128 bits of each path and single window."""
    t, at = w.tokens, w.nodes()
    n = len(t.start)
    flat = marks.flatten()
    base = np.repeat(t.first[:-1], np.diff(marks.offsets.to_numpy()))
    state = np.zeros(n + 1, np.int8)  # of the node at a word: 1 repeated and branching, 2 nonbranching
    state[base + flat.field("place").to_numpy()] = np.where(flat.field("branching").to_numpy(zero_copy_only=False), 1, 2)
    state[:n][np.setdiff1d(np.flatnonzero(state[:n]), at)] = 0

    def within(flags: np.ndarray) -> np.ndarray:
        """How many flagged words begin a k-mer inside the window from each word on."""
        total = np.r_[0, np.cumsum(flags)]
        reach = WINDOW - K + 1
        return total[np.minimum(np.arange(n) + reach, n)] - total[:n]

    is_node = np.zeros(n, bool)
    is_node[at] = True
    room = np.arange(n) + WINDOW <= t.first[t.row + 1]
    open_windows = room & (within(is_node) == within(state[:n] > 0))
    # Runs of nonbranching nodes of a row, with the node before and after.
    inner, row = state[at] == 2, t.row[at]
    same = np.r_[False, row[1:] == row[:-1]] if len(at) else np.zeros(0, bool)
    goes_on = inner & same & np.r_[False, inner[:-1]] if len(at) else same
    a = np.flatnonzero(inner & ~goes_on)
    b = np.flatnonzero(inner & ~np.r_[goes_on[1:], False]) if len(at) else a
    before = np.where(same[a], a - 1, a)
    after = np.where((b + 1 < len(at)) & (np.r_[same, False][b + 1]), b + 1, b)
    left, right = at[before], at[after] + K
    low = np.maximum(left, at[a] - (WINDOW - K))
    high = np.minimum(right - WINDOW, at[b])
    ok = low <= high
    left, right, low, high = left[ok], right[ok], low[ok], high[ok]
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, low, 1)
    np.add.at(inside, high + 1, -1)
    single = np.flatnonzero(open_windows & (np.cumsum(inside[:-1]) == 0))
    paths, windows = w.hashed(left, right), w.hashed(single, single + WINDOW)
    first = np.r_[low, single]
    # A path is told from a window of the same words, as what they stand for differs.
    h1, h2 = (np.r_[_text.mix(p + np.uint64(0x5EED)), x] for p, x in zip(paths, windows, strict=True))
    return t.row[first], first, np.r_[high - low + 1, np.ones(len(single), np.int64)], h1, h2


def cleaned(texts: DataFrame) -> DataFrame:
    """class, n_removed, kept: what is left of each text without the words of its ``lost`` windows (first, windows)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = _text.utf8(batch.column("text"))
            for lo, hi in _text.pieces(offsets, PIECE):
                own = batch.slice(lo, hi - lo)
                t = Tokens(own.column("text"))
                lost = own.column("lost")
                flat = lost.flatten()
                a = np.repeat(t.first[:-1], np.diff(lost.offsets.to_numpy())) + flat.field("first").to_numpy()
                edge = np.zeros(len(t.start) + 1, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, a + flat.field("windows").to_numpy() + WINDOW - 1, -1)
                keep = np.cumsum(edge[:-1]) == 0
                gone = np.r_[0, np.cumsum(~keep)][t.first]
                yield pa.record_batch(
                    [own.column("class"), pa.array(np.diff(gone), pa.int64()), pa.array(digests(*t.kept(keep)))], names=["class", "n_removed", "kept"]
                )

    return texts.mapInArrow(work, "class long, n_removed long, kept string")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by one blank) of each row."""
    rows = cut(scanned(docs))
    same = ["n", "a", "b"]
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    # The checkpoint keeps the classes' numbers as they are; the nodes are the same in all rows of a class.
    classes = cut(
        rows.where(F.col("n") >= WINDOW).groupBy(*same)
        .agg(F.min(known).alias("least"), F.first(F.struct("keys", "places")).alias("nodes"))
        .where("least is not null")
        .select(F.monotonically_increasing_id().alias("class"), *same, F.col("least.doc_id").alias("id"), F.col("least.text_hash").alias("text_hash"), "nodes.*")
    )
    nodes = occurrences(classes)
    # Written, as the keys' totals: a join in one stage with its own aggregate can't be split where a key is hot.
    repeated = cut(
        nodes.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("context").alias("c"), F.max("context").alias("d"))
        .where("lo < hi").select("key", (F.col("c") != F.col("d")).alias("branching"))
    )
    marks = nodes.select("class", "key", "place").join(repeated, "key").groupBy("class").agg(F.collect_list(F.struct("place", "branching")).alias("marks"))
    own = marks.join(classes.select("class", "id", "text_hash"), "class")
    texts = hashed_texts(docs).withColumnRenamed("doc_id", "id")
    marked = cut(texts.join(own, ["id", "text_hash"]).select("class", "id", "text", "marks"))
    found = cut(repeats(marked))
    owner = cut(found.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last").select("h1", "h2", "owner"))
    lost = (
        found.join(owner, ["h1", "h2"]).where("id > owner")
        .groupBy("class").agg(F.collect_list(F.struct("first", "windows")).alias("lost"))
    )
    left = cleaned(marked.select("class", "text").join(lost, "class")).groupBy("class").agg(F.first("n_removed").alias("n_removed"), F.first("kept").alias("kept"))
    judged = classes.select("class", *same, "id").join(left, "class", "left")
    out = rows.select("doc_id", *same, "sha").join(judged.select(*same, "id", "n_removed", "kept"), same, "left")
    copy, first = F.col("doc_id") > F.col("id"), (F.col("doc_id") == F.col("id")) & F.col("kept").isNotNull()
    return out.select(
        "doc_id", F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).when(first, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, EMPTY).when(first, F.col("kept")).otherwise(F.col("sha")).alias("kept_sha256"),
    )


#: DuckDB SQL for ``dedup`` over documents with unique ids, by every window: for small tables.
SQL = f"""
    WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    windows AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
    least AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
    lost AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM windows JOIN least USING (h) WHERE least < doc_id),
    word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
