"""Benchmark decontamination by latent semantic retrieval.

Three passes over all documents, each on the words of whole Arrow batches:

1. how often each of BUCKETS hashed words occurs. The weight of a word is the logarithm of one plus passages over
   occurrences: positive for every word at every size of the data, so nothing is left out of the matrix;
2. a randomised SVD of the TF-IDF matrix of all passages (PASSAGE words, every STEP words): each task adds up its part of
   A'(A R) for a random R, the parts are summed by blocks on the executors, and a QR of the BUCKETS x RANK sum on the
   driver gives the latent space (its size does not depend on the data), with directions scaled to equal spread;
3. cosine of every passage with every benchmark passage in that space. Candidates from COSINE on are checked by the
   item's words around the passage, by the longest common subsequence with the whole item, and by the item's answer.

The DENSE most frequent buckets, which are most of the words, go through small count matrices, the others one by one; the
sums are the same.

COSINE is calibrated: of benchmark passages with each seventh word dropped or replaced, or with word pairs swapped, 98 % reach
it. A candidate must also have enough of the item's words around it, first by a bit sketch of SKETCH bits for each half
passage, then word by word; both only drop pairs that the subsequence check would drop.

A cosine threshold can miss: an item that stands in a large share of all passages has common words only. So the same pass
has a second, exact way to the same checks: where LCS_LIKELY of an item's different words must be there, one of its rarest
must be, as many as may be missing and one more. Every passage that begins in the half of such a word is a candidate. This
finds any leak within a span of the item's length and 8 words, however many documents share it.

An item is found in a document if, around some passage, LCS_LIKELY of its different words stand and the common subsequence
holds at least LCS_SURE of its words, or LCS_LIKELY of them with ANSWER_SHARE of its answer, its last quarter. Items under SHORT words must be there whole. ``latent`` tells which of the
found ones the cosine search had among its candidates.

The benchmark is a stated query set: it is taken in blocks of at most BLOCK_BYTES of text, each broadcast in turn; all
items of a block are looked for in one scan of the documents.

Defined results: null or empty texts and items match nothing; repeated documents or items match each for themselves;
documents of any length are taken whole; extra columns are ignored, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import _text

BUCKETS, RANK, PASSAGE, STEP, DENSE = 1 << 15, 48, 32, 16, 128
COSINE = 0.5
SKETCH = 512
LCS_SURE, LCS_LIKELY, ANSWER_SHARE, SHORT = 0.75, 0.6, 0.75, 8
BLOCK_BYTES, PIECE, SLICE = 8 << 20, 1 << 17, 512
SLOTS, GATHER = 1 << 23, 1 << 20


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


class Words:
    """Words of a piece of a batch, with the half passages they stand in."""

    def __init__(self, column: pa.Array):
        raw, offsets = _text.utf8(column)
        self.hash, self.row, _, _ = _text.words(raw, offsets)
        n_rows = len(offsets) - 1
        count = np.bincount(self.row, minlength=n_rows)
        self.first = np.concatenate([[0], np.cumsum(count)])
        halves = -(-count // STEP)
        self.half_first = np.concatenate([[0], np.cumsum(halves)])
        at = np.arange(len(self.hash)) - self.first[self.row]
        self.half = self.half_first[self.row] + at // STEP
        self.n_halves = int(self.half_first[-1])
        self.half_row = np.repeat(np.arange(n_rows), halves)
        self.same = np.zeros(self.n_halves, bool)
        if self.n_halves > 1:
            self.same[:-1] = self.half_row[1:] == self.half_row[:-1]

    def joined(self, halves: np.ndarray) -> np.ndarray:
        """Sums over each passage (a half and the next of its row) from those over the halves."""
        out = halves.copy()
        out[self.same] += halves[1:][self.same[:-1]]
        return out

    def spread(self, passages: np.ndarray) -> np.ndarray:
        """Sums over the passages that each half is in: its own and the one before."""
        out = passages.copy()
        out[1:][self.same[:-1]] += passages[:-1][self.same[:-1]]
        return out


    def sketches(self, radius: int) -> np.ndarray:
        """Bits (SKETCH for each half, as 64-bit values) of the words of each half and ``radius`` halves on both sides at least."""
        flags = np.zeros((self.n_halves, SKETCH), np.uint8)
        flags[self.half, (self.hash & np.uint64(SKETCH - 1)).astype(np.int64)] = 1
        out = np.packbits(flags, axis=1).view(np.uint64)
        reach = 0
        while reach < radius:
            step = min(max(1, reach), radius - reach)
            wider = out.copy()
            wider[step:] |= out[:-step]
            wider[:-step] |= out[step:]
            out, reach = wider, reach + step
        return out


class Matrix:
    """The passages by buckets matrix of a piece, as counts of the frequent buckets and a list of the other words."""

    def __init__(self, w: Words, dense: np.ndarray):
        """dense: for each bucket its place among the frequent ones, or -1."""
        self.words, b = w, bucket(w.hash)
        place = dense[b]
        often = np.flatnonzero(place >= 0)
        size = int(dense.max(initial=-1)) + 1
        self.counts = np.bincount(w.half[often] * size + place[often], minlength=w.n_halves * size).reshape(w.n_halves, size).astype(np.float32)
        seldom = np.flatnonzero(place < 0)
        self.half, self.bucket = w.half[seldom], b[seldom].astype(np.uint16)  # sorted by radix

    def times(self, values: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """Passages by columns: the sums of the rows of ``values`` (buckets by columns) over each passage's words."""
        out = self.counts @ values[frequent]
        if len(self.half):
            start = np.flatnonzero(np.r_[True, self.half[1:] != self.half[:-1]])
            out[self.half[start]] += np.add.reduceat(values[self.bucket], start, axis=0)
        return self.words.joined(out)

    def add_transposed(self, total: np.ndarray, passages: np.ndarray, frequent: np.ndarray) -> None:
        """Adds to ``total`` (buckets by columns) the sums of the rows of ``passages`` over each bucket's words."""
        halves = self.words.spread(passages)
        total[frequent] += self.counts.T @ halves
        if len(self.half):
            order = np.argsort(self.bucket, kind="stable")
            b = self.bucket[order]
            first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            total[b[first]] += np.add.reduceat(halves[self.half[order]], first, axis=0)


def pieces(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, Words]]:
    _, offsets = _text.utf8(batch.column(name))
    for lo, hi in _text.pieces(offsets, PIECE):
        part = batch.slice(lo, hi - lo)
        yield part, Words(part.column(name))


def summed(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of the blocks (block int, data float32 binary) of all tasks, added up on the executors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(data.as_buffer(), np.float32)
                total[b] = total[b] + x if b in total else x.astype(np.float64)
        yield pa.record_batch(
            [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
            names=["block", "data"],
        )

    rows = parts.repartition("block").mapInArrow(add, "block int, data binary").collect()
    out = np.zeros((BUCKETS, width))
    for r in rows:
        out[r.block * SLICE : (r.block + 1) * SLICE] = np.frombuffer(r.data, np.float64).reshape(SLICE, width)
    return out


def emit(total: np.ndarray) -> pa.RecordBatch:
    """A task's sum, cut into blocks of SLICE buckets."""
    x = total.astype(np.float32).reshape(BUCKETS // SLICE, -1)
    return pa.record_batch(
        [pa.array(range(len(x)), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["block", "data"]
    )


def slot(h: np.ndarray, item: np.ndarray, size: int) -> np.ndarray:
    """Place of an item's word in a table of ``size`` (a power of two)."""
    spread = (h + item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return (spread >> np.uint64(65 - size.bit_length())).astype(np.int64)


def counted(texts: DataFrame) -> tuple[np.ndarray, float]:
    """How often the words of each bucket stand in all documents, and how many passages there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((BUCKETS, 2))
        for batch in batches:
            _, offsets = _text.utf8(batch.column("text"))
            for lo, hi in _text.pieces(offsets, PIECE):
                h, row, _, _ = _text.words(*_text.utf8(batch.column("text").slice(lo, hi - lo)))
                seen[:, 0] += np.bincount(bucket(h), minlength=BUCKETS)
                seen[0, 1] += (-(-np.bincount(row) // STEP)).sum()
        yield emit(seen)

    counts = summed(texts.mapInArrow(run, "block int, data binary"), 2)
    return counts[:, 0], max(1.0, counts[0, 1])


def weights(count: np.ndarray, passages: float) -> np.ndarray:
    """Weight of each bucket, positive for all."""
    return np.log1p(passages / (1 + count)).astype(np.float32)


def frequents(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent buckets, and each bucket's place among them or -1."""
    frequent = np.argsort(-count, kind="stable")[:DENSE]
    dense = np.full(BUCKETS, -1, np.int64)
    dense[frequent] = np.arange(len(frequent))
    return frequent, dense


def latent(texts: DataFrame, weight: np.ndarray, count: np.ndarray) -> np.ndarray:
    """BUCKETS x RANK: the latent space of all passages, by one randomised pass."""
    shared = texts.sparkSession.sparkContext.broadcast((weight, *frequents(count)))

    def start() -> np.ndarray:
        return np.random.default_rng(41).standard_normal((BUCKETS, RANK), dtype=np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w8, frequent, dense = shared.value
        total = np.zeros((BUCKETS, RANK), np.float32)
        values = np.concatenate([start() * w8[:, None], (w8**2)[:, None]], axis=1)
        for batch in batches:
            for _, w in pieces(batch, "text"):
                if not len(w.hash):
                    continue
                matrix = Matrix(w, dense)
                y = matrix.times(values, frequent)
                matrix.add_transposed(total, y[:, :-1] / np.maximum(y[:, -1:], 1e-6), frequent)
        yield emit(total * w8[:, None])

    sketch = summed(texts.mapInArrow(run, "block int, data binary"), RANK)
    q, _ = np.linalg.qr(sketch)
    core = (q.T @ sketch) @ np.linalg.pinv(q.T @ start().astype(np.float64), rcond=1e-6)
    value, turn = np.linalg.eigh((core + core.T) / 2)
    floor = max(value.max(initial=0) * 1e-3, 1e-12)
    space = q @ turn / np.sqrt(np.maximum(value, floor))
    return (space * weight[:, None]).astype(np.float32)


class Items:
    """A block of the benchmark: its words, answers, and its passages in the latent space."""

    def __init__(self, ids: list, texts: list[str | None], space: np.ndarray, count: np.ndarray):
        w = Words(pa.array(texts, pa.string()))
        self.ids = ids
        self.words = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(ids))]
        self.frequent, self.dense = frequents(count)
        z = unit(Matrix(w, self.dense).times(space, self.frequent))
        # The last half of an item is in the passage before it, unless it is the only one.
        kept = w.same | (np.diff(w.half_first) == 1)[w.half_row]
        self.vectors, self.of = np.ascontiguousarray(z[kept].T), w.half_row[kept]
        self.sets = [np.unique(x) for x in self.words]
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.made: dict[int, tuple[list[int], dict[int, int]]] = {}
        self.index(count)

    def index(self, count: np.ndarray) -> None:
        """keys, items: the words one of which must be there, by hash; bits: up to 64 words of each item; least: how many of these must be there."""
        key, of, bits, bit_of = [], [], [], []
        self.least, self.sketch_least = np.ones((2, len(self.ids)), np.int64)
        self.sketch = np.zeros((len(self.ids), SKETCH // 64), np.uint64)
        # Halves from a passage's first that hold the words around it; large ones as a power of two, so that there are few.
        halves = -(-(self.size + 8 + PASSAGE) // STEP)
        self.radius = np.where(halves <= 8, halves, 1 << np.ceil(np.log2(halves)).astype(np.int64))
        for i, x in enumerate(self.sets):
            if not len(x):
                continue
            x = x[np.argsort(count[bucket(x)], kind="stable")]
            missing = len(x) - int(np.ceil(LCS_LIKELY * len(x) - 1e-9)) if self.size[i] >= SHORT else 0
            key.append(x[: missing + 1])
            of.append(np.full(missing + 1, i))
            bits.append(x[:64])
            bit_of.append(np.full(len(bits[-1]), i))
            self.least[i] = max(1, len(bits[-1]) - missing)
            flags = np.zeros(SKETCH, np.uint8)
            flags[(x & np.uint64(SKETCH - 1)).astype(np.int64)] = 1
            self.sketch[i], self.sketch_least[i] = np.packbits(flags).view(np.uint64), flags.sum() - missing
        keys, items = (np.concatenate([z, *a]) for z, a in ((np.zeros(0, np.uint64), key), (np.zeros(0, np.int64), of)))
        order = np.argsort(keys, kind="stable")
        self.items = items[order]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.key_first = np.r_[first, len(keys)]
        self.marks = np.zeros(1 << min(25, max(16, (16 * len(self.keys)).bit_length())), bool)
        self.marks[(self.keys & np.uint64(len(self.marks) - 1)).astype(np.int64)] = True
        n = sum(len(x) for x in bits)
        self.bits = np.zeros(min(SLOTS, 1 << max(12, (32 * n).bit_length())), np.uint64)
        for x, i in zip(bits, bit_of, strict=True):
            np.bitwise_or.at(self.bits, slot(x, i, len(self.bits)), np.uint64(1) << np.arange(len(x), dtype=np.uint64))

    def region(self, w: Words, half: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of the item's length and 8 words around the passages that begin with the halves."""
        row, n = w.half_row[half], self.size[item] + 8
        start = w.first[row] + (half - w.half_first[row]) * STEP
        return np.maximum(start - n, w.first[row]), np.minimum(start + PASSAGE + n, w.first[row + 1])

    def exact(self, w: Words, sketches: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Halves and items with one of the item's rarest words in the half and enough of its words around."""
        at = np.flatnonzero(self.marks[(w.hash & np.uint64(len(self.marks) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, w.hash[at]), len(self.keys) - 1)
        hit = self.keys[k] == w.hash[at]
        at, k = at[hit], k[hit]
        pairs = [np.zeros(0, np.int64)]
        many = self.key_first[k + 1] - self.key_first[k]
        for lo, hi in _text.pieces(np.r_[0, np.cumsum(many)], GATHER):
            each = many[lo:hi]
            nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            item = self.items[np.repeat(self.key_first[k[lo:hi]], each) + nth]
            some = np.unique(np.repeat(w.half[at[lo:hi]], each) * len(self.ids) + item)
            some = some[self.likely(sketches, *np.divmod(some, len(self.ids)))]
            pairs.append(some[self.enough(w, *np.divmod(some, len(self.ids)))])
        return np.divmod(np.unique(np.concatenate(pairs)), len(self.ids))

    def likely(self, sketches: dict[int, np.ndarray], half: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which pairs have enough of the item's bits around the passage; sketches: by radius."""
        keep = np.zeros(len(half), bool)
        for radius, bits in sketches.items():
            own = np.flatnonzero(self.radius[item] == radius)
            for lo in range(0, len(own), GATHER):
                at = own[lo : lo + GATHER]
                n = np.bitwise_count(bits[half[at]] & self.sketch[item[at]]).sum(1, dtype=np.int64)
                keep[at] = n >= self.sketch_least[item[at]]
        return keep

    def enough(self, w: Words, half: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which pairs have so many of the item's words around the passage that the item can be found there."""
        keep = np.zeros(len(half), bool)
        first, end = self.region(w, half, item)
        for a, b in _text.pieces(np.r_[0, np.cumsum(end - first)], GATHER):
            size = (end - first)[a:b]
            start = np.cumsum(size) - size
            word = w.hash[np.arange(size.sum()) + np.repeat(first[a:b] - start, size)]
            there = self.bits[slot(word, np.repeat(item[a:b], size), len(self.bits))]
            keep[a:b] = np.bitwise_count(np.bitwise_or.reduceat(there, start)) >= self.least[item[a:b]]
        return keep

    def listed(self, item: int) -> tuple[list[int], dict[int, int]]:
        """The item's words and their bit masks, made when first needed."""
        if item not in self.made:
            words = self.words[item].tolist()
            self.made[item] = words, masks(words)
        return self.made[item]

    def found(self, item: int, region: np.ndarray) -> float:
        """Share of the item that the region holds in order, if that makes it a leak, else 0."""
        words, mask = self.listed(item)
        n = len(words)
        if np.isin(self.sets[item], region).mean() < LCS_LIKELY:
            return 0.0
        inside = region.tolist()
        share = lcs(mask, n, inside) / n
        if n < SHORT:
            return share if share == 1 and any(inside[i : i + n] == words for i in range(len(inside) - n + 1)) else 0.0
        if share >= LCS_SURE:
            return share
        answer = words[-max(3, n // 4) :]
        if share >= LCS_LIKELY and lcs(masks(answer), len(answer), inside) >= ANSWER_SHARE * len(answer):
            return share
        return 0.0


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(words):
        out[x] = out.get(x, 0) | 1 << i
    return out


def lcs(mask: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each of the ``n`` words."""
    full = (1 << n) - 1
    v = full
    for x in other:
        if m := mask.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


def searches(texts: DataFrame, bench: DataFrame) -> Iterator:
    """For each block of the benchmark a function from batches with a text to pairs of rows and what is found in them."""
    context = texts.sparkSession.sparkContext
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not size:
        return
    count, passages = counted(texts)
    space = latent(texts, weights(count, passages), count)
    blocks = -(-int(size) // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        rows = bench.where(block == k).select("item_id", "text").orderBy("item_id", "text").collect()
        yield context.broadcast((space, Items([r.item_id for r in rows], [r.text for r in rows], space, count)))


def find(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, share, latent: every benchmark item found in a document."""
    kinds = dict(docs.dtypes)["doc_id"], dict(bench.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, share double, latent boolean"

    def run(shared):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, items = shared.value
            for batch in batches:
                for part, w in pieces(batch, "text"):
                    best = search(w, space, items)
                    at = pa.array([r for r, _ in best], pa.int64())
                    values = [pa.array(c, k) for c, k in zip(zip(*best.values(), strict=True), (pa.float64(), pa.float64(), pa.bool_()), strict=False)]
                    if best:
                        yield pa.record_batch(
                            [part.column("doc_id").take(at), pa.array([items.ids[i] for _, i in best]), *values],
                            names=["doc_id", "item_id", "cosine", "share", "latent"],
                        )

        return each

    out = docs.sparkSession.createDataFrame([], schema)
    for shared in searches(docs.select("text"), bench):
        out = out.unionAll(docs.select("doc_id", "text").mapInArrow(run(shared), schema))
    return out


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found: decided where the row is, without a join."""

    def run(shared):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, items = shared.value
            for batch in batches:
                for part, w in pieces(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r for r, _ in search(w, space, items)]] = False
                    yield part.filter(pa.array(keep))

        return each

    out = docs
    for shared in searches(docs.select("text"), bench):
        out = out.mapInArrow(run(shared), docs.schema)
    return out


def search(w: Words, space: np.ndarray, items: Items) -> dict[tuple[int, int], tuple[float, float, bool]]:
    """Cosine, share and whether the cosine search came upon it, of every (row, item) found in a piece."""
    if not len(w.hash) or not len(items.keys):
        return {}
    z = unit(Matrix(w, items.dense).times(space, items.frequent))
    near = [np.zeros(0, np.int64)]
    sketches = {r: w.sketches(r) for r in np.unique(items.radius).tolist()}
    for lo in range(0, len(z), step := max(1, (4 << 20) // items.vectors.shape[1])):
        # Flat, as the places of a two-dimensional array take several times as long to list.
        p, v = np.divmod(np.flatnonzero((z[lo : lo + step] @ items.vectors).ravel() >= COSINE), items.vectors.shape[1])
        likely = items.likely(sketches, lo + p, items.of[v])
        some = np.unique((lo + p[likely]) * len(items.ids) + items.of[v[likely]])
        near.append(some[items.enough(w, *np.divmod(some, len(items.ids)))])
    near = np.concatenate(near)
    half, item = items.exact(w, sketches)
    pairs = np.union1d(near, half * len(items.ids) + item)
    half, item = np.divmod(pairs, len(items.ids))
    by_cosine = np.isin(pairs, near)
    first, end = items.region(w, half, item)
    best: dict[tuple[int, int], tuple[float, float, bool]] = {}
    for h, i, lo, hi, latent_too in zip(half.tolist(), item.tolist(), first.tolist(), end.tolist(), by_cosine.tolist(), strict=True):
        key = int(w.half_row[h]), i
        cosine, known, seen = best.get(key, (0.0, 0.0, False))
        if known < 1 and (share := items.found(i, w.hash[lo:hi])) > known:
            cosine, known = float((z[h] @ items.vectors[:, items.of == i]).max()), share
        if known:
            best[key] = cosine, known, seen or latent_too
    return best
