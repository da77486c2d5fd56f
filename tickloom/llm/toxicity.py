"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Lexicons: a fixed list of insults, and words and word beginnings that labelled training rows show almost only in toxic
texts. Voters over whole texts use them in plain, disguised and spaced-out form, by count, by density and by pattern; each
says none, some or much. The label model (expectation-maximisation over the counts of vote patterns of all documents,
with labelled training rows held at their labels) estimates how often each voter says what for either class, and, from
the votes' residual correlations, how much of a voter is news beside the others. A logistic classifier on the votes is
trained on the posterior labels.

Words, beginnings and what stands behind a disguise are known by 64-bit hashes, and a whole Arrow batch is voted on at once.

Bounded parameters: lexicons are learned from at most ROWS labelled training rows of each class, and hold every entry of
these that passes the test; vote patterns are at most 3^voters and in fact a few hundred. Everything else covers all rows,
whole texts, in time linear in their length.

Defined results: null or empty texts get no votes and score as such; without labels the fixed list alone is used;
repeated ids of labels count by their largest label; repeated rows and ids of documents repeat, each by its own text; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import _logistic, _text
from tickloom.llm._common import cut, fold
from tickloom.llm._labelmodel import LabelModel
from tickloom.llm.quality import drawn

ROWS, PIECE = 6_000, 1 << 17
#: Insults.
INSULTS = frozenset(
    """idiot idiots moron morons scum trash stupid loser losers clown clowns pathetic worthless disgusting imbecile
    dumb dumbass jerk creep vermin filth filthy garbage degenerate fool freak bastard coward retard subhuman""".split()
)
#: Characters that stand for letters.
DISGUISE = str.maketrans("013457@$!|", "oieastasii")
VOTERS = ["listed", "words_a", "words_b", "begin_4", "begin_5", "begin_6", "disguised", "spaced", "dense", "close", "addressed", "shouting"]
BEGINNINGS = (4, 5, 6)
YOU = frozenset("you your youre u this these such".split())
#: Kinds of lexicon entries: whole words, and beginnings of so many characters.
KINDS = (0, *BEGINNINGS)
_LETTER, _SIGN, _GAP, _UPPER = np.zeros((4, 256), bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[list(b"0123456789@$!|")] = True
_GAP[list(b" .*_-")] = True
_UPPER[65:91] = True


def hashes(texts) -> np.ndarray:
    """The hash of each text's first word; 0 for none."""
    out = np.zeros(len(texts), np.uint64)
    h, row, _, _ = _text.words(*_text.utf8(pa.array(texts, pa.string())))
    out[row[::-1]] = h[::-1]
    return out


class Piece:
    """The words of a piece of a batch, with their lengths in characters and the hashes of their beginnings."""

    def __init__(self, column: pa.Array):
        self.raw, self.offsets = _text.utf8(column)
        self.hash, self.row, self.start, self.end, self.part = _text.hashed(self.raw, self.offsets)
        self.n_rows = len(self.offsets) - 1
        lead = (self.raw & 0xC0) != 0x80
        self.lead = np.flatnonzero(lead)
        self.nth = np.cumsum(lead)
        self.length = self.nth[self.end - 1] - self.nth[self.start] + 1 if len(self.hash) else self.start
        self.words = np.bincount(self.row, minlength=self.n_rows)

    def begun(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of over ``k`` characters, and the hashes of their first ``k``."""
        at = np.flatnonzero(self.length > k)
        return at, self.part(self.start[at], self.lead[self.nth[self.start[at]] - 1 + k])

    def rows_sum(self, row: np.ndarray) -> np.ndarray:
        return np.bincount(row, minlength=self.n_rows)

    def bytes_sum(self, flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def fingerprints(self) -> np.ndarray:
        """The smallest hash of two adjacent words of each row: near copies mostly share it, other texts don't."""
        out = np.full(self.n_rows, 2**64 - 1, np.uint64)
        if len(self.hash):
            after = np.r_[self.hash[1:], self.hash[-1:]]
            inside = np.r_[self.row[1:] == self.row[:-1], False] | (self.words[self.row] == 1)
            pair = _text.mix(self.hash * np.uint64(0x9FB21C651E98DF25) + after)[inside]
            np.minimum.at(out, self.row[inside], pair)
        return out

    def disguised(self) -> tuple[list[str], list[int]]:
        """Runs of letters and signs in which signs stand between letters, with the signs as letters; each with its row.

        Every run is read once, so the time is linear however long it is.
        """
        letter, sign = _LETTER[self.raw], _SIGN[self.raw]
        inner = sign.copy()
        inner[self.offsets[1:-1][self.offsets[1:-1] < len(inner)]] = False  # a text's first sign has no letter before it
        first = np.flatnonzero(inner & np.r_[False, letter[:-1]])
        if not len(first):
            return [], []
        ends = np.flatnonzero(~sign)
        to = np.searchsorted(ends, first)
        known = to < len(ends)
        first, after = first[known], ends[to[known]]
        row = np.searchsorted(self.offsets, first, side="right") - 1
        good = letter[after] & (after < self.offsets[row + 1])
        first, row = first[good], row[good]
        both = letter | sign
        edge = both.copy()
        edge[1:] &= ~both[:-1]
        starts_of_rows = self.offsets[:-1][self.offsets[:-1] < len(both)]
        edge[starts_of_rows] |= both[starts_of_rows]
        starts = np.flatnonzero(edge)
        gaps = np.r_[np.flatnonzero(~both), len(both)]
        begin, one = np.unique(starts[np.searchsorted(starts, first, side="right") - 1], return_index=True)
        end = np.minimum(gaps[np.searchsorted(gaps, begin, side="right")], self.offsets[row[one] + 1])
        texts, rows = [], []
        data = self.raw.tobytes()
        for lo, hi, r in zip(begin.tolist(), end.tolist(), row[one].tolist(), strict=True):
            plain = data[lo:hi].decode("ascii").translate(DISGUISE).lower()
            texts += [plain, plain.rstrip("i")]
            rows += [r, r]
        return texts, rows

    def spaced(self) -> tuple[list[str], list[int]]:
        """Four or more single letters in a row with one sign or blank between each two, as a word; each with its row."""
        if len(self.hash) < 4:
            return [], []
        near = (self.length[1:] == 1) & (self.length[:-1] == 1) & (self.row[1:] == self.row[:-1]) & (self.start[1:] == self.end[:-1] + 1)
        near &= _GAP[self.raw[self.end[:-1]]]
        step = np.diff(np.r_[0, near.astype(np.int8), 0])
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        texts, rows = [], []
        data = self.raw.tobytes()
        for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
            if hi - lo >= 3:
                letters = zip(self.start[lo : hi + 1].tolist(), self.end[lo : hi + 1].tolist(), strict=True)
                texts.append("".join(data[a:b].decode() for a, b in letters).lower())
                rows.append(int(self.row[lo]))
        return texts, rows


def read(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, Piece]]:
    _, offsets = _text.utf8(batch.column(name))
    for lo, hi in _text.pieces(offsets, PIECE):
        part = batch.slice(lo, hi - lo)
        yield part, Piece(part.column(name))


def learn(docs: DataFrame, labels: DataFrame) -> dict[int, dict[int, int]]:
    """Lexicons by kind from labelled rows (doc_id, y): hashes of entries with the times from which on they tell.

    An entry's support is the number of distinct fingerprints with it, so that copies count about once. It is taken if
    its toxic rate is 30 times its clean rate, and chance alone would give it among all entries with odds below 1 in 100.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, p in read(batch, "text"):
                y, f = part.column("y").to_numpy(), p.fingerprints()
                rows, kinds, entries, times = [], [], [], []
                for k in KINDS:
                    at, h = p.begun(k) if k else (a := np.flatnonzero(p.length >= 3), p.hash[a])
                    found, n = np.unique(np.stack([p.row[at].astype(np.uint64), h]), axis=1, return_counts=True)
                    for m in range(1, 4 if k else 2):
                        some = n >= m
                        rows.append(found[0, some].astype(np.int64))
                        entries.append(found[1, some].view(np.int64))
                        kinds.append(np.full(some.sum(), k, np.int32))
                        times.append(np.full(some.sum(), m, np.int32))
                row = np.concatenate(rows)
                yield pa.record_batch(
                    [pa.array(y[row], pa.int32()), pa.array(f[row].view(np.int64)), pa.array(np.concatenate(kinds)), pa.array(np.concatenate(entries)),
                     pa.array(np.concatenate(times))],
                    names=["y", "f", "kind", "entry", "times"],
                )

    sample = docs.select("doc_id", "text").join(F.broadcast(drawn(labels, "y", ROWS)), "doc_id").select("y", "text")
    rows = sample.mapInArrow(run, "y int, f long, kind int, entry long, times int")
    counts = cut(
        rows.groupBy("kind", "entry", "times", "y", "f").agg(F.lit(1).alias("n"))
        .groupBy("kind", "entry", "times")
        .agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    )
    n = {r.y: r["count"] for r in drawn(labels, "y", ROWS).groupBy("y").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    entries = counts.count()
    if not toxic or not clean or not entries:
        return {}
    share = toxic / (toxic + clean)
    least = max(3, int(np.ceil(np.log(1e-2 / entries) / np.log(min(share, 0.5)))))
    rate = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    out: dict[int, dict[int, int]] = {}
    for r in counts.where((F.col("toxic") >= least) & (rate >= 30)).collect():  # from the bounded sample
        kind = out.setdefault(r.kind, {})
        kind[r.entry] = min(r.times, kind.get(r.entry, r.times))
    return out


class Lexicon:
    """Entries as sorted arrays of hashes."""

    def __init__(self, learned: dict[int, dict[int, int]]):
        self.entries, self.times = {}, {}
        for k in KINDS:
            keys = np.array(list(learned.get(k, {})), np.int64).view(np.uint64)
            order = np.argsort(keys)
            self.entries[k] = keys[order]
            self.times[k] = np.array(list(learned.get(k, {}).values()), np.int64)[order]
        self.insults, self.you = (np.sort(hashes(sorted(x))) for x in (INSULTS, YOU))

    @staticmethod
    def place(known: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the known ones, or -1."""
        if not len(known):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, at, -1)

    def tells(self, h: np.ndarray) -> np.ndarray:
        return (self.place(self.insults, h) >= 0) | (self.place(self.entries[0], h) >= 0)

    def begun(self, p: Piece, k: int) -> np.ndarray:
        """Which words of a piece have a listed beginning that their text has often enough."""
        out = np.zeros(len(p.hash), bool)
        if len(self.entries[k]):
            at, h = p.begun(k)
            entry = self.place(self.entries[k], h)
            at, entry = at[entry >= 0], entry[entry >= 0]
            _, of, n = np.unique(p.row[at] * len(self.entries[k]) + entry, return_inverse=True, return_counts=True)
            out[at[n[of] >= self.times[k][entry]]] = True
        return out

    def votes(self, p: Piece) -> np.ndarray:
        """rows x VOTERS: 0 (none), 1 (some) or 2 (much) of each voter."""

        def level(n: np.ndarray, some: float = 1, much: float = 2) -> np.ndarray:
            return (n >= some).astype(np.int64) + (n >= much)

        def behind(found: tuple[list[str], list[int]]) -> np.ndarray:
            texts, rows = found
            row = np.array(rows, np.int64)[self.tells(hashes(texts))] if texts else np.zeros(0, np.int64)
            return level(p.rows_sum(row))

        insult, own = self.place(self.insults, p.hash) >= 0, self.place(self.entries[0], p.hash) >= 0
        begins = [self.begun(p, k) for k in BEGINNINGS]
        hit = insult | own | begins[0] | begins[1] | begins[2]
        half = own & ((p.hash & np.uint64(1)) == 1)
        at = np.flatnonzero(hit)
        row = p.row[at]
        close = (row[1:] == row[:-1]) & (at[1:] - at[:-1] <= 40)
        told = at[(at > 0) & (p.row[at - 1] == row)]
        told = told[self.place(self.you, p.hash[told - 1]) >= 0]
        chars = np.maximum(1, p.bytes_sum((p.raw & 0xC0) != 0x80))
        loud = (p.words > 0) & (p.bytes_sum(p.raw == 33) * 20 >= p.words)
        return np.stack([
            level(p.rows_sum(p.row[insult])), level(p.rows_sum(p.row[half])), level(p.rows_sum(p.row[own & ~half])),
            *(level(p.rows_sum(p.row[b])) for b in begins),
            behind(p.disguised()), behind(p.spaced()),
            level(p.rows_sum(row) / np.maximum(20, p.words), 0.002, 0.01), level(p.rows_sum(row[1:][close])), level(p.rows_sum(p.row[told])),
            np.where(loud, level(p.bytes_sum(_UPPER[p.raw]) / chars, 0.3, 0.6), 0),
        ], axis=1)

    def patterns(self, p: Piece) -> np.ndarray:
        """The votes on each row as one number, in base 3."""
        return self.votes(p) @ POWERS


POWERS = 3 ** np.arange(len(VOTERS), dtype=np.int64)


def vote(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and pattern (the votes as a number) for all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, p in read(batch, "text"):
                yield pa.record_batch([part.column(0), pa.array(lexicon.patterns(p))], names=["doc_id", "pattern"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, pattern long")


def trained(docs: DataFrame, labels: DataFrame, parts: int, held: int) -> tuple[Lexicon, DataFrame, np.ndarray]:
    """The lexicon, the votes on all rows, and the coefficients of the classifier."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != held))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("y"))
    )
    lexicon = Lexicon(learn(docs, known))
    voted = cut(vote(docs, lexicon))
    table = (
        voted.join(known, "doc_id", "left").groupBy("pattern")
        .agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("u", F.col("y").isNull()), ("a", F.col("y") == 0), ("b", F.col("y") == 1))])
        .collect()
    )
    patterns = np.array([r.pattern for r in table], np.int64)[:, None] // POWERS % 3
    counts = np.array([(r.u, r.a, r.b) for r in table], float).reshape(-1, 3)
    # All voters but the last (shouting) speak for toxicity by themselves.
    speaks = np.ones(len(VOTERS))
    speaks[-1] = 0
    model = LabelModel(patterns, counts, speaks)
    return lexicon, voted, _logistic.fit(inputs(patterns), model.post, counts.sum(1), ridge=0.05)


def inputs(patterns: np.ndarray) -> np.ndarray:
    return np.concatenate([patterns == 1, patterns == 2], axis=1).astype(float)


def classify(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; labels (doc_id, toxic) with the held-out remainder are not looked at."""
    _, voted, beta = trained(docs, labels, parts, held)
    said = [F.pmod(F.floor(F.col("pattern") / int(p)), F.lit(3)) for p in POWERS]
    columns = [(v == k).cast("double") for k in (1, 2) for v in said]
    return voted.select(
        "doc_id",
        (fold(F.col("doc_id"), parts) == held).alias("held_out"),
        _logistic.score(columns, beta).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that ``classify`` does not call toxic: decided where the row is, without a join."""
    lexicon, _, beta = trained(docs, labels, parts, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, p in read(batch, "text"):
                z = np.clip(inputs(lexicon.votes(p)) @ beta[:-1] + beta[-1], -30, 30)
                yield part.filter(pa.array(1 / (1 + np.exp(-z)) < threshold))

    return docs.mapInArrow(run, docs.schema)
