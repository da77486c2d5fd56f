"""Periodic runs of words, found by multi-scale minimizers.

A run is a stretch of words with smallest period q (words q apart are identical) of at least LEAST words and EXPONENT periods
that neither neighbour extends. Each text is searched whole, where it is, with no shuffle:

1. Periods up to SHORT are found by direct scans of lags. A run of period q has at least 3 q equal pairs of words in a row, so
   one pair in every 3 q is looked at, and what is equal there is extended.
2. At each scale W (64, 128, ...) periods from W / 2 + 1 to W are sought by grams of W words: as a gram is as long as the period
   at least, it occurs in a run only at multiples of the period. A run of four periods holds two equal windows of W / 2 grams,
   a period apart; their minima are the same gram, so that consecutive equal minimizers stand at the very distance of the
   period. Only such pairs are seeds: at most one for each selected gram.
3. Seeds are extended both ways by binary search on running hashes and then compared word by word. Of the seeds with the same
   stretch the smallest period is the run's.

All words are numbered exactly (not by a hash), and the work is linear in a text's length times the number of its scales.

Defined results: null or empty texts have no words and no run; a null id leaves the text as it is (it has no checksum); repeated
rows repeat; ties are settled as stated at ``best``; texts may be of any length; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm import _text
from tickloom.llm._common import CRC_TABLE, crc_sql
from tickloom.llm._tokens import Tokens, digests, prefix_hash, stretch_hash

LEAST, EXPONENT, SHORT = 6, 4, 32
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15


class Stretches:
    """Words of several rows by number, with hashes that tell how far two places go on alike."""

    def __init__(self, code: np.ndarray, row: np.ndarray, first: np.ndarray):
        self.code, self.row, self.first = code, row, first
        self.total, self.inverse = prefix_hash(_text.mix(code.astype(np.uint64) + np.uint64(0x51ED270B)), BASE)

    def alike(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return stretch_hash(self.total, self.inverse, a, a + length) == stretch_hash(self.total, self.inverse, b, b + length)

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from a and b on (or before them) are equal, ``most`` at most."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.alike(a - mid, b - mid, mid) if back else self.alike(a, b, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def extended(self, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, end and period of the longest stretches around equal words ``at`` and ``at + lag`` that are long enough."""
        row = self.row[at]
        right = self.reach(at, at + lag, self.first[row + 1] - at - lag, False)
        left = self.reach(at, at + lag, at - self.first[row], True)
        start, end = at - left, at + lag + right
        ok = end - start >= np.maximum(LEAST, EXPONENT * lag)
        found = np.unique(np.stack([start[ok], end[ok], lag[ok]]), axis=1)
        return found[0], found[1], found[2]

    def exact(self, start: int, end: int, lag: int) -> list[tuple[int, int, int]]:
        """The stretch itself if its words do repeat; otherwise (equal hashes of different words) the ones inside it that do."""
        same = self.code[start : end - lag] == self.code[start + lag : end]
        if same.all():
            return [(start, end, lag)]
        row = self.row[start]
        lo, hi = self.first[row], self.first[row + 1]
        edge = np.diff(np.r_[0, (self.code[lo : hi - lag] == self.code[lo + lag : hi]).astype(np.int8), 0])
        pairs = zip((np.flatnonzero(edge == 1) + lo).tolist(), (np.flatnonzero(edge == -1) + lo + lag).tolist(), strict=True)
        return [(a, b, lag) for a, b in pairs if b - a >= max(LEAST, EXPONENT * lag)]


def by_lags(s: Stretches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and lags, up to SHORT, where a run may be."""
    n = len(s.code)
    for lag in range(1, min(SHORT, n - 1) + 1):
        step = max(LEAST, EXPONENT * lag) - lag
        at = np.arange(0, n - lag, step)
        at = at[(s.code[at] == s.code[at + lag]) & (s.row[at] == s.row[at + lag])]
        # One side of the place has at least half of the equal pairs.
        half = np.full(len(at), step // 2)
        right = (at + half + lag <= s.first[s.row[at] + 1]) & s.alike(at, at + lag, np.where(at + half + lag <= s.first[s.row[at] + 1], half, 0))
        left = at - half >= s.first[s.row[at]]
        left &= s.alike(at - np.where(left, half, 0), at + lag - np.where(left, half, 0), np.where(left, half, 0))
        at = at[right | left]
        yield at, np.full(len(at), lag)


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every window of ``width`` keys, by doubling."""
    done, least = 1, keys
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return least


def by_minimizers(s: Stretches, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags, over half of ``scale`` and up to it, of consecutive equal minimizers."""
    count = np.diff(s.first)
    long = np.flatnonzero(count > 2 * scale)
    none = np.zeros(0, np.int64)
    if not len(long):
        return none, none
    grams = count[long] - scale + 1
    at = np.repeat(s.first[long] - np.r_[0, np.cumsum(grams)[:-1]], grams) + np.arange(grams.sum())
    gram = _text.mix(stretch_hash(s.total, s.inverse, at, at + scale))
    bits = np.uint64(max(1, int(len(at)).bit_length()))
    keys = (gram >> bits << bits) | np.arange(len(at), dtype=np.uint64)
    least = window_minima(keys, min(scale // 2, len(at))) & ((np.uint64(1) << bits) - np.uint64(1))
    pick = least[np.r_[True, least[1:] != least[:-1]]].astype(np.int64)
    pick = np.unique(pick)
    order = np.lexsort((pick, gram[pick], s.row[at[pick]]))
    pick = pick[order]
    a, b = pick[:-1], pick[1:]
    lag = at[b] - at[a]
    ok = (gram[a] == gram[b]) & (s.row[at[a]] == s.row[at[b]]) & (lag > scale // 2) & (lag <= scale)
    return at[a[ok]], lag[ok]


def runs(code: np.ndarray, row: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """First word, end and period of every run, by start, then period."""
    s = Stretches(code, row, first)
    seeds = list(by_lags(s))
    scale, longest = 2 * SHORT, int(np.diff(first).max(initial=0))
    while longest > 2 * scale:
        seeds.append(by_minimizers(s, scale))
        scale *= 2
    at, lag = (np.concatenate([x[i] for x in seeds]) if seeds else np.zeros(0, np.int64) for i in (0, 1))
    if not len(at):
        return []
    least: dict[tuple[int, int], int] = {}
    for start, end, q in zip(*(x.tolist() for x in s.extended(at, lag)), strict=True):
        for a, b, p in s.exact(start, end, q):
            least[a, b] = min(p, least.get((a, b), p))
    return sorted(((a, b, p) for (a, b), p in least.items()), key=lambda x: (x[0], x[2]))


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods (exactly); ties: the smallest start, then period."""
    top = None
    for start, end, q in found:
        if top is None or (end - start) * top[2] > (top[1] - top[0]) * q:
            top = (start, end, q)
    return top


def planted(text: bytes, doc_id) -> bytes:
    """The text, or, for ids whose checksum is divisible by 10, the text with its words from some place on repeating."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return text
    words, g = text.split(), h // 10
    n = len(words)
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return b" ".join(words[:a] + (tail * ((n - a) // len(tail) + 1))[: n - a])


SCHEMA = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def detect(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_runs, the run of most periods (start, length, period, exponent_milli; null without one), and digests of all runs
    and of the words that are left when each run is cut to its first period. ``plant`` repeats words of some texts first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            if plant:
                pairs = zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True)
                texts = pa.array([planted(t, i) if t and i is not None else t or b"" for i, t in pairs], pa.large_binary()).cast(pa.large_string())
            _, offsets = _text.utf8(texts)
            for lo, hi in _text.pieces(offsets, PIECE):
                yield rows(ids.slice(lo, hi - lo), Tokens(texts.slice(lo, hi - lo)))

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")


def rows(ids: pa.Array, t: Tokens) -> pa.RecordBatch:
    """The result's rows for a piece of a batch."""
    code, _ = t.coded()
    found: list[list[tuple[int, int, int]]] = [[] for _ in t.count]
    drop = np.zeros(len(code) + 1, np.int32)
    for a, b, q in runs(code, t.row, t.first):
        r = int(t.row[a])
        found[r].append((a - int(t.first[r]), b - int(t.first[r]), q))
        drop[a + q] += 1
        drop[b] -= 1
    tops = [best(f) for f in found]
    value = lambda f: pa.array([f(x) if x else None for x in tops], pa.int64())
    listed = ["".join(f"{a},{b - a},{q}\n" for a, b, q in f) for f in found]
    return pa.record_batch(
        [
            ids, pa.array([len(f) for f in found], pa.int64()), value(lambda x: x[0]), value(lambda x: x[1] - x[0]), value(lambda x: x[2]),
            value(lambda x: 1000 * (x[1] - x[0]) // x[2]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed]),
            pa.array(digests(*t.kept(np.cumsum(drop[:-1]) == 0))),
        ],
        names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    )


#: DuckDB SQL for ``detect`` with planted repetitions over documents with unique ids, by all equal words of a text: for small tables.
SQL = f"""
    WITH {CRC_TABLE},
    given AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc_sql("doc_id::VARCHAR")} AS h FROM documents, crc),
    start AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS plant, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM given),
    texts AS MATERIALIZED (SELECT doc_id, n, CASE WHEN plant THEN list_concat(w[1 : a], list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1])) ELSE w END AS w FROM start),
    word AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM texts),
    pairs AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // {EXPONENT}),
    islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs),
    stretches AS (SELECT doc_id, q, min(i) AS a, max(i) + q + 1 AS b FROM islands GROUP BY doc_id, q, k HAVING count(*) + q >= greatest({LEAST}, {EXPONENT} * q)),
    runs AS MATERIALIZED (SELECT doc_id, a, b, min(q) AS q FROM stretches GROUP BY doc_id, a, b),
    top AS (SELECT doc_id, count(*) AS n_runs, first(struct_pack(a, b, q) ORDER BY (b - a) / q DESC, a, q) AS t, string_agg(concat(a, ',', b - a, ',', q, chr(10)), '' ORDER BY a, q) AS runs FROM runs GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(a + q, b)) AS i FROM runs),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, t.a::BIGINT AS start, (t.b - t.a)::BIGINT AS length, t.q::BIGINT AS period, (1000 * (t.b - t.a) // t.q)::BIGINT AS exponent_milli,
        sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM texts LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
