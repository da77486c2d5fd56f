"""Spelling variants by search schemes over a bidirectional FM-index.

1. Letter runs of whole texts are counted, by task first and then by word; rare and short ones are left out.
2. Two words differ by one inserted, deleted or replaced character only if one half of the first is in the other unchanged:
   at its beginning, or at its end. So each word is dealt twice: forward, where the first half is matched exactly and the error
   is sought to the right of it, and backward, where the second half is matched exactly and the error is sought to the left.
   Words that share an exact half share their first (last) two characters, and these deal them to buckets. Two characters with
   over MOST words are dealt by the whole exact half instead, and a half that still has more, by pairs of blocks.
3. A bucket's words, delimited, make one direction of the index: a suffix array, its BWT and ranks. All words of the bucket are
   searched for in lockstep: an interval of suffix ranks is extended by one character at a time through the exact half, then
   with one error allowed at each place of the other, to the closing delimiter. A pair found both ways counts once.
4. A word's form is its most frequent near word, if that is at least twice as frequent; roots follow forms by doubling joins.

No near pair is left out, no bucket is capped, and nothing but the number of words and of changed roots reaches the driver.

Defined results: null texts hold no words; a null id counts as an empty one for the checksum; repeated rows count as often as
they stand there; ties go to the smallest word in code-point order; very long runs are words like others; extra columns are
ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm._common import CRC_TABLE, crc_sql, cut, grouped

RUN = re.compile("[a-zÀ-ÿ]+")
SHORTEST, RAREST, TYPO, TWICE = 5, 3, 97, 2
MOST, BUCKETS, HELD = 20_000, 16, 400_000


def tally(text: str, doc_id, counts: dict[str, int], typos: bool) -> None:
    """Adds the text's words to ``counts``; with ``typos``, the runs whose checksum says so lose a character first."""
    own = Counter(RUN.findall(text.encode().lower().decode()))  # of bytes, so that A to Z alone change
    start = crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for word, n in own.items():
        if typos and not (h := crc32(word.encode(), start)) % TYPO:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= SHORTEST:
            counts[word] += n


def vocabulary(docs: DataFrame, typos: bool = False) -> DataFrame:
    """word and n of the words of all texts that are long and frequent enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)
        made = lambda: pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tally(text.as_py() or "", doc_id, counts, typos)
                if len(counts) > HELD:
                    yield made()
                    counts.clear()
        yield made()

    parts = docs.select("doc_id", "text").mapInArrow(work, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= RAREST)


class Index:
    """One direction of the FM-index of delimited words: rows of ``text`` are code lists; patterns grow to the right."""

    def __init__(self, words: list[np.ndarray], letters: int):
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes + 1)
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        # Words stand reversed, so that a pattern that grows to the right grows to the left here, as backward search has it.
        flat = np.concatenate([w[::-1] for w in words])
        place = np.arange(len(flat)) + np.repeat(np.arange(len(words)), sizes) + 1
        text[place] = flat
        self.n, self.letters = len(text), letters
        self.order = self.sorted_suffixes(text)
        self.bwt = text[self.order - 1]
        self.word_at = np.full(self.n, -1, np.int64)
        self.word_at[np.r_[0, ends[:-1]]] = np.arange(len(words))
        self.keys = np.sort(self.bwt * (self.n + 1) + np.arange(self.n))
        self.begin = np.searchsorted(np.sort(text), np.arange(letters + 1))

    @staticmethod
    def sorted_suffixes(text: np.ndarray) -> np.ndarray:
        """The suffix array, by prefix doubling; distinct words make all ranks differ within two words' length."""
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1] + 1
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:]
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.r_[True, key[order[1:]] != key[order[:-1]]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            step *= 2
            if new.all() or step >= n:
                return order

    def extended(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more character each."""
        base = c * (self.n + 1)
        shift = self.begin[c] - np.searchsorted(self.keys, base)
        return np.searchsorted(self.keys, base + lo) + shift, np.searchsorted(self.keys, base + hi) + shift

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The intervals' numbers, characters and longer intervals, for each character (no delimiter) that may follow."""
        wide = hi - lo > self.letters
        size = np.where(wide, 0, hi - lo)
        i = np.repeat(np.arange(len(lo)), size)
        c = self.bwt[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[i]]
        pair = np.unique(i * self.letters + c)
        many = np.flatnonzero(wide)
        pair = np.r_[pair, (many[:, None] * self.letters + np.arange(self.letters)).ravel()]
        i, c = pair // self.letters, pair % self.letters
        i, c = i[c > 0], c[c > 0]
        a, b = self.extended(lo[i], hi[i], c)
        ok = a < b
        return i[ok], c[ok], a[ok], b[ok]


def search(index: Index, queries: list[np.ndarray], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of queries and of indexed words that differ by one error after the first ``exact`` characters."""
    size = np.array([len(w) for w in queries], np.int64)
    first = np.r_[0, np.cumsum(size + 1)][:-1]
    flat = np.zeros(int((size + 1).sum()), np.int64)
    for w, at in zip(queries, first.tolist(), strict=True):
        flat[at : at + len(w)] = w
    none = np.zeros(0, np.int64)
    zero = np.arange(len(queries))
    lo, hi = index.extended(np.zeros(len(zero), np.int64), np.full(len(zero), index.n), np.zeros(len(zero), np.int64))
    one = (none, none, none)
    found = []
    for j in range(int(size.max(initial=0)) + 1):
        later = []
        free = np.flatnonzero(exact[zero] <= j)
        if len(free):
            i, c, a, b = index.children(lo[free], hi[free])
            q = zero[free][i]
            one = tuple(np.r_[x, y] for x, y in zip(one, (q, a, b), strict=True))  # inserted
            sub = (j < size[q]) & (c != flat[first[q] + np.minimum(j, size[q])])
            later.append((q[sub], a[sub], b[sub]))
            left = free[j < size[zero[free]]]
            later.append((zero[left], lo[left], hi[left]))  # deleted
        q, a, b = one
        a, b = index.extended(a, b, flat[first[q] + j])
        ok = a < b
        q, a, b = q[ok], a[ok], b[ok]
        done = size[q] == j
        found.append((q[done], index.word_at[index.order[a[done]]]))
        later.append((q[~done], a[~done], b[~done]))
        one = tuple(np.concatenate(x) for x in zip(*later, strict=True))
        if j >= 16 and len(one[0]):  # different errors may come to the same pattern
            one = tuple(np.unique(np.stack(one), axis=1))
        go = size[zero] > j
        zero, lo, hi = zero[go], lo[go], hi[go]
        lo, hi = index.extended(lo, hi, flat[first[zero] + j])
        go = lo < hi
        zero, lo, hi = zero[go], lo[go], hi[go]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def exact_half(size, back: bool):
    """The characters of a word of some size that are matched exactly, from its beginning or, backward, from its end."""
    return size - size // 2 if back else size // 2


def matched(task: pa.Table) -> pa.RecordBatch | None:
    """Near pairs (word, near, near_n) of the rows of one bucket or pair of blocks."""
    back = task.column("back")[0].as_py()
    role = task.column("role").to_numpy()
    words, n = task.column("word").to_pylist(), task.column("n").to_numpy()
    asked, held = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
    if not len(asked) or not len(held):
        return None
    # A word may be there as the target of two halves.
    held = held[np.unique(np.array([words[i] for i in held], object), return_index=True)[1]]
    letters = sorted(set("".join(words)))
    number = {c: i + 1 for i, c in enumerate(letters)}
    turned = (lambda w: w[::-1]) if back else (lambda w: w)
    coded = lambda rows: [np.array([number[c] for c in turned(words[i])], np.int64) for i in rows.tolist()]
    index = Index(coded(held), len(letters) + 1)
    queries = coded(asked)
    q, x = search(index, queries, exact_half(np.array([len(w) for w in queries]), back))
    if not len(q):
        return None
    near = held[x]
    return pa.record_batch(
        [pa.array([words[i] for i in asked[q]]), pa.array([words[i] for i in near]), pa.array(n[near], pa.int64())], names=["word", "near", "near_n"]
    )


def buckets_of(total: int, most: int) -> int:
    return max(BUCKETS, -(-4 * total // most))


def dealt(words: DataFrame, back: bool, total: int, most: int) -> DataFrame:
    """word, n, role (0 asks, 1 is asked for, 2 both), back, key, a, b: the words by bucket, or by pair of blocks."""
    turned = F.reverse("word") if back else F.col("word")
    rows = words.withColumn("turned", turned).withColumn("two", F.left("turned", F.lit(2)))
    large = rows.groupBy("two").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most).select("two", F.lit(True).alias("large"))
    rows = cut(rows.join(large, "two", "left"))
    buckets = buckets_of(total, most)
    zero = F.lit(0).alias("a"), F.lit(0).alias("b")
    small = rows.where("large is null").select(
        "word", "n", F.lit(2).alias("role"), F.concat(F.lit("#"), F.pmod(F.xxhash64("two"), F.lit(buckets)).cast("string")).alias("key"), *zero
    )
    size = F.char_length("turned")
    half = lambda n: exact_half(n, back) if isinstance(n, int) else (n - F.floor(n / 2) if back else F.floor(n / 2)).cast("int")
    prefix = lambda d: F.left("turned", d)
    asks = rows.where("large").select("word", "n", F.lit(0).alias("role"), prefix(half(size)).alias("key"))
    depths = F.array_distinct(F.array(*[half(F.greatest(size + k, F.lit(SHORTEST))) for k in (-1, 0, 1)]))
    asked = rows.where("large").select("word", "n", F.lit(1).alias("role"), "turned", F.explode(depths).alias("depth"))
    asked = asked.select("word", "n", "role", prefix(F.col("depth")).alias("key"))
    halves = asks.unionAll(asked)
    sizes = halves.groupBy("key").agg(F.sum(F.col("role")).alias("held"), F.sum(1 - F.col("role")).alias("asking")).where("held > 0 and asking > 0")
    blocks = sizes.select("key", F.ceil(F.col("held") / most).cast("int").alias("na"), F.ceil(F.col("asking") / most).cast("int").alias("nb"))
    # What asks goes to one block of askers and meets all blocks of what is held, and the other way round.
    own = lambda n: F.pmod(F.xxhash64("word"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    is_held = F.col("role") == 1
    spread = (
        halves.join(blocks, "key")
        .withColumn("a", F.explode(F.when(is_held, F.array(own(F.col("na")))).otherwise(every(F.col("na")))))
        .withColumn("b", F.explode(F.when(is_held, every(F.col("nb"))).otherwise(F.array(own(F.col("nb"))))))
    )
    out = small.unionByName(spread.select("word", "n", "role", "key", "a", "b"))
    return out.withColumn("back", F.lit(back))


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, near, near_n: all ordered pairs of words that differ by exactly one error, each once."""
    total = words.count()
    tasks = dealt(words, False, total, most).unionByName(dealt(words, True, total, most))
    # A task for each bucket and direction: their work is in the search, not in the bytes that they read.
    pairs = grouped(tasks, ["back", "key", "a", "b"], matched, "word string, near string, near_n long", 2 * buckets_of(total, most))
    return pairs.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form, following forms to the last.

    A form is twice as frequent at least, so that chains are short; each round doubles the steps taken.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, typos: bool = False, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = cut(vocabulary(docs, typos))
    near = near_pairs(words, most).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("top")
    )
    better = F.col("top.near_n") >= TWICE * F.col("n")
    judged = cut(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(better, F.col("top.near")).alias("form"), F.when(better, F.col("top.near_n")).alias("form_n"),
        )
    )
    roots = rooted(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB SQL for ``variants`` with typos over documents, by the words with one character left out: for small tables.
SQL = f"""
    WITH RECURSIVE {CRC_TABLE},
    run AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
    own AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM run GROUP BY ALL),
    sums AS MATERIALIZED (SELECT run, n, {crc_sql("doc_id::VARCHAR || ':' || run")} AS h FROM own, crc),
    typed AS (SELECT CASE WHEN h % {TYPO} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM sums),
    words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {RAREST}),
    cut AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (
        SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
    ),
    top AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
    judged AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TWICE} * n THEN near END AS form,
        CASE WHEN near_n >= {TWICE} * n THEN near_n END AS form_n FROM words LEFT JOIN top USING (word)),
    steps AS (SELECT word, word AS reached FROM judged UNION ALL SELECT steps.word, form FROM steps JOIN judged ON judged.word = steps.reached WHERE form IS NOT NULL),
    roots AS (SELECT steps.word, reached AS root FROM steps JOIN judged ON judged.word = steps.reached WHERE form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM judged JOIN roots USING (word)
"""
