"""Token counts of a byte-level BPE vocabulary, by merging alone.

A pre-token's symbols stand in a doubly linked list; a heap holds its adjacent pairs by merge rank and place. The lowest
pair is merged again and again; the count is the number of initial symbols less the merges done. No identifiers are made.
Counts of pre-tokens seen before are kept in a bounded memory of each Python worker.

Defined results: null text counts as empty; an empty text has no tokens; texts of any length are taken whole (a
pre-token of n bytes costs n log n); repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how the vocabulary's byte-level pre-tokeniser splits text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered by a worker, and the longest that is.
KEPT, KEPT_CHARS = 1_000_000, 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts tokens by the merges of a tokenizer file; ``specials`` are matched in texts and count one each."""

    def __init__(self, merges: list[tuple[str, str]], specials: list[str]):
        import regex

        number: dict[str, int] = {s: b for b, s in enumerate(byte_symbols())}
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            a, b = (number.setdefault(x, len(number)) for x in (left, right))
            self.rules.setdefault((a, b), (rank, number.setdefault(left + right, len(number))))
        self.find = regex.compile(SPLIT).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.kept = _Kept(self.merge)

    @classmethod
    def from_file(cls, path: str) -> MergeCounter:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        return cls(pairs, [t["content"] for t in spec.get("added_tokens", [])])

    def merge(self, piece: str) -> int:
        """Tokens of one pre-token."""
        symbol = list(piece.encode())
        n = len(symbol)
        if n < 2:
            return n
        rules, alive = self.rules, n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (rule := rules.get((symbol[i], symbol[i + 1]))) is not None:
                heap.append((rule[0], i, symbol[i], symbol[i + 1], rule[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = new, -1
            after[i] = k = after[j]
            alive -= 1
            if k < n:
                before[k] = i
                if (rule := rules.get((new, symbol[k]))) is not None:
                    heapq.heappush(heap, (rule[0], i, new, symbol[k], rule[1]))
            if (h := before[i]) >= 0 and (rule := rules.get((symbol[h], new))) is not None:
                heapq.heappush(heap, (rule[0], h, symbol[h], new, rule[1]))
        return alive

    def count(self, text: str) -> int:
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        counts = sum(map(self.kept.__getitem__, self.find(text)))
        if len(self.kept) > KEPT:
            self.kept.clear()
        return counts


class _Kept(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> int:
        n = self.make(piece)
        if len(piece) <= KEPT_CHARS:
            self[piece] = n
        return n


_COUNTERS: dict[str, MergeCounter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``; ``path`` is the tokenizer file on every worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = MergeCounter.from_file(path)
        counter = _COUNTERS[path]
        for batch in batches:
            ids, n_bytes, texts = batch.columns
            n = pa.array([counter.count(t.as_py()) for t in texts], pa.int64())
            yield pa.record_batch([ids, n_bytes, n], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = sized.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
