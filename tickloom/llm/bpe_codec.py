"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before they reach the library, where no match of the split pattern can cross: after a letter that no
letter follows, after a digit that no digit follows, and after a sign that white space follows. There every match ends anyway
and the next begins, so identifiers are the same; this holds for split patterns of runs of letters, digits and signs with at
most one blank before them. Characters of the cut are such as all versions of Unicode class alike.

Where the pattern ends in RESTS, a run of white space longer than LONG, which the library's search can't hold, is matched by
rule: all of it at the end of a text, else all but its last character, which goes with what follows. The piece is then merged
by the library as any other. Runs of letters, digits or signs stay in one piece of any length; other patterns get texts with
their white space as it is.
Decoding joins the raw bytes of the identifiers.

Defined results: null text counts as empty; an empty text has no identifiers; special strings inside texts are ordinary
text; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text from which it is cut, and of a piece at least.
LONG = 1 << 16
#: How a split pattern ends that takes white space up to the last of it, and the characters that it means.
RESTS = r"\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        letter = "A-Za-zÀ-ÖØ-öø-ɏА-яぁ-ゖァ-ヺ一-龥가-힣"
        self.boundary = regex.compile(
            rf"(?<=[{letter}])(?=[\x00-@\[-`{{-\x7f、。！？，：；「」])|(?<=[0-9])(?=[\x00-/:-\x7f、。])|(?<=[!-/:-@\[-`{{-~、。！？，：；「」])(?=[ \t\r\n])"
        )
        self.white = regex.compile(f"[{WHITE}]{{{LONG},}}+") if pattern.endswith(RESTS) else None

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text, and whether each is one match of the pattern: a long run of white space."""
        lo = 0
        for m in self.white.finditer(text) if self.white else ():
            yield text[lo : m.start()], False
            lo = m.end() - (m.end() < len(text))
            yield text[m.start() : lo], True
        yield text[lo:], False

    def cuts(self, text: str, size: int = LONG) -> list[str]:
        out, lo = [], 0
        while len(text) - lo > size:
            m = self.boundary.search(text, lo + size)
            if m is None:
                break
            out.append(text[lo : m.start()])
            lo = m.start()
        return [*out, text[lo:]]

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for part, whole in self.parts(text):
            if whole:
                ids += self.encoding._core_bpe.encode_single_piece(part.encode())
            else:
                for piece in self.cuts(part):
                    ids += self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file, made once."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = pa.array([c.encode(t.as_py() or "") for t in part.column(1)], pa.list_(pa.int32()))
                yield pa.record_batch([part.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and data (binary) of each row of ``encode``'s result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            data = pa.array([c.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())
            yield pa.record_batch([batch.column(0), data], names=["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, keeping the digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = codec(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = c.encode(t.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
