"""Chat formatting, token counts and the BPE codec against plain versions of themselves."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from tickloom.llm import bpe_codec, chat, token_count

TEXTS = [
    None, "", " ", "a", "don't  stop\n\n\nnow", "x" * 3000, "é" * 500 + "\t 12345", "a<|endoftext|>b<|endoftext|>",
    "word " * 30_000, "　漢字 mixed 😀😀 text", "twice", "twice", " " * 5000 + "z",
]


def docs(spark, texts=TEXTS):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_count.count_tokens(docs(spark), path).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes) == (want, len((t or "").encode()))
        assert got[i].over_limit == (want > 512)
    assert token_count.count_tokens(docs(spark, []), path).count() == 0


def test_codec_round_trip_equals_the_library(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe_codec.Codec(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe_codec.round_trip(docs(spark), path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    text = "one two, three\n four's five  six " * 40
    assert [i for p in own.cuts(text, 50) for i in library.encode_ordinary(p)] == library.encode_ordinary(text)
    assert len(own.cuts(text, 50)) > 3
    cjk = "漢字、かな。12 3!? ひ\n한국어 'll d's " * 60
    assert [i for p in own.cuts(cjk, 30) for i in library.encode_ordinary(p)] == library.encode_ordinary(cjk)
    assert len(own.cuts("漢字、かな。" * 100, 30)) > 10
    pairs = bpe_codec.decode(bpe_codec.encode(docs(spark), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.data) for r in pairs.collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


def test_chat_format_reads_back(spark):
    rows = [
        (1, 0, "user", "hi <s>&lt; [INST]"), (1, 1, "user", None), (1, 2, "assistant", "<|end|></s>&amp;"),
        (1, 3, "assistant", "two"), (2, None, None, ""), (2, 0, "as|>x", "q"), (3, 0, "user", "same"), (3, 0, "user", "same"),
        (None, 0, "assistant", "<|and|>" * 2000),
    ]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, t int")
    formatted = chat.format_chats(turns)
    back = {r.conv_id: [tuple(x) for x in r.turns] for r in chat.read_back(formatted).collect()}
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert back == {c: [x[1:] for x in sorted(v)] for c, v in want.items()}
    one = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert one[1].loss_sha256 == hashlib.sha256(b"<|end|></s>&amp;two").hexdigest()
    assert formatted.where("conv_id = 1").first().formatted.count("<|user|>") == 1
    assert chat.digests(chat.format_chats(turns.limit(0))).count() == 0


def test_codec_on_very_long_runs(monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe_codec.codec(path, public_tokenizers.PATTERN)
    for text in (" " * 10_000_000, "\n" * 3_000_000 + "x", "x" + " " * 2_000_000 + "y" + "\t" * 1_500_000, "a" * 3_000_000, "!?" * 1_000_000, "\r\n" * 600_000):
        assert own.decode(own.encode(text)) == text.encode()
    monkeypatch.setattr(bpe_codec, "LONG", 40)
    small, rng = bpe_codec.Codec(path, public_tokenizers.PATTERN), random.Random(2)
    for _ in range(1500):
        runs = [" " * rng.randint(1, 90), "\n" * rng.randint(1, 90), "\u3000" * rng.randint(1, 80), "\t\r\n" * rng.randint(1, 30), "ab", "x1", "é", "! ", "'s"]
        text = "".join(rng.choice(runs) for _ in range(rng.randint(1, 9)))
        assert small.encode(text) == small.encoding.encode_ordinary(text)
