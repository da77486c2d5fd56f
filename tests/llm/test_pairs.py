"""Jaccard join, embedding near-dedup and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import _text, embed_dedup, jaccard_join
from tickloom.llm._common import components


def words(text):
    return re.findall(r"[0-9A-Za-zÀ-῿₀-⿿぀-\U0010ffff]+", (text or ""))


def fold_case(text):
    return "".join(c.lower() if c.isascii() or ("À" <= c <= "Þ" and c != "×") else c for c in text or "")


def test_words_of_a_batch():
    texts = ["Été ÀB c", None, "", "one—two “three”", "a" * 5000, "漢字　漢字 x", "Ünï 1,2", "ABC abc"]
    raw, offsets = _text.utf8(pa.array(texts))
    h, row, start, end = _text.words(raw, offsets)
    want = [(i, w) for i, t in enumerate(texts) for w in words(fold_case(t))]
    assert [int(r) for r in row] == [i for i, _ in want]
    number = {}
    for x, (_, w) in zip(h.tolist(), want, strict=True):
        assert number.setdefault(w, x) == x
    assert len(set(number.values())) == len(number)
    part = pa.array(["skip me", *texts])[1:]
    assert (_text.words(*_text.utf8(part))[0] == h).all()


def shingle_set(text):
    w = words(fold_case(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    n, parent = [0] * len(sets), list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and len(a & b) / len(a | b) >= 0.8:
                n[i] += 1
                n[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, n[i], low[root(i)]) for i, (d, _) in enumerate(sets))


def test_jaccard_join_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(pool) for _ in range(rng.choice([4, 6, 60, 300]))]
        for _ in range(rng.choice([1, 2, 9, 30])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(pool)
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, "..."), (903, "one"), (904, "One!"), (905, rows[0][1]), (905, rows[0][1]), (906, "z " * 60_000)]
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, a int, node int")
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in jaccard_join.join(docs).collect())
    assert got == brute(rows)
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_jaccard_join_with_text_ids_and_without_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [("x-2", a), ("x-1", a + " more"), (None, b), (None, b), (None, a), ("x-1", b + " end"), ("z", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id or "", r.n_links, r.component_id or "") for r in jaccard_join.join(docs).collect())
    assert got == [("", 2, "x-1"), ("", 2, "x-1"), ("", 2, "x-1"), ("x-1", 2, "x-1"), ("x-1", 2, "x-1"), ("x-2", 2, "x-1"), ("z", 0, "z")]


@pytest.mark.parametrize("shared", [55, 100])
def test_jaccard_join_of_a_chained_group(spark, monkeypatch, shared):
    """Texts around one passage chain into one wide group: compared by bands, or by blocks where that is less."""
    rng = random.Random(shared)
    passage = [f"p{i}" for i in range(shared)]
    rows = [(i, " ".join([*passage, *(f"x{rng.randrange(10**6)}" for _ in range(30 if shared == 55 else 4))])) for i in range(160)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(20)]
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    monkeypatch.setattr(jaccard_join, "WIDE", 2)
    seen = []
    dealt = jaccard_join.dealt
    monkeypatch.setattr(jaccard_join, "dealt", lambda *a: seen.append(dealt(*a)) or seen[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in jaccard_join.join(docs).collect())
    assert got == brute(rows)
    assert seen[0].where("tasks[0].band >= 0").isEmpty() == (shared == 100)


def test_posterior_bound():
    least = jaccard_join.least_equal()
    assert least == sorted(least) and 0 < least[-1] < 0.8 * jaccard_join.HASHES


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    for i in range(150, 300):
        x[i] = x[i % 40] + rng.uniform(0.05, 0.6) * rng.standard_normal(16)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, rows[3][1]), (405, [2 * v for v in rows[3][1]]), (406, []), (407, [1.0])]
    monkeypatch.setattr(embed_dedup, "CELL", 40)
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, node int")
    got = {r.vec_id: r for r in embed_dedup.dedup(df).collect()}
    assert len(got) == len(rows) and all(got[i].n_links == 0 and got[i].kept for i in (400, 401, 402, 403, 406, 407))
    full = [i for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    m = np.array([dict(rows)[i] for i in full])
    m /= np.linalg.norm(m, axis=1)[:, None]
    links = (m @ m.T >= 0.9).sum(1) - 1
    found = np.array([got[i].n_links for i in full])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    assert got[405].component_id == got[3].component_id == got[404].component_id
    assert embed_dedup.dedup(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (7, 7), (200, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[160] == 100 and got[9] == 5 and got[7] == 5 and got[200] == 3 and len({*got.values()}) == 3


def test_components_with_a_hub(spark):
    edges = [(7, i) for i in range(1000, 6000)] + [(i, i + 1) for i in range(100, 140)] + [(5999, 139)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 5041 and set(got.values()) == {7}


def test_embeddings_with_text_ids(spark):
    rows = [("b", [1.0, 2.0]), ("a", [1.0, 2.01]), (None, [1.0, 2.0]), ("c", [-2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = sorted((r.vec_id or "", r.n_links, r.component_id, r.kept) for r in embed_dedup.dedup(df).collect())
    assert got == [("", 2, "a", False), ("a", 2, "a", True), ("b", 2, "a", False), ("c", 0, "c", True)]


@pytest.mark.parametrize("n", [1, 512, 60_000, 10**7])
def test_plan_keeps_recall(n):
    bits, tables = embed_dedup.plan(n)
    meet = (1 - np.arccos(0.9) / np.pi) ** bits
    assert bits == 0 or (1 - meet) ** tables <= embed_dedup.MISS


def test_jaccard_join_of_very_many_rows_without_ids(spark):
    rng = random.Random(31)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrst") * 3 + str(rng.randrange(40)) for _ in range(30)) for _ in range(3000)]
    texts += [t + " more" for t in texts[:50]]
    rows = [(None, t) for t in texts] + [(7, t + " seven") for t in texts[100:400]] + [(8, texts[0])] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard_join.join(docs).groupBy("n_links").count().collect()
    counts = {r.n_links: r["count"] for r in out}
    # Texts 1 to 49 and 100 to 399 have one partner; text 0 has its longer form, and 500 copies of its own.
    assert counts == {0: 3000 - 50 - 300, 1: 2 * 49 + 2 * 300, 501: 502}
