"""Substring dedup, spelling variants and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import pyarrow as pa
import pytest

from tickloom.llm import periodic_runs, queries, spelling, substring_dedup
from tickloom.llm._tokens import Tokens

SPACES = " \t\n\x0b\x0c\r"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_tokens_of_a_batch():
    texts = [None, "", "  ", "a", " a\tb ", "é 漢 x", "end", "start", "\nq\r\n"]
    t = Tokens(pa.array(["skipped", *texts])[1:])
    assert [bytes(t.raw[a:b]).decode() for a, b in zip(t.start, t.end, strict=True)] == [w for x in texts for w in split(x)]
    assert t.row.tolist() == [i for i, x in enumerate(texts) for _ in split(x)]
    code, words = t.coded()
    assert [words[int(i)].as_py().decode() for i in code] == [w for x in texts for w in split(x)]


# Substring dedup


def brute_dedup(rows):
    w = {i: split(t) for i, (_, t) in enumerate(rows)}
    least = {}
    for i, (d, _) in enumerate(rows):
        for k in range(len(w[i]) - 49):
            x = tuple(w[i][k : k + 50])
            if d is not None:
                least[x] = min(least.get(x, d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        gone = set()
        for k in range(len(w[i]) - 49):
            if d is not None and least[tuple(w[i][k : k + 50])] < d:
                gone.update(range(k, k + 50))
        out.append((d, len(w[i]), len(gone), sha(" ".join(x for k, x in enumerate(w[i]) if k not in gone))))
    return sorted(out, key=str)


def passages(rng, n_docs, names):
    pool = [[rng.choice(names) for _ in range(rng.choice([49, 50, 51, 60, 75, 120, 300]))] for _ in range(12)]
    rows = []
    for i in range(n_docs):
        words = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.6:
                p = list(rng.choice(pool))
                if rng.random() < 0.4:
                    p = p[rng.randint(0, 20) :]
                if rng.random() < 0.3:
                    p[rng.randrange(len(p))] = "changed"
                words += p
            else:
                words += [rng.choice(names) for _ in range(rng.randint(0, 80))]
        rows.append((i, "".join(x + rng.choice(SPACES) for x in words)))
    return rows


@pytest.mark.parametrize(("seed", "n_names"), [(1, 400), (2, 400), (3, 3), (4, 1), (5, 30)])
def test_substring_dedup(spark, seed, n_names):
    rng = random.Random(seed)
    rows = passages(rng, 60, [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(n_names)])
    rows += [(7, rows[3][1]), (None, rows[4][1]), (None, None), (3, rows[3][1]), (3, rows[9][1]), (70, None), (71, ""), (72, rows[0][1].replace(" ", "\t"))]
    rows += [(200 + k, rows[11][1]) for k in range(40)]  # many copies
    docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, class long")
    got = sorted((tuple(r) for r in substring_dedup.dedup(docs).collect()), key=str)
    assert got == brute_dedup(rows)


def test_substring_dedup_of_text_ids_and_nothing(spark):
    long = " ".join(f"x{k}" for k in range(90))
    docs = spark.createDataFrame([("b", long), ("a", long + " more"), (None, long)], "doc_id string, text string")
    assert {(r[0], r[2]) for r in substring_dedup.dedup(docs).collect()} == {("a", 0), ("b", 90), (None, 0)}
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


# Spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, typos):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if d is None else d}:{w}".encode())
            if typos and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in close.items():
        top = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = top if top and n[top] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(close[w]), n.get(form[w])))
    return out


@pytest.mark.parametrize(("letters", "most"), [("abé", 20_000), ("ab", 4), ("abcdefgh", 10), ("aA×ÿ", 30)])
def test_variants(spark, letters, most):
    rng = random.Random(len(letters) * most)
    stock = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["a" * 300, "a" * 299, "a" * 298]
    rows = []
    for i in range(120):
        words = [rng.choice(stock) for _ in range(int(rng.paretovariate(0.9)) % 90 + 5)]
        rows.append((i if i % 9 else None, "1 ".join(w if rng.random() < 0.8 else w.upper() for w in words)))
    rows += [(5, None), (6, "")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long")
    for typos in (True, False):
        assert {tuple(r) for r in spelling.variants(docs, typos, most).collect()} == brute_variants(rows, typos)


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string"), True).count() == 0


# Periodic runs


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b, q) for (a, b), q in found.items()), key=lambda x: (x[0], x[2]))


def brute_row(doc_id, text, plant):
    w = split(text)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for a, b, q in runs for i in range(a + q, b)}
    top = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    best = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
    return (doc_id, len(runs), *best, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("seed", range(4))
def test_runs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        names, words = [f"w{k}" for k in range(rng.choice([1, 2, 3, 40]))], []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.6:
                p = [rng.choice(names) for _ in range(rng.choice([1, 2, 3, 5, 17, 32, 33, 40, 64, 65, 90, 129, 200]))]
                words += (p * 9)[: int(len(p) * rng.uniform(1, 7))]
            else:
                words += [rng.choice(names) for _ in range(rng.randint(0, 60))]
        rows.append((i, "".join(x + rng.choice(SPACES) for x in words)))
    rows += [(None, "a b " * 9), (None, None), (5, None), (6, ""), (7, " "), (1, "x " * 50), (1, "x " * 50)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, start long, row long")
    for plant in (True, False):
        got = sorted((tuple(r) for r in periodic_runs.detect(docs, plant).collect()), key=str)
        assert got == sorted((brute_row(d, t, plant) for d, t in rows), key=str)


def test_runs_of_a_long_text(spark):
    period = [f"p{k}" for k in range(30_000)]
    text = " ".join(["first", *period * 5, "last"]) + " y" * 200_000
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    row = {r.doc_id: r for r in periodic_runs.detect(docs).collect()}[1]
    assert (row.n_runs, row.start, row.length, row.period) == (2, 150_002, 200_000, 1)
    assert row.collapsed_sha256 == sha(" ".join(["first", *period, "last", "y"]))
    assert periodic_runs.detect(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_spelling_variant_grouping", "op13_periodic_run_detection"])
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{sf}/documents.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = duckdb.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=str) == sorted(want.select(*columns).fetchall(), key=str)
