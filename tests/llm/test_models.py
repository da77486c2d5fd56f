"""Classifiers by held-out accuracy, decontamination by planted passages, and the pipeline stage by stage."""

from __future__ import annotations

import random
import re
import time
import zlib

import corpus_pipeline
import numpy as np
import pytest

from tickloom.llm import decontam, jaccard_join, pii, quality, toxicity

SYLLABLES = "an the ing er on th ed re in at or es ti ou st ea nd ha le ve".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, common=0.4):
    word = lambda: rng.choice(SYLLABLES) if rng.random() < common else "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(2, 5)))
    return " ".join(word() for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    texts, labels = [], []
    for i in range(600):
        text, bad, toxic = prose(rng, rng.randrange(20, 150)), i % 7 == 0, i % 5 == 0
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "zorkly", "zorkum"]))
            text = " ".join(words)
        if bad:
            text = " ".join(w.upper() + rng.choice(["***", "$$$", "!!"]) for w in text.split())
        texts.append(text)
        labels.append((i, int(not bad), int(toxic)))
    texts += [None, "", "x " * 40_000]
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def right(rows, labels, column, parts, held):
    truth = {r[0]: r[column] for r in labels}
    out = {r.doc_id: r for r in rows}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) for r in rows)
    test = [i for i in truth if out[i].held_out]
    return sum(out[i].predicted == truth[i] for i in test) / len(test), out


def test_quality(spark, corpus):
    docs, labels, truth = corpus
    rows = quality.classify(docs, labels).collect()
    accuracy, out = right(rows, truth, 1, 4, 2)
    assert len(rows) == 603 and accuracy > 0.95
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_quality_ignores_held_out_labels(spark, corpus):
    docs, labels, _ = corpus
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()}


def test_toxicity(spark, corpus):
    docs, labels, truth = corpus
    rows = toxicity.classify(docs, labels).collect()
    accuracy, out = right(rows, truth, 2, 3, 1)
    assert len(rows) == 603 and accuracy > 0.97 and out[600].predicted == out[601].predicted == out[602].predicted == 0
    assert len(toxicity.classify(docs, labels.limit(0)).collect()) == 603
    assert toxicity.classify(docs.limit(0), labels.limit(0)).count() == 0


def words(text):
    return re.findall(r"[0-9a-zß-öø-ÿ]+", (text or "").lower())


def test_decontamination(spark):
    rng = random.Random(2)
    items = [prose(rng, n, 0.3) for n in (6, 12, 20, 30, 45, 60, 35, 25)]
    host = [prose(rng, rng.randrange(5, 400)) for _ in range(250)]
    texts, planted = list(host), []
    for k, item in enumerate(items):
        for kind in range(3):
            w = item.split()
            if kind == 1 and len(w) >= 12:
                w = [x for i, x in enumerate(w) if i % 9]
            if kind == 2 and len(w) >= 12:
                w = [x if i % 9 else "other" for i, x in enumerate(w)]
            base = rng.choice(host).split()
            at = rng.randrange(len(base) + 1)
            planted.append((len(texts), k))
            texts.append(" ".join(base[:at] + w + base[at:]))
    texts += [None, "", "...", "tail " * 60_000]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(90, None), (91, ""), (92, "!!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find(frame(spark, texts), bench).collect()}
    exact = {p for i, p in enumerate(planted) if i % 3 == 0 and len(items[p[1]].split()) >= 12}
    assert exact <= got and len(got & set(planted)) >= 0.9 * len(planted) and not got - set(planted)
    assert decontam.find(frame(spark, texts), bench.where("item_id > 80")).count() == 0
    assert decontam.find(frame(spark, []), bench).count() == 0


def test_decontamination_of_items_in_many_documents(spark):
    rng = random.Random(7)
    often, seldom, plain = prose(rng, 40, 0.2), prose(rng, 30, 0.2), " ".join(SYLLABLES[:12])
    short = " ".join(SYLLABLES[5:11])
    texts, planted = [prose(rng, rng.randrange(20, 120)) for _ in range(300)], set()
    for i in range(len(texts)):
        base = texts[i].split()
        if i % 3 == 0:
            w = [x for j, x in enumerate(often.split()) if i % 2 or j % 7]
            base[len(base) // 2 : len(base) // 2] = w
            planted.add((i, 0))
        if i in (4, 7):
            base += [seldom, plain, short][:: 1 if i == 4 else -1]
            planted |= {(i, 1), (i, 2), (i, 3)}
        texts[i] = " ".join(base)
    bench = spark.createDataFrame(list(enumerate([often, seldom, plain, short])), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find(frame(spark, texts), bench).collect()}
    count, passages = decontam.counted(frame(spark, texts).select("text"))
    assert (decontam.weights(count, passages) > 0).all() and planted <= got
    latent = {(r.doc_id, r.item_id) for r in decontam.find(frame(spark, texts), bench).where("latent").collect()}
    assert len(latent & planted) >= 0.5 * len(planted)  # the exact way has all of them
    kept = decontam.clean(frame(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(300)) - {d for d, _ in got} and kept.columns == frame(spark, []).columns
    assert {p for p in got if p[1] in (0, 1)} == {p for p in planted if p[1] in (0, 1)}


def test_decontamination_against_all_pairs(spark):
    """Every document with every item: the subsequence and answer checks at every place, without a candidate search."""
    rng = random.Random(21)
    items = [prose(rng, rng.choice([5, 9, 14, 25, 40]), 0.5) for _ in range(12)]
    texts = []
    for k in range(120):
        base, item = prose(rng, rng.randrange(0, 120), 0.5).split(), rng.choice(items).split()
        kept = [x for x in item if rng.random() > (k % 6) * 0.08]
        at = rng.randrange(len(base) + 1)
        texts.append(" ".join(base[:at] + kept + base[at:]))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    def leaks(item, part):
        n, answer = len(item), item[-max(3, len(item) // 4) :]
        if len(set(item) & set(part)) < decontam.LCS_LIKELY * len(set(item)):
            return False
        if n < decontam.SHORT:
            return any(part[i : i + n] == item for i in range(len(part) - n + 1))
        share = lcs(item, part) / n
        return share >= decontam.LCS_SURE or share >= decontam.LCS_LIKELY and lcs(answer, part) >= decontam.ANSWER_SHARE * len(answer)

    must, may = set(), set()
    for d, text in enumerate(map(words, texts)):
        for i, item in enumerate(map(words, items)):
            n = len(item)
            if any(leaks(item, text[a : a + n + 8]) for a in range(max(1, len(text) - n - 7))):
                must.add((d, i))
            if any(leaks(item, text[max(0, a - n - 8) : a + decontam.PASSAGE + n + 8]) for a in range(0, len(text), decontam.STEP)):
                may.add((d, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find(frame(spark, texts).withColumnRenamed("source", "item_id"), bench).collect()}
    assert len(must) > 60 and must <= got <= may


def test_classifiers_with_clashing_columns_and_long_runs(spark, corpus):
    docs, labels, _ = corpus
    run = "a1" * 250_000 + "@" * 250_000 + "b" * 250_000
    more = docs.union(spark.createDataFrame([(9000, run, "en", "s", 0), (9001, "u r an i d i o t you 1d10t", "en", "s", 0)], DOC))
    odd = more.selectExpr("doc_id", "text", "lang AS y", "source AS score", "n_chars AS votes", "1 AS half", "2 AS pattern", "3 AS difference")
    began = time.monotonic()
    toxic = {r.doc_id: r for r in toxicity.classify(odd, labels).collect()}
    assert len(toxic) == 605 and time.monotonic() - began < 60
    assert len(quality.classify(odd, labels).collect()) == 605
    p = toxicity.Piece(toxicity.pa.array(["x 1d10t, i d.i o t b", "1d10t", "0a 12 b3", "a1b2c"]))
    assert p.disguised() == (["idiot", "idiot", "idiot", "idiot", "aibzc", "aibzc"], [0, 0, 1, 1, 3, 3]) or p.disguised()[1] == [0, 0, 1, 1, 3, 3]
    assert p.spaced() == (["idiotb"], [0])


def plain_votes(text, lexicon):
    """The voters one by one, on strings; lexicon: kind -> {entry: times}."""
    found = [(m.start(), "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" else c for c in m[0])) for m in re.finditer("[0-9A-Za-zÀ-῿₀-⿿぀-\U0010ffff]+", text)]
    ws = [w for _, w in found]
    level = lambda n, some=1, much=2: (n >= some) + (n >= much)
    tells = lambda w: w in toxicity.INSULTS or w in lexicon[0]
    begun = []
    for k in toxicity.BEGINNINGS:
        n = {}
        for w in ws:
            if len(w) > k:
                n[w[:k]] = n.get(w[:k], 0) + 1
        begun.append([len(w) > k and n[w[:k]] >= lexicon[k].get(w[:k], 10**9) for w in ws])
    insult, own = [w in toxicity.INSULTS for w in ws], [w in lexicon[0] for w in ws]
    half = [o and int(h) & 1 for o, h in zip(own, toxicity.hashes(ws), strict=True)]
    at = [i for i in range(len(ws)) if insult[i] or own[i] or any(b[i] for b in begun)]
    runs = [m[0] for m in re.finditer(r"[A-Za-z0-9@$!|]+", text) if re.search(r"[A-Za-z][0-9@$!|]+[A-Za-z]", m[0])]
    plain = [r.translate(toxicity.DISGUISE).lower() for r in runs]
    masked = sum(tells(p) for p in plain) + sum(tells(p.rstrip("i")) for p in plain)
    spaced, i = 0, 0
    while i < len(ws):
        j = i
        while j + 1 < len(ws) and len(ws[j]) == len(ws[j + 1]) == 1 and found[j + 1][0] == found[j][0] + 2 and text[found[j][0] + 1] in " .*_-":
            j += 1
        spaced += j - i >= 3 and tells("".join(ws[i : j + 1]))
        i = j + 1
    loud = len(ws) > 0 and text.count("!") * 20 >= len(ws)
    return [level(sum(insult)), level(sum(map(bool, half))), level(sum(own) - sum(map(bool, half))), *(level(sum(b)) for b in begun), level(masked), level(spaced),
            level(len(at) / max(20, len(ws)), 0.002, 0.01), level(sum(b - a <= 40 for a, b in zip(at, at[1:]))), level(sum(i > 0 and ws[i - 1] in toxicity.YOU for i in at)),
            level(sum("A" <= c <= "Z" for c in text) / max(1, len(text)), 0.3, 0.6) if loud else 0]


def test_votes_against_plain_ones():
    rng = random.Random(5)
    lexicon = {0: {"zorkly": 1, "ünfug": 1, "w1": 1}, 4: {"bela": 2, "éaéa": 1}, 5: {"stoll": 1}, 6: {"ßtraße"[:6]: 1}}
    hashed = {k: {int(toxicity.hashes([w]).view("int64")[0]): n for w, n in v.items()} for k, v in lexicon.items()}
    parts = ["zorkly", "ünfug", "Ünfug", "w1", "belast", "BELANG", "éaéaéa", "stoll", "stolles", "idiot", "you", "YOU", "i d i o t", "i.d-i*o_t", "1d10t", "z0rkly", "idiot!",
             "ab1", "1ab", "a@b", "the", "word", ",", "!", "!!", "x y", "ßtraßen", "s c u m x", "漢", "\n"]
    texts = ["", None, "!", "idiot", "1d10t"] + [rng.choice([" ", " ", "  ", "-"]).join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    got = toxicity.Lexicon(hashed).votes(toxicity.Piece(toxicity.pa.array(texts)))
    for row, t in zip(got.tolist(), texts, strict=True):
        assert row == [int(x) for x in plain_votes(t or "", lexicon)], t


def test_toxicity_ignores_held_out_labels(spark, corpus):
    docs, labels, _ = corpus
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 3) = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.classify(docs, flipped).collect()}
    gone = {r.doc_id for r in toxicity.classify(docs, labels).where("predicted = 1").collect()}
    kept = toxicity.clean(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i in a} - gone and kept.columns == docs.columns and gone


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs(decontam.masks(a), len(a), b) == t[-1][-1]


def test_pipeline(spark, corpus, tmp_path):
    docs, labels, _ = corpus
    rng = random.Random(4)
    item = prose(rng, 30, 0.2)
    extra = [(1000, "a copy of some words that is kept once", "en", "s", 38), (1001, "a copy of some words that is kept once", "en", "s", 38),
             (1002, prose(rng, 40) + " " + item, "en", "s", 0), (1003, prose(rng, 40) + " a@b.cd", "en", "s", 0)]
    all_docs = docs.unionByName(spark.createDataFrame(extra, DOC))
    all_docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in stage.collect()}
        f(spark, stage, str(tmp_path)).write.parquet(str(tmp_path / name))
        after_df = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in after_df.collect()}
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.classify(stage, labels).where("predicted = 1").collect()}
            assert set(after) == set(before) - bad and bad
        if name == "near_duplicates":
            kept = {r.doc_id for r in jaccard_join.join(stage).where("kept").collect()}
            assert set(after) == kept and 1000 in after and 1001 not in after
        if name == "benchmark_decontamination":
            assert set(before) - set(after) == {1002}
        if name == "pii":
            assert set(after) == set(before) and after[1003].text.endswith("<EMAIL>") and after[1003].n_chars == len(after[1003].text)
            assert all(after[i] == before[i] for i in after if "@" not in (before[i].text or ""))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after_df.columns == stage.columns
        stage = after_df
        seen.append(len(after))
    whole = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {tuple(r) for r in stage.collect()} and len(whole) == seen[-1]
    assert pii.detect(docs.limit(0)).count() == 0


def test_pipeline_with_null_and_repeated_ids(spark, corpus, tmp_path):
    docs, labels, _ = corpus
    rng = random.Random(6)
    item, twin, bad = prose(rng, 30, 0.2), prose(rng, 40), prose(rng, 20) + " idiot scum zorkly zorkum idiot scum"
    single, leak, mail, other = prose(rng, 40), prose(rng, 40) + " " + item, "write a@b.cd " + prose(rng, 9), prose(rng, 20) + " to e@f.gh now"
    extra = [(None, bad), (None, twin), (2000, twin), (None, leak), (2001, leak), (2001, single), (None, mail), (2002, mail + " x"), (2002, other),
             (2003, twin), (2003, prose(rng, 50))]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in extra], DOC)
    docs.unionByName(rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def run(stage):
        out = stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()
        return sorted((r.doc_id or 0, r.text) for r in out if r.doc_id is None or r.doc_id >= 2000)

    given = sorted((i or 0, t) for i, t in extra)
    assert (0, bad) not in run(corpus_pipeline.toxic)
    near = run(corpus_pipeline.near_duplicates)
    assert (2000, twin) in near and sum(t == twin for _, t in near) == 1 and (2003, extra[-1][1]) in near and (2001, single) in near
    assert sum(t == leak for _, t in near) == 1
    assert run(corpus_pipeline.benchmark_passages) == [x for x in given if x[1] != leak]
    hidden = lambda t: t.replace("a@b.cd", "<EMAIL>").replace("e@f.gh", "<EMAIL>")
    assert run(corpus_pipeline.personal_data) == sorted((i, hidden(t)) for i, t in given)


def test_quality_score_is_the_calibrated_difference(spark, corpus):
    import zstandard

    docs, labels, _ = corpus
    made = quality.dictionaries(docs, labels.where("quality IS NOT NULL").selectExpr("doc_id", "quality AS y"))
    size = [
        zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(made[y]), level=quality.LEVEL, write_content_size=False, write_dict_id=False) for y in (0, 1)
    ]
    got = {r.doc_id: r.difference for r in quality.differences(docs, made).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        parts = -(-len(raw) // quality.CHUNK)
        step = -(-len(raw) // parts) if parts else 1
        cut = [raw[i : i + step] for i in range(0, len(raw), step)]
        plain = sum(len(size[0].compress(p)) - len(size[0].compress(b"")) - len(size[1].compress(p)) + len(size[1].compress(b"")) for p in cut)
        assert got[r.doc_id] == pytest.approx(plain / len(raw) if raw else 0.0, abs=0.05)
    # One logistic curve of the difference gives every score, and a larger difference a larger score.
    rows = sorted(quality.classify(docs, labels).collect(), key=lambda r: r.difference)
    x, odds = [np.arcsinh(quality.SCALE * r.difference) for r in rows], [np.log(r.score / (1 - r.score)) for r in rows]
    line = np.polyfit(x, odds, 1)
    assert line[0] > 0 and np.abs(np.polyval(line, x) - odds).max() < 1e-6


def test_quality_with_too_few_samples_for_a_dictionary(spark):
    rows = [(i, ("good words of prose here " if i % 2 else "x9 zz qq 77 ") * 6) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(24)], "doc_id long, quality int, toxic int")
    made = quality.dictionaries(docs, labels.selectExpr("doc_id", "quality AS y"))
    assert b"good words of prose" in made[1] and b"zz qq 77" in made[0]
    rows = quality.classify(docs, labels).collect()
    assert min(r.score for r in rows if r.doc_id % 2) > max(r.score for r in rows if r.doc_id % 2 == 0)
