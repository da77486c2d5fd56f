"""License scan: layouts of known texts, notices, and the empty cases."""

from __future__ import annotations

from pathlib import Path

import pytest

from tickloom.llm import licenses


def test_variants_of_whole_texts(spark):
    texts = dict(reversed(licenses.TEXTS))
    mit = texts["MIT"].replace("year holder", "2019 Some Body").upper().replace("LICENSE", "LICENCE").replace("\n", " \r\n")
    rows = [
        (0, mit), (1, texts["BSD-3-Clause"].replace("\n", "\n\n").replace(",", "")), (2, texts["ISC"] + " extra"), (3, None),
        (4, ""), (5, "© 2020 A\n" + texts["0BSD"]), (6, "word " * 50_000), (7, "intro\nAll Rights Reserved\nreleased under the MIT licence"),
        (7, "intro\nAll Rights Reserved\nreleased under the MIT licence"), (8, "Licensed under CC BY-NC 4.0"),
    ]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, digest string, lines string")
    got = sorted((r.doc_id, r.license_id, r.notices) for r in licenses.scan(docs).collect() if r.doc_id != 8)
    assert got == [
        (0, "MIT", ""), (1, "BSD-3-Clause", ""), (2, None, ""), (3, None, ""), (4, None, ""), (5, "0BSD", ""), (6, None, ""),
        (7, None, "LicenseRef-reserved,MIT"), (7, None, "LicenseRef-reserved,MIT"),
    ]
    assert licenses.scan(docs).where("doc_id = 8").first().license_id == "CC-BY-NC-4.0"
    assert licenses.scan(docs.limit(0)).count() == 0


def test_whole_texts_of_long_licenses(spark):
    folder = Path("/usr/share/common-licenses")
    want = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1",
            "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    if not all((folder / f).exists() for f in want):
        pytest.skip("license texts aren't installed")
    texts = {f: (folder / f).read_text() for f in want}
    apache = texts["Apache-2.0"].split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS"
    rows = [(f, t.upper().replace("\n", " \r\n")) for f, t in texts.items()] + [("terms", apache), ("more", texts["GPL-3"] + "more")]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {**want, "terms": "Apache-2.0", "more": None}
    own = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string"), (("X", apache),)).where("license_id is not null")
    assert [(r.doc_id, r.license_id) for r in own.collect()] == [("terms", "X")]


def test_every_known_text_and_a_table_of_digests(spark):
    docs = spark.createDataFrame([(i, t.upper()) for i, (_, t) in enumerate(licenses.TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs).collect()}
    assert got == {i: name for i, (name, _) in enumerate(licenses.TEXTS)}
    digests = licenses.scan(docs).where("license_id = 'Zlib'").selectExpr("digest", "'own' AS license_id")
    assert licenses.scan(docs, digests).where("license_id = 'own'").count() == 1
