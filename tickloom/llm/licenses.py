"""License scan by canonical digests, with DataFrame functions only.

A text is lower-cased, everything but letters, digits and line ends becomes a blank, and variant spellings become one.
Its lines without the copyright lines, joined, are its canonical form; the SHA-256 of that is joined to the digests of
known license texts (whole texts here, digests alone for long licenses), so that a whole text matches whatever its layout, case, year or holder. Lines that are known short
notices are named beside that.

Defined results: a null text counts as empty; an empty canonical form has the digest of the empty string and no license;
repeated rows repeat; whole texts of any length are taken; extra columns are ignored; an empty table stays empty.
The table of known texts is a constant of this module (or the caller's list of at most MOST texts), so it is broadcast; a
caller's DataFrame of digests is joined as Spark sees fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 10_000

# Spellings that count as equal, after punctuation has gone.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("whilst", "while"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
)
#: A canonical line that names a year or holder only.
COPYRIGHT_LINE = r"^(copyright )?(c )?((19|20)[0-9][0-9]|year|yyyy)( |$)|^copyright c( |$)|^all rights reserved$"

# Short notices, by license.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LicenseRef-reserved", "All rights reserved."),
    ("MIT", "Released under the MIT License."),
)

_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_ZLIB = """zlib License

Copyright (c) year holder

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR
ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Copyright (C) 2004 Sam Hocevar <sam@hocevar.net>

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed
as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""
# License texts.
TEXTS = (
    ("MIT", f"MIT License\n\nCopyright (c) year holder\n\n{_GRANT}\n\nThe above copyright notice and this permission notice shall be included in all copies or\nsubstantial portions of the Software.\n\n{_MIT_END}"),
    ("MIT-0", f"MIT No Attribution\n\nCopyright (c) year holder\n\n{_GRANT.replace(', subject to the following conditions:', '.')}\n\n{_MIT_END}"),
    ("ISC", f"ISC License\n\nCopyright (c) year holder\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"BSD Zero Clause License\n\nCopyright (c) year holder\n\n{_ISC_GRANT}.\n\n{_ISC_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\nCopyright (c) year, holder\n\n{_BSD}{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) year, holder\n\n{_BSD}{_BSD_3}{_BSD_END}"),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("WTFPL", _WTFPL),
    *((name, text) for name, text in NOTICES if name != "LicenseRef-reserved"),
)
#: Canonical digests of long licenses, from the copies in /usr/share/common-licenses; Apache-2.0 with and without its appendix.
DIGESTS = (
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
)


def canonical_lines(text: Column) -> Column:
    """The text's canonical lines, without empty ones, as an array."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    for variant, usual in SPELLINGS:
        t = F.replace(t, F.lit(variant), F.lit(usual))
    return F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def canonical(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(COPYRIGHT_LINE)), " ")


def known(spark, texts=TEXTS) -> DataFrame:
    """digest, license_id of the known texts, and of DIGESTS beside this module's own: a constant table.

    A DataFrame of digests is taken as it is, of any size.
    """
    if isinstance(texts, DataFrame):
        return texts.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    if len(texts) > MOST:
        raise ValueError(f"more than {MOST} known texts; give them as a DataFrame of (digest, license_id)")
    rows = spark.createDataFrame(list(texts), "license_id string, text string")
    digest = F.sha2(canonical(canonical_lines(F.col("text"))).cast("binary"), 256)
    rows = rows.select(digest.alias("digest"), "license_id")
    if texts is TEXTS:
        rows = rows.unionByName(spark.createDataFrame(list(DIGESTS), "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def canonical_notices(spark) -> list[tuple[str, str]]:
    """The notices in canonical form, in order."""
    rows = spark.createDataFrame(list(NOTICES), "license_id string, text string")
    found = rows.select("license_id", F.array_join(canonical_lines(F.col("text")), " ").alias("line")).collect()
    return [(r.license_id, r.line) for r in found]


def scan(docs: DataFrame, texts=TEXTS) -> DataFrame:
    """doc_id, digest, license_id (null where none), notices (ids of notice lines, in order, comma-joined)."""
    spark = docs.sparkSession
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    names = canonical_notices(spark)
    notices = F.array_compact(
        F.array(*[F.when(F.array_contains("lines", line), F.lit(name)) for name, line in names])
    )
    digests = lines.select(
        "doc_id",
        F.sha2(canonical(F.col("lines")).cast("binary"), 256).alias("digest"),
        F.array_join(notices, ",").alias("notices"),
    )
    licenses = known(spark, texts)
    licenses = licenses if isinstance(texts, DataFrame) else F.broadcast(licenses)
    return digests.join(licenses, "digest", "left").select(
        "doc_id", "digest", "license_id", "notices"
    )


def sql() -> str:
    """DuckDB SQL for ``scan`` over documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    clean = r"regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\n]+', ' ', 'g')"
    for variant, usual in SPELLINGS:
        clean = f"replace({clean}, {quote(variant)}, {quote(usual)})"
    values = lambda rows: ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows)
    lines = f"list_filter(list_transform(string_split({clean}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    whole = f"sha256(array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, {quote(COPYRIGHT_LINE)})), ' '))"
    flags = ", ".join(
        f"CASE WHEN list_contains(lines, (SELECT lines[1] FROM n WHERE id = {quote(name)})) THEN {quote(name)} END"
        for name, _ in NOTICES
    )
    return f"""
        WITH k AS (SELECT min(id) AS license_id, {whole} AS digest FROM
                   (SELECT id, {lines} AS lines FROM (VALUES {values(TEXTS)}) t(id, text)) GROUP BY digest),
             n AS (SELECT id, {lines} AS lines FROM (VALUES {values(NOTICES)}) t(id, text)),
             d AS (SELECT doc_id, {lines} AS lines FROM documents),
             e AS (SELECT doc_id, {whole} AS digest,
                          coalesce(array_to_string(list_filter([{flags}], lambda x: x IS NOT NULL), ','), '') AS notices FROM d)
        SELECT e.doc_id, e.digest, k.license_id, e.notices FROM e LEFT JOIN k USING (digest)
    """
