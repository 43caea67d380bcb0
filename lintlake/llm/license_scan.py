"""Licence scan by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form: lower case, no copyright lines and no title, no punctuation,
comment marks or line breaks, and one spelling for equivalent words. The digest of the whole form is
joined to the digests of known licence texts: those below and those in the folder ``licenses``.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.scratch import documents, text_or_empty

#: A statement that names a copyright holder: to the end of its line or sentence, which differ between copies.
COPYRIGHT = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:(?:copyright|\(c\)|©)[ \t:]*(?:\(c\)|©|[0-9]{4}|<|\[|\{|by |the regents)[^\n]*?(?:[^ \t\n.]{2}\.[ \t]|$)"
    r"|all rights reserved[^\p{L}\n]*$)"
)
# Names of licences as headings have them, before the word "license".
NAMES = (
    "mit", "mit open source", "expat", "isc", "isc open source", "apache", "apache software", "artistic", "zlib",
    "bsd", "0bsd", "bsd zero clause", "zero-clause bsd", "bsd 2-clause", "bsd 3-clause", "2-clause bsd", "3-clause bsd",
    "simplified bsd", "new bsd", "modified bsd", "mozilla public", "gnu general public", "gnu lesser general public",
    "gnu library general public", "gnu affero general public", "gnu free documentation",
)
#: A first line that is the title of a known licence and nothing else; other lines that speak of a license stay.
TITLE = (
    r"\A[^\p{L}\p{N}]*(?:the )?(?:" + "|".join(NAMES) + r") licen[cs]e(?:,? version [0-9.]+)?(?: \((?:mit|expat|isc|bsd)\))?"
    r"[^\p{L}\p{N}\n]*\n"
)
#: Behind this, some licences say how to apply them, which copies often leave out.
END = "END OF TERMS AND CONDITIONS"
# Spellings that count as the same word, once there is no punctuation.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("merchantibility", "merchantability"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
)
# Short texts of well known licences and licence notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
}


_THIRD_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED"""


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of every known text; long ones also without what stands behind their terms."""
    rows = list(KNOWN.items())
    rows.append(("BSD-3-Clause", KNOWN["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED", _THIRD_CLAUSE, 1)))
    for file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        rows.append((file.stem, text))
        if END in text:
            rows.append((file.stem, text.split(END)[0] + END))
    return rows


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    out = F.regexp_replace(out, TITLE, " ")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def canonical_text(text: str) -> str:
    """The same form in plain Python."""
    import regex

    out = regex.sub(TITLE, " ", regex.sub(COPYRIGHT, " ", text.lower()))
    out = regex.sub(r"[^\p{L}\p{N}]+", " ", out).strip(" ")
    for old, new in SPELLINGS:
        out = out.replace(old, new)
    return out


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license, license_digest: one row per distinct canonical text (the first name in order stays)."""
    rows = spark.createDataFrame(known or known_texts(), "license string, text string")
    return rows.groupBy(F.sha2(canonical(F.col("text")), 256).alias("license_digest")).agg(
        F.min("license").alias("license")
    )


def scan(spark: SparkSession, docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per input row: doc_id, digest, license (null: the text is none of the known ones).

    Copyright statements of any length end with their line or sentence; a first line goes only if it is the
    title of a known licence as a whole. Equivalent spellings are replaced inside longer words too.

    Null texts count as empty; a text without letters or digits has the digest of the empty form and
    no licence. A null ``doc_id`` stays, repeated rows stay, an empty table gives no rows, further
    columns are ignored. The list of known texts is fixed (under 40) and its digests are broadcast.
    """
    form = canonical(text_or_empty())
    rows = docs.select("doc_id", F.sha2(form, 256).alias("digest"))
    table = known_digests(spark, known)
    found = rows.join(F.broadcast(table), F.col("digest") == F.col("license_digest"), "left")
    return found.select("doc_id", "digest", "license")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, documents(spark, sf_dir))


def varied() -> list[tuple[int, str, str | None]]:
    """(id, text, licence): known texts as copies have them; the forms of ``others`` say more and are none of them."""
    import regex

    titled = regex.compile(TITLE)
    holders = ", ".join(f"Holder {chr(65 + i)} of Works" for i in range(12))
    forms = (
        lambda t: t.upper(),
        lambda t: ("" if titled.match(t.lower()) else "The MIT Licence\n\n") + "Copyright (c) 2019-2021 A. Person <a@b.c>\nAll rights reserved.\n\n" + t,
        lambda t: "\n".join(f" * {line}" for line in t.split("\n")),
        lambda t: t.replace("license", "licence").replace("sublicense", "sub-license"),
        lambda t: t.replace("\n", "\r\n") if regex.search("license|rights reserved", t.lower()[:200]) else "  ".join(t.split("\n")),
        lambda t: f"Copyright (c) 1999-2024 {holders}\n{t}",
    )
    others = (
        lambda t: t + " indeed",
        lambda t: "Proprietary. No license is granted to anyone.\n" + t,
        lambda t: "Not licensed under the MIT License\n\n" + t,
    )
    first = {hashlib.sha256(canonical_text(t).encode()).hexdigest(): name for name, t in sorted(known_texts(), reverse=True)}
    rows = []
    for name, text in known_texts():
        for form in (*forms, *others):
            stays = first[hashlib.sha256(canonical_text(text).encode()).hexdigest()] if form in forms else None
            rows.append((-1 - len(rows), form(text), stays))
    return rows


def variants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and, beside them, the known texts in varied form."""
    rows = spark.createDataFrame([(i, t) for i, t, _ in varied()], "doc_id long, text string")
    return scan(spark, documents(spark, sf_dir).select("doc_id", "text").unionByName(rows)).select("doc_id", "license")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_form(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT)}, ' ', 'g')"
    out = f"regexp_replace({out}, {_quoted(TITLE)}, ' ')"
    out = rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return out


#: The digests of known texts are those of the form in plain Python, the documents' those of the form in SQL.
_VALUES = ", ".join(
    f"('{name}', '{hashlib.sha256(canonical_text(text).encode()).hexdigest()}')" for name, text in known_texts()
)
SQL = f"""
with known as (select license_digest, min(license) as license from (values {_VALUES}) as t(license, license_digest) group by 1),
d as (select doc_id, sha256({_sql_form("coalesce(text, '')")}) as digest from documents)
select doc_id, digest, license from d left join known on digest = license_digest
"""
_FORMS = ", ".join(f"({i}, {_quoted(name) if name else 'null'})" for i, _, name in varied())
VARIANTS_SQL = f"""
with found as ({SQL}) select doc_id, license from found
union all select * from (values {_FORMS}) as t(doc_id, license)
"""
