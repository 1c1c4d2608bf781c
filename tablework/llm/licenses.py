"""Known licences among texts, by digests of their canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm.common import UPPER, clear_names

# The wording of public licences, without their copyright lines.
_WARRANTY = """\
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """\
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """\
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """\
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_HEAD = """\
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_TAIL = """\
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
LICENSES = {
    "MIT": """\
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
""" + _WARRANTY,
    "ISC": _ISC_HEAD + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL,
    "0BSD": _ISC_HEAD + ".\n" + _ISC_TAIL,
    "BSD-2-Clause": "\n".join([_BSD_HEAD, _BSD_TAIL]),
    "BSD-3-Clause": "\n".join([_BSD_HEAD, _BSD_NAME, _BSD_TAIL]),
    "Zlib": """\
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
#: Titles that copies of these licences usually begin with.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License", "MIT License (Expat)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD (0BSD)",
             "0BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "2-Clause BSD License", "Simplified BSD License",
                     "The Simplified BSD License", 'BSD 2-Clause "Simplified" License', "FreeBSD License", "BSD License", "The BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", "New BSD License",
                     "The New BSD License", "Modified BSD License", "Revised BSD License", 'BSD 3-Clause "New" or "Revised" License', "BSD License",
                     "The BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "zlib License (Zlib)"],
}
#: Other entire texts: notices of one line, and below the licences with a title.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.",
                     "Licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
}
NOTICES |= {k: NOTICES.get(k, []) + [f"{title}\n{LICENSES[k]}" for title in titles] for k, titles in TITLES.items()}
#: Entire texts known by the SHA-256 of their canonical form alone. Fixed values, of the licence files as their publishers have them.
DIGESTS = {
    "Apache-2.0": "adf220ee02537f83220e088f4488ca0e7557d614fac1cc48967b41d13911d6e0",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    "GFDL-1.3": "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "5fc5b48e8eeed6e5e77c32ad8641a6bc04d25011d6b500aa7dc7f3183ab812ea",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6",
    "MPL-2.0": "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
}
#: Spellings that count as one, applied to whole words in this order; words stand two blanks apart.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub  license", "sublicense"),
    ("non  infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("https", "http"), ("organisation", "organization"),
    ("favour", "favor"), ("copyright  owner", "copyright  holder"), ("copyright  owners", "copyright  holders"),
]
#: Words after "copyright" that make a line part of a sentence, as where a licence is wrapped, and not the name of an owner.
NO_NAMES = ["and", "in", "interest", "interests", "is", "law", "laws", "license", "licenses", "licence", "licences", "notice", "notices", "of", "or",
            "holder", "holders", "owner", "owners", "protection", "statement"]


def name_start(words: list[str]) -> str:
    """Pattern of the start of a lower-case name whose first word is none of ``words``; RE2 has no look-ahead."""
    parts = []
    for head in sorted({w[:i] for w in words for i in range(len(w) + 1)}):
        after = "".join(sorted({w[len(head)] for w in words if w.startswith(head) and len(w) > len(head)}))
        if not head:  # a letter, a digit, other than ASCII, or the bracket of a placeholder
            parts.append(rf"[^\x00-\x2F\x3A-\x3B\x3D-\x5A\x5C-\x60\x7C-\x7F{after}]")
        elif head in words:
            parts.append(rf"{head}[^\x00-\x60\x7B-\x7F{after}]")
        else:
            parts.append(rf"{head}([^\n{after}]|\b)")
    return "(" + "|".join(parts) + ")"


#: Lines that name an owner and vary between copies of a licence.
OWNER_LINE = r"(^|\n)[ \t]*(copyright[ \t]*(\(c\)|©|[0-9])|copyright[ \t]*[: \t][ \t]*" + name_start(NO_NAMES) + r"|\(c\)|©|all rights reserved)[^\n]*"
#: What isn't part of a word: ASCII but letters, digits and the line end, and typographic marks.
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F‘’“”–—•]+"


def canonical_lines(text: Column) -> Column:
    """The text in canonical form, its lines still apart: A-Z in lower case, owner lines gone, words separated by one blank."""
    text = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    text = F.regexp_replace(F.regexp_replace(text, OWNER_LINE, "$1"), PUNCTUATION, "  ")
    # two blanks between words, so that words next to each other can both be replaced
    text = F.regexp_replace(F.concat(F.lit("  "), text, F.lit("  ")), r" *\n[ \n]*", "  \n  ")
    for variant, usual in SPELLINGS:
        text = F.replace(text, F.lit(f" {variant} "), F.lit(f" {usual} "))
    return F.replace(text, F.lit("  "), F.lit(" "))


def canonical(lines: Column) -> Column:
    """Canonical lines as one line."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the licences and notices above."""
    return spark.createDataFrame([(k, t) for k, t in LICENSES.items()] + [(k, t) for k, ts in NOTICES.items() for t in ts],
                                 "license_id string, text string")


def known_digests(spark: SparkSession) -> DataFrame:
    """(license_id, sha) of the entire texts known by digest alone."""
    return spark.createDataFrame(list(DIGESTS.items()), "license_id string, sha string")


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: id, canonical_sha256, license_id, notices.

    ``known(license_id, text)`` are entire licence texts, ``digests(license_id, sha)`` further ones as digests of their canonical form. A document whose entire text is one of them in
    canonical form has its ``license_id``; ``notices`` are the licences whose entire text is one line of the
    document, sorted, each once. Both are hash-joins by SHA-256 of the canonical form, in which case,
    punctuation, white space, owner lines and the listed spellings don't count; a longer text that quotes a
    licence doesn't match. Of several licences of one canonical form the first by code point counts.

    Null and empty texts are the empty canonical text, which matches nothing, as do known texts without words. Null ids pass
    through. Rows of one id are told apart by a hash of their text, so a notice of one is never found in another. Other columns are not read.
    """
    shas = known.select("license_id", canonical(canonical_lines(F.col("text"))).alias("_c")).where("_c != ''") \
        .select("license_id", F.sha2("_c", 256).alias("_sha"))
    if digests is not None:
        shas = shas.unionByName(digests.select("license_id", F.col("sha").alias("_sha")))
    shas = shas.groupBy("_sha").agg(F.min("license_id").alias("license_id"))
    rows = clear_names(docs, id_col, text_col).toDF("_id", "_text") \
        .select("_id", F.struct(F.xxhash64("_text"), F.char_length("_text")).alias("_t"), canonical_lines(F.col("_text")).alias("_lines"))
    parts = F.transform(F.split("_lines", "\n"), lambda x: F.trim(x))
    # one element for the entire text, then one per line with words
    units = F.concat(F.array(F.struct(F.lit(True).alias("whole"), canonical(F.col("_lines")).alias("c"))),
                     F.transform(F.array_distinct(F.filter(parts, lambda x: x != "")), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("c"))))
    hashed = rows.select("_id", "_t", F.transform(units, lambda u: F.struct(u["whole"].alias("whole"), F.sha2(u["c"], 256).alias("sha"))).alias("_units"))
    by_row = hashed.select("_id", "_t", F.get("_units", F.lit(0))["sha"].alias("_own"), F.explode_outer("_units").alias("_u")) \
        .select("_id", "_t", "_own", "_u.whole", F.col("_u.sha").alias("_sha"))
    found = by_row.join(shas, "_sha", "left").groupBy("_id", "_t", "_own").agg(
        F.min(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))).alias("_set"),
        F.sum(F.col("whole").cast("long")).alias("_copies"))
    return found.select(F.explode(F.sequence(F.lit(1), F.col("_copies"))), "*").select(
        F.col("_id").alias(id_col), F.col("_own").alias("canonical_sha256"), "license_id", F.array_join("_set", ",").alias("notices"))
