"""Licence texts, known by the digest of their canonical form.

Case, punctuation, white space, copyright lines and spellings that mean the same are taken out of a text; what is left is hashed as a
whole and joined to the digests of known licences. All of it is column code.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Owners and templates that stand in licences themselves, taken out wherever a line break is.
OWN_COPYRIGHT = (
    r"copyright[ \t\n]+(?:\(c\)[ \t\n]+(?:[0-9][0-9, \t\n-]*[ \t\n]+free[ \t\n]+software[ \t\n]+foundation,?[ \t\n]+inc\.(?:[ \t\n]+<?https?://(?:www\.)?fsf\.org/?>?)?"
    r"|(?:<year>|year|19yy|19xx)[ \t\n]+(?:<?name[ \t\n]+of[ \t\n]+author>?|your[ \t\n]+name\.?)"
    r"|[_ \t\n]+\.[ \t\n]+all[ \t\n]+rights[ \t\n]+reserved\.?)"
    r"|\[yyyy\][ \t\n]+\[name[ \t\n]+of[ \t\n]+copyright[ \t\n]+owner\])"
)
#: What a copyright line begins with: the word with a sign, a year or a place for one. The word alone may begin any line of terms.
_MARK = r"(?:copyright[ \t]*(?::[ \t]*)?(?:\(c\)|©|<?[0-9]{4}|\[)|\(c\)[ \t]*[0-9]{4}|©)"
_RESERVED = r"all[ \t\n]+rights[ \t\n]+reserved"
#: Lines that name an owner, without their line break; one that is wrapped goes as far as "all rights reserved" within two more lines.
COPYRIGHT_LINE = rf"^[ \t*#/;-]*(?:{_MARK}(?:[^\n]*(?:\n[^\n]+?){{0,2}}?\b{_RESERVED}\b|[^\n]*$)|all[ \t]+rights[ \t]+reserved[. \t]*$)"
#: All ASCII but letters, digits and line breaks, and quotation marks and dashes of print.
PUNCTUATION = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F‘’“”«»–—…]+"
#: Spellings that mean the same, as (pattern within blanks, what it becomes).
SPELLINGS = [
    ("licen[cs]e(d|s)?", "license$1"), ("favour", "favor"), ("honour", "honor"), ("behaviour", "behavior"), ("organisation", "organization"), ("non commercial", "noncommercial"),
    ("per cent", "percent"), ("sub license", "sublicense"), ("merchantibility", "merchantability"), ("v(?:ersion)?(?: )?([0-9])", "version $1"), ("https", "http"),
]

#: Texts of public licences and the usual notices that name one.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]


#: Packaged texts of `licence_texts/`, each one whole, by file name.
WHOLE = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
#: Titles that may stand above the texts that have none of their own.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"], "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"],
}
#: What follows the terms: advice on how to apply them, which copies often leave out.
_ADVICE = re.compile(r"^[ \t]*(?:END OF TERMS AND CONDITIONS|ADDENDUM: How to use)", re.M)


def whole_texts() -> list[tuple[str, str]]:
    """Rows (licence, text) of whole public licences: with and without the advice after the terms, and with the titles of TITLES."""
    read = lambda name: resources.files("gistmill.llm").joinpath("licence_texts", f"{name}.txt").read_text("utf-8")
    out = []
    for name, licence in WHOLE.items():
        text = read(name)
        out.append((licence, text))
        end = _ADVICE.search(text)
        if end:
            out.append((licence, text[: end.start()]))
            if "END OF TERMS" in end.group():
                out.append((licence, text[: end.end()]))
    bsd = read("BSD")
    short = [(x, y) for x, y in KNOWN if x in TITLES and "\n" in y] + [("BSD-3-Clause", bsd)]
    for held in ("HOLDERS", "HOLDER"):
        text = bsd.replace("name of the University", "name of the copyright holder").replace("BY THE REGENTS", "BY THE COPYRIGHT HOLDERS").replace("SHALL THE REGENTS", f"SHALL THE COPYRIGHT {held}")
        short += [("BSD-3-Clause", text), ("BSD-2-Clause", re.sub(r"^3\. .*?\n\n", "\n", text, flags=re.M | re.S))]
    return out + short + [(x, f"{title}\n\n{y}") for x, y in short for title in TITLES[x]]


def _spelled(col: Column, spellings: list[tuple[str, str]]) -> Column:
    """Whole words in their one spelling. There are two blanks between words, so neighbours are told at once."""
    for pattern, becomes in spellings:
        col = F.regexp_replace(col, f" {pattern.replace(' ', '  ')} ", f" {becomes.replace(' ', '  ')} ")
    return col


def canonical_lines(text: str | Column) -> Column:
    """The lines of a text in canonical form, each within blanks, with two blanks between words."""
    col = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)
    col = F.regexp_replace(F.regexp_replace(col, OWN_COPYRIGHT, ""), f"(?md){COPYRIGHT_LINE}", "")
    col = F.regexp_replace(col, PUNCTUATION, "  ")
    col = F.concat(F.lit("  "), F.regexp_replace(col, "\n", "  \n  "), F.lit("  "))
    col = F.regexp_replace(F.regexp_replace(col, "  +", "  "), "([^ \n]) (?=[^ \n])", "$1  ")
    return _spelled(col, SPELLINGS)


def canonical(lines: str | Column) -> Column:
    """The canonical form of a whole text, from that of its lines: words that a line break has parted are told as well."""
    col = F.regexp_replace(lines, "[ \n]+", "  ")
    return F.trim(F.regexp_replace(_spelled(F.concat(F.lit("  "), F.trim(col), F.lit("  ")), [x for x in SPELLINGS if " " in x[0] + x[1]]), " +", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows (digest, licence), one for each canonical text; a text of two licences names the first in order. known: KNOWN and `whole_texts` if left out."""
    frame = spark.createDataFrame(KNOWN + whole_texts() if known is None else known, "licence string, text string").select("licence", canonical(canonical_lines("text")).alias("text"))
    return frame.where("text <> ''").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("licence").alias("licence"))


#: Known texts that are sent to all tasks; more are joined by a shuffle.
SENT = 10_000


def licence_scan(docs: DataFrame, digests: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, digest (of the whole canonical text), licence (whose text it is, or null), licence_lines (how many of its lines are by
    themselves a known text), line_licences (their licences, sorted, each once).

    A null text counts as empty; an empty canonical text is never a licence. Rows that are there twice are told one by one, an empty table gives
    none, other columns are not read. digests: from `known_digests`.
    """
    if digests.limit(SENT + 1).count() <= SENT:
        digests = F.broadcast(digests)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.explode(F.array(canonical_lines(text))).alias("text"))
    # A generator's own columns are computed once; columns beside it would be computed anew for each line.
    whole = F.struct(F.md5(canonical(F.col("text")).cast("binary")).alias("digest"), F.split("text", "\n").alias("lines"))
    parts = rows.select("row", "id", F.explode(F.array(whole)).alias("part")).select("row", "id", "part.digest", F.explode("part.lines").alias("line"))
    lines = parts.withColumn("line", F.md5(F.regexp_replace(F.trim("line"), " +", " ").cast("binary")))
    known = digests.select(F.col("digest").alias("line"), F.col("licence").alias("line_licence"))
    # Lines of a row are neighbours, so they are put together again before they are shuffled.
    found = lines.join(known, "line", "left").groupBy("row", "id", "digest").agg(F.count("line_licence").alias("licence_lines"), F.sort_array(F.collect_set("line_licence")).alias("line_licences"))
    return found.join(digests, "digest", "left").select("id", "digest", "licence", "licence_lines", "line_licences")


def digest(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("id").alias("doc_id"), "digest", "licence", "licence_lines", F.concat_ws(",", "line_licences").alias("line_licences"))
