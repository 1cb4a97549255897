"""Licence scans: whole texts, made canonical, hash-joined to the digests of known licences.

Canonical form: ASCII lower case; lines that only state a copyright dropped; everything but
letters and digits turned into single spaces; equivalent spellings made one. Two texts
that differ in case, punctuation, layout, holder or year then share one SHA-256. The digest
of each document's whole text and of each of its lines (a notice is a whole text of one
line) meets the known digests in a hash join.

Defined results: null texts, and texts without a letter or digit, have no digest and match
nothing; repeated rows each come back; rows that share a doc_id but not the text are judged
apart; an empty table of licences matches nothing.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.llm.columns import ascii_lower, once

#: Public licence texts and notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")


def _read(name: str) -> str:
    return (pkgutil.get_data("lectern.llm", f"texts/{name}.txt") or b"").decode()


def _between(text: str, first: str, last: str) -> str:
    start = text.index(first)
    return text[start : text.index(last, start) + len(last)]


def _whole(name: str) -> tuple[str, ...]:
    """The text with its appendix and without, its addresses with http and https."""
    text = _read(name)
    texts = [text, *(text.partition(end)[0] + keep for end in ("END OF TERMS AND CONDITIONS",) if end in text for keep in ("", end))]
    return tuple(dict.fromkeys(t for x in texts for t in (x, x.replace("https://", "http://"), x.replace("http://", "https://"))))


def _bsd() -> dict[str, tuple[str, ...]]:
    """Both BSD texts, as the file has them and with the impersonal words of the templates."""
    three = _read("BSD-3-Clause")
    found: dict[str, tuple[str, ...]] = {"BSD-3-Clause": (), "BSD-2-Clause": ()}
    third = _between(three, "3. ", "without specific prior written permission.")
    templates = ("copyright holder nor the names of its contributors", "copyright holders nor the names of its contributors", "author nor the names of its contributors")
    for who in ("REGENTS", "COPYRIGHT HOLDERS", "AUTHOR"):
        for or_who in ("REGENTS", "COPYRIGHT HOLDER", "COPYRIGHT HOLDERS", "COPYRIGHT OWNER", "AUTHOR"):
            plain = three.replace("THE REGENTS AND", f"THE {who} AND").replace("THE REGENTS OR", f"THE {or_who} OR")
            for name in ("University nor the names of its contributors", *templates):
                text = plain.replace("University nor the names of its contributors", name)
                found["BSD-3-Clause"] += (text, "BSD 3-Clause License\n" + text, "The 3-Clause BSD License\n" + text)
            two = plain.replace(third, "")
            found["BSD-2-Clause"] += (two, "BSD 2-Clause License\n" + two, "The 2-Clause BSD License\n" + two)
    # clauses may go without numbers, and the line of rights may be missing
    found = {name: (*texts, *(t.replace("1. ", "").replace("2. ", "").replace("3. ", "") for t in texts)) for name, texts in found.items()}
    return {name: (*texts, *(t.replace("All rights reserved.", "") for t in texts)) for name, texts in found.items()}


#: One-line notices: a verb, a licence by one of its names, and what may follow.
VERBS = [f"{what}{verb} under" for what in ("", "This work is ", "This software is ", "This project is ") for verb in ("licensed", "released", "distributed")]
TAILS = ("", "see LICENSE", "see the LICENSE file for details")


def _names(short: str, full: str, number: str) -> list[str]:
    """Names of a licence with a version."""
    major = number.removesuffix(".0")
    full_names = [f"{full}{v}" for n in {number, major} for v in (f" version {n}", f" v{n}", f" {n}")]
    return full_names + [f"{short}{v}" for n in {number, major} for v in (f" {n}", f" v{n}", f"v{n}", f" version {n}")] + [f"{short} {number} License", f"{short} License {number}"]


NAMES = {
    "MIT": ["MIT", "MIT License", "MIT License (MIT)"],
    "ISC": ["ISC", "ISC License"],
    "0BSD": ["0BSD", "BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "Zlib": ["Zlib", "zlib License"],
    "Unlicense": ["Unlicense"],
    "Apache-2.0": [*_names("Apache", "Apache License", "2.0"), "Apache Software License 2.0"],
    "GPL-2.0": [*_names("GPL", "GNU General Public License", "2.0"), *_names("GNU GPL", "GNU General Public License", "2.0")],
    "GPL-3.0": [*_names("GPL", "GNU General Public License", "3.0"), *_names("GNU GPL", "GNU General Public License", "3.0")],
    "LGPL-2.1": _names("LGPL", "GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": _names("LGPL", "GNU Lesser General Public License", "3.0"),
    "MPL-2.0": _names("MPL", "Mozilla Public License", "2.0"),
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal"],
} | {
    f"CC-{short}-{v}": [f"CC {short} {v}", f"Creative Commons {full} {v}", f"Creative Commons {full} {v} License", f"Creative Commons {full} {v} International", f"Creative Commons {full} {v} International License"]
    for v in ("3.0", "4.0")
    for short, full in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    )
}


def notices(name: str) -> tuple[str, ...]:
    return tuple(f"{verb} {the}{called} {tail}" for called in dict.fromkeys(NAMES[name]) for verb in VERBS for the in ("", "the ") for tail in TAILS)


TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (MIT, "MIT License\n" + MIT, "The MIT License\n" + MIT, "The MIT License (MIT)\n" + MIT),
    "ISC": (ISC, "ISC License\n" + ISC),
    "0BSD": (ZERO_BSD, "BSD Zero Clause License\n" + ZERO_BSD),
    "Zlib": tuple(head + _read("Zlib") for head in ("", "zlib License\n", "The zlib License\n")),
    "Apache-2.0": (*_whole("Apache-2.0"), _between(_read("Apache-2.0"), 'Licensed under the Apache License, Version 2.0 (the "License")', "limitations under the License.")),
    "GPL-2.0-or-later": (_between(_read("GPL-2.0"), "This program is free software; you", "02110-1301 USA."),),
    "GPL-3.0-or-later": (_between(_read("GPL-3.0"), "This program is free software: you", "GNU General Public License for more details."),),
} | {name: _whole(name) for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense")} | _bsd()
KNOWN = {name: (*TEXTS.get(name, ()), *(notices(name) if name in NAMES else ())) for name in dict.fromkeys((*TEXTS, *NAMES))}
#: (spelling, the one it stands for), words of the lower-cased text without its punctuation.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("owner", "holder"),
    ("owners", "holders"),
)


def _other_word(words: frozenset[str]) -> str:
    """A pattern, without look-ahead, of the letters of a word that is none of ``words``."""
    heads = "".join(sorted({w[0] for w in words if w}))
    parts = [rf"[^\x00-\x60\x7B-\x7F{heads}][^\x00-\x60\x7B-\x7F]*"]
    parts += [h + _other_word(frozenset(w[1:] for w in words if w and w[0] == h)) for h in heads]
    return "(?:" + "|".join(parts) + ("" if "" in words else "|") + ")"


#: Words that follow "copyright" in prose and in licences, where a line may begin with it.
PROSE = frozenset(
    "a act also and are applies as assignment by can claim clause disclaimer does for from has holder holders if in infringement interest interests is it law laws license licenses licence licensed like may "
    "must notice notices of on or owner owners ownership permission permissions protection related resulting rights should shall statement statements that the this to treaty under was which will with you".split()
)
#: A line that only states a copyright, maybe in a comment: the word or sign, then a year, a sign or
#: a gap to fill in, or a name of at most six words, or authors.
COPYRIGHT_LINE = (
    r"(?m)^[ \t#*/;%]*(?:(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|[0-9]{4}|[\[<{])[^\n]*"
    rf"|copyright[ \t]+{_other_word(PROSE)}(?:[ \t,.&-]+[^ \t\n,.;:]+){{0,5}}[ \t.,]*"
    r"|copyright[ \t]+(?:by[ \t]+)?the[ \t][^\n]{0,60}(?:authors|contributors|developers|maintainers|team|project|foundation)[ \t.,]*(?:all rights reserved[ \t.]*)?)$"
)
#: All ASCII but letters, digits and line ends.
NOT_WORD = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text: Column) -> Column:
    """The canonical text, its lines still apart and padded: words stand between two spaces each,
    so that a spelling is replaced by plain search."""
    out = F.regexp_replace(ascii_lower(F.regexp_replace(text, "\r\n?", "\n")), COPYRIGHT_LINE, "")
    out = F.concat(F.lit("  "), F.regexp_replace(out, NOT_WORD, "  "), F.lit("  "))
    out = F.replace(out, F.lit("\n"), F.lit("  \n  "))
    for spelling, one in SPELLINGS:
        padded = spelling.replace(" ", "  ")
        out = F.replace(out, F.lit(f" {padded} "), F.lit(f" {one} "))
    return out


def _single(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \n]+", " "))


def _sha(plain: Column) -> Column:
    return F.when(plain != "", F.sha2(plain, 256))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text; null where nothing is left of it."""
    return once(_single(canonical(text)), _sha)


def known_digests(spark: SparkSession, known: Mapping[str, tuple[str, ...]] = KNOWN) -> DataFrame:
    """(known_digest, licence), one row per distinct digest."""
    rows = [(name, text) for name, texts in known.items() for text in texts]
    table = spark.createDataFrame(rows, "licence string, text string")
    return table.select(digest(F.col("text")).alias("known_digest"), "licence").where("known_digest is not null").groupBy("known_digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per document row: digest, licence of the whole text, and the licences of its lines.

    The digests of a row travel as small rows of their own; the text leaves the scan for no
    shuffle. ``known`` is joined without a hint, so its measured size decides on a broadcast.
    """
    # the text is made canonical once; its lines and the whole follow from that
    lines = lambda c: F.transform(F.filter(F.transform(F.split(c, "\n"), _single), lambda t: t != ""), lambda t: F.sha2(t, 256))
    digests = once(canonical(F.col("text")), lambda c: F.struct(once(_single(c), _sha).alias("whole"), lines(c).alias("lines")))
    read = docs.select("doc_id", F.xxhash64("text").alias("text_key"), digests.alias("_d"))
    one = F.array(F.struct(F.lit(True).alias("whole"), F.col("_d.whole").alias("d")))
    rest = F.transform("_d.lines", lambda d: F.struct(F.lit(False).alias("whole"), d.alias("d")))
    none = F.array().cast("array<struct<whole:boolean,d:string>>")
    rows = read.select("doc_id", "text_key", F.col("_d.whole").alias("digest"), F.explode(F.concat(one, F.coalesce(rest, none))).alias("part"))
    found = rows.join(known, F.col("part.d") == F.col("known_digest"), "left").where(F.col("part.whole") | F.col("licence").isNotNull())
    whole = F.col("part.whole")
    per = found.groupBy("doc_id", "text_key", "digest").agg(
        F.sum(whole.cast("long")).alias("times"),
        F.max(F.when(whole, F.col("licence"))).alias("licence"),
        F.array_join(F.array_sort(F.collect_set(F.when(~whole, F.col("licence")))), ",").alias("notices"),
        F.sum((~whole).cast("long")).alias("lines"),
    )
    each = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return each.select("doc_id", "digest", "licence", "notices", (F.col("lines") / F.col("times")).cast("long").alias("n_notices"))
