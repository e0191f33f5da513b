"""License scans by canonical digest lookup.

Statements of copyright are cut out of a text, and its lines are made canonical: lower case, equivalent spellings to one,
punctuation and blanks to single blanks. Lines joined by blanks are the canonical text, so that wrapping doesn't
matter, and its SHA-256 is joined to those of known license texts. The same lines, each by itself, are joined too,
which finds notices such as "Released under the MIT License." inside other texts; a line is hashed only if it is as
long as a known text is. Everything is a column expression, and the patterns are understood alike by RE2.

A statement of copyright is cut out, and no word more, wherever its lines break: the word, its sign, years and the names of
holders. A name is a run of words with capitals, of initials, short words between such words, mail addresses in brackets and the
placeholders of license texts, on one line or two; it ends at the end of a sentence, at a word of small letters, and at a
word that licenses use. "Copyright 2020 Some One. Commercial use is prohibited." thus leaves a sentence, and the text is no
known license. Names in small letters are not cut. "All rights reserved" goes, as it says no more, and so does the name that
the third clause of BSD licenses has. The text of all scripts stays: only what is neither letter, mark nor digit
separates words.

Known texts are rows (license_id, text), canonicalised the same way; a table with more than
`broadcast_rows` of them is joined by a shuffle.

Defined results: null and empty texts have the digest of the empty text and match nothing. Repeated rows
are reported each; a null id is carried along. If known texts have one canonical form, the least
license_id is reported. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, pinned

#: Equivalent spellings: words of license texts that count as the second one.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense",
    "organisation": "organization", "authorised": "authorized", "acknowledgement": "acknowledgment",
    "favour": "favor", "fulfil": "fulfill", "wilful": "willful", "merchantibility": "merchantability",
    "v1": "version 1", "v2": "version 2", "v3": "version 3", "ver": "version", "https": "http",
}

#: Names of licenses, as notices give them.
NAMES = [
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"), ("0BSD", "Zero-Clause BSD License"), ("Zlib", "zlib License"), ("Unlicense", "Unlicense"), ("MPL-2.0", "Mozilla Public License, Version 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"),
    ("GPL-2.0-only", "GNU General Public License, version 2"), ("GPL-3.0-only", "GNU General Public License, version 3"), ("LGPL-2.1-only", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0-only", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0-only", "GNU Affero General Public License, version 3"), ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
]
#: Notices: each name in each of these forms, and each identifier in the last one.
FORMS = ["{the}{}", "Licensed under {the}{}.", "Released under {the}{}.", *(f"This {x} is {y} under {{the}}{{}}." for x in ("project", "work", "software", "file", "program", "document") for y in ("licensed", "released", "distributed"))]
IDENTIFIER = "SPDX-License-Identifier: {}"
#: Titles that may stand above a text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"], "Unlicense": ["The Unlicense", "Unlicense"], "Zlib": ["zlib License", "The zlib License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"],
}
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def known_rows() -> list[tuple[str, str]]:
    """The whole texts of `licenses/`, with and without a title and what follows the end of their terms; and the notices."""
    rows = []
    for file in sorted(Path(__file__).with_name("licenses").glob("*.txt")):
        text, name = file.read_text(encoding="utf-8"), file.stem
        rows += [(name, text), *((name, f"{title}\n\n{text}") for title in TITLES.get(name, []))]
        if END_OF_TERMS in text:
            terms = text[: text.index(END_OF_TERMS)]
            rows += [(name, terms + END_OF_TERMS), (name, terms)]
    for name, title in NAMES:
        the = "" if title.startswith("CC") else "the "
        rows += [(name, form.format(title, the=the)) for form in FORMS if form != "{the}{}" or title.startswith("CC")]
        rows.append((name, IDENTIFIER.format(name)))
    return list(dict.fromkeys(rows))


#: Of texts that none of these patterns finds, nothing is cut. All patterns are understood alike by Java and RE2.
GATE = r"(?i)copyright|©|\(c\)|rights[ \t\r\n]+reserved|neither[ \t]+the[ \t]+name"
#: Between words of a statement: blanks, or one line break and the next line's comment marks.
GAP = r"(?:[ \t]*\r?\n[ \t]*[#*/;!]*[ \t]*|[ \t]+)"
#: Words of licenses and terms, which are never part of a name.
TERMS = (
    r"(?i)(^|[^\p{L}\p{M}\p{N}\x01])(acts?|all|any|are|be|commercial|contributors|cop(?:y|ies|ying|yright)|disclaimer|distribut\w*|everyone|except|fees?|forbid\w*|grant\w*|holders?|if|in|infringement|interest|is|it|laws?|licen[cs]\w*|may|modif\w*|must|no|non\w*|not|notices?|on|only|or|owners?"
    r"|ownership|pay\w*|permi\w*|portions|prohibit\w*|protection|provided|redistribut\w*|releas\w*|requir\w*|reserved|restrict\w*|rights?|sell\w*|shall|statements?|status|subject|terms?|that|these|this|to|treat\w*|under|us(?:e|es|ed|ing)|version|warrant\w*|which|with|without|you|your)([^\p{L}\p{M}\p{N}]|$)"
)
#: Placeholders of license texts, and addresses: of years, and of names.
YEAR_HOLDER = r"[<\[{](?:years?|yyyy)[>\]}]"
HOLDER = rf"[<\[{{][ \t]*(?:names?|names?{GAP}of{GAP}(?:the{GAP})?(?:authors?|copyright{GAP}(?:owners?|holders?))|copyright{GAP}(?:owners?|holders?)|owners?|holders?|authors?|organi[sz]ations?|fullname|[^<>\[\]{{}}\s]+@[^<>\[\]{{}}\s]+)[ \t]*[>\]}}]"
WORD = r"(?:\p{Lu}\.|(?:Inc|Ltd|Co|Corp|Jr|Sr|Dr|St)\.|[\p{Lu}\p{Lt}\p{Lo}][\p{L}\p{M}\p{N}'’&@-]*)"
NAME = rf"{WORD}(?:,?{GAP}(?:(?:and|of|the|for|at|de|der|den|von|van|la|le|du|et|und|y|&){GAP})*{WORD})*"
YEARS = rf"[0-9]{{4}}(?:{GAP}?[-–,]{GAP}?(?:[0-9]{{4}}|present))*,?"
SIGN = r"(?:\([cC]\)|©)"
COPYRIGHT = r"(?i:\x01*copyright[,:]?)"
#: With a sign or a year a statement may lack a name; with neither it is the word and a name. A (c) alone needs a year.
STATEMENT = (
    rf"(?:\x01*[Pp]ortions{GAP})?(?:{COPYRIGHT}{GAP}?(?:{SIGN}[,:]?)?{GAP}?{YEARS}|{SIGN}{GAP}?(?:{COPYRIGHT})?{GAP}?{YEARS}|{COPYRIGHT}{GAP}?{SIGN}|{SIGN}{GAP}?{COPYRIGHT}|©|\x01+C(?i:opyright)(?:{GAP}by)?{GAP}{WORD})"
    rf"(?:{GAP}(?:by{GAP}|the{GAP})*{NAME})?"
)
RESERVED = rf"(?i)all{GAP}rights{GAP}reserved"
NEITHER = rf"((?i:neither{GAP}the{GAP}names?{GAP}of{GAP}))(?:(?i:the{GAP}copyright{GAP}(?:holder|owner)s?)|(?:the{GAP})?{NAME})((?i:{GAP}nor{GAP}the{GAP}names{GAP}of{GAP}))"
#: Letters, their marks and digits stay; all else separates words.
SEPARATORS = r"[^\p{L}\p{M}\p{N}]+"


def without_statements(text: Column) -> Column:
    """A text without its statements of copyright. Words of terms get a mark first, which no name can run over."""
    named = F.regexp_replace(F.regexp_replace(text, YEAR_HOLDER, "2000"), HOLDER, "Somebody")
    plain = F.regexp_replace(F.regexp_replace(named, NEITHER, "$1$2"), RESERVED, " ")
    marked = lambda t: F.regexp_replace(t, TERMS, "$1\u0001$2$3")
    return F.when(text.rlike(GATE), F.regexp_replace(marked(marked(plain)), STATEMENT, " ")).otherwise(text)  # twice, for words side by side


def canonical_line(line: Column) -> Column:
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(line), SEPARATORS, " ")), F.lit(" "))
    return F.trim(reduce(lambda t, pair: F.replace(t, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), SPELLINGS.items(), words))


def canonical_lines(text: Column) -> Column:
    """The lines of a text that hold words, each made canonical."""
    return F.filter(F.transform(F.split(without_statements(F.coalesce(text, F.lit(""))), "\n"), canonical_line), lambda x: x != "")


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_rows(), "license_id string, text string")


def digests(known: DataFrame) -> DataFrame:
    """(digest, license_id, size): size is the canonical text's length."""
    canon = known.select("license_id", F.array_join(canonical_lines(F.col("text")), " ").alias("canon")).filter("canon <> ''")
    return canon.groupBy(F.sha2("canon", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.min(F.length("canon")).alias("size"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """Per row: doc_id, canonical_sha256, license_id (of the whole text, or null), notices (the license ids of its
    lines, one for each line that is a known notice, sorted and joined by blanks) and n_notices."""
    table = pinned(digests(known if known is not None else known_texts(docs.sparkSession)))
    few = table.count() <= broadcast_rows
    held = table.select("digest", "license_id")
    held = F.broadcast(held) if few else held
    sizes = [r["size"] for r in table.select("size").distinct().limit(1001).collect()]
    if len(sizes) > 1000:  # then a range must do
        ends = table.agg(F.min("size"), F.max("size")).first()
        fits = lambda x: F.length(x).between(*ends)
    else:
        fits = lambda x: F.length(x).isin(sizes) if sizes else F.lit(False)
    rows = docs.select(col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), canonical_lines(col(text_col)).alias("all"))
    mine = pinned(rows.select("doc_id", "rid", F.sha2(F.array_join("all", " "), 256).alias("canonical_sha256"), F.transform(F.filter("all", fits), lambda x: F.sha2(x, 256)).alias("lines")))  # texts are read once
    whole = mine.join(held, mine["canonical_sha256"] == held["digest"], "left").drop("digest")
    # Lines as long as a known text are few: they alone are spelled out, joined and brought back together.
    names = whole.withColumn("digest", F.explode("lines")).join(held.withColumnRenamed("license_id", "notice"), "digest").groupBy("rid").agg(F.array_sort(F.collect_list("notice")).alias("found"))
    both = whole.join(names, "rid", "left")
    return both.select("doc_id", "canonical_sha256", "license_id", F.concat_ws(" ", "found").alias("notices"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_notices"))
