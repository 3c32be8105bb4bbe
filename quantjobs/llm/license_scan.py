"""Licence scans with DataFrame functions only: canonical texts and lines looked up among known digests.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent spellings, white
space) and its digest is hash-joined to the digests of known licence texts. Besides the entire text,
each of its lines is looked up in the same way, so that a notice inside a document is found too. Full
licence texts are known by their digests, taken without copyright clauses, and notices are also looked up
inside sentences and across line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantjobs.llm.common import load, whole_text, without
from quantjobs.llm.license_texts import DIGESTS

# Notices and short texts of well-known licences, by licence.
KNOWN = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Licensed under the MIT License.", "This work is licensed under the MIT License.", "Released under the MIT License.", "SPDX-License-Identifier: MIT"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Licensed under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain."],
    "proprietary": ["All rights reserved."],
}
# Equivalent spellings.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("organisation", "organization"), ("sub-license", "sublicense"), ("merchantibility", "merchantability"), ("noncommercial", "non commercial"), ("sharealike", "share alike")]
COPYRIGHT = r"(copyright|\(c\)|©).*[12][0-9]{3}"

# A copyright clause up to its line or sentence, the year optional, and what goes with it.
CLAUSE = r"(?im)(copyright\s*(\(c\)|©)|©|^\s*\(c\)(?=\s+[12][0-9]{3})|copyright(?=,?\s+[12][0-9]{3})|^\s*copyright(?=\s+(by|the|\S+\s+\S+$)))([^\n.]|\.(?!\s+(?-i:[A-Z])|\s*$))*\.?"
RESERVED = r"(?i)all rights reserved\.?"
#: Beginnings of the notices, in canonical form.
BEGIN = r"\b(?<!\bnot )(?=(licensed under|released under|this work is|spdx license identifier|all rights reserved)\b)"


def canonical(text: Column) -> Column:
    """Lower case without copyright lines and punctuation, spellings unified, single spaces."""
    out = F.lower(text)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def without_copyright(text: Column) -> Column:
    """The text without its copyright lines."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: ~F.lower(x).rlike(COPYRIGHT))
    return F.array_join(lines, "\n")


def without_clauses(text: Column) -> Column:
    """The text without its copyright clauses; what else stands in their lines stays."""
    return F.regexp_replace(text, CLAUSE, " ")


def holds(text: Column, *words: str) -> Column:
    """Whether a text holds one of the words in any case; every known text holds one."""
    low, out = F.lower(text), F.lit(False)
    for word in words:
        out = out | F.contains(low, F.lit(word))
    return out


def text_key(text: Column) -> Column:
    """Digest of a whole licence text: no copyright clauses, no reserved rights. Null for what holds no word of one."""
    key = F.sha2(canonical(F.regexp_replace(without_clauses(text), RESERVED, " ")), 256)
    return F.when(holds(text, "licen", "redistribution", "permission"), key)


def notices(text: Column, sizes: list[int]) -> Column:
    """What may be a notice anywhere in a text: the first words, as many as ``sizes`` tell, from each beginning of one."""
    plain = canonical(without_clauses(text))
    parts = F.when(holds(text, "licen", "reserved", "dedicated"), F.split(F.concat(F.lit(" "), plain), BEGIN)).otherwise(F.array().cast("array<string>"))  # split makes no cut at 0

    def first_words(x: Column, i: Column, p: Column) -> Column:
        ahead = F.split(F.trim(F.concat(x, F.coalesce(F.get(p, i + 1), F.lit("")))), " ")  # one notice may begin inside another
        return F.transform(F.array(*map(F.lit, sizes)), lambda n: F.array_join(F.slice(ahead, F.lit(1), n), " "))

    return F.flatten(F.flatten(F.transform(F.array(parts), lambda p: F.transform(p, lambda x, i: first_words(x, i, p)))))


def known_digests(spark: SparkSession, known: dict[str, list[str]]) -> DataFrame:
    """(digest, license): a table as small as ``known``."""
    rows = spark.createDataFrame([(name, t) for name, texts in known.items() for t in texts], "license string, text string")
    return rows.select(F.sha2(canonical(without_copyright(F.col("text"))), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def licenses_of(lines: Column, names: dict[str, str]) -> Column:
    """Names of the lines whose digests are keys of ``names``; null for the others."""
    pairs = [F.lit(x) for pair in sorted(names.items()) for x in pair]
    known = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.transform(lines, lambda x: F.try_element_at(known, F.sha2(x, 256)))


def scan(docs: DataFrame, known: dict[str, list[str]] | None = None, text: str = "text") -> DataFrame:
    """Adds text_digest, text_license (of the entire text) and licenses (sorted, of all lines and the text).

    Entire texts are hash-joined to the known digests, which are broadcast; lines and notices are looked up in
    the same list within the row, so a text is read once and never shuffled, however often it is repeated.
    Null texts count as empty; an empty canonical text or line is never a licence; repeated rows give
    equal rows; other columns are kept, but those of the new
    names (and _text, _name) are replaced. The digest table is as small as the list of known texts.
    """
    docs = without(docs, "text_digest", "text_license", "licenses", "_text", "_name")
    spark = docs.sparkSession
    known = known or KNOWN
    table = known_digests(spark, known)
    names = {r["digest"]: r["license"] for r in table.collect()}  # one row a known text
    texts = F.broadcast(spark.createDataFrame([(d, name) for name, ds in DIGESTS.items() for d in ds], "_text string, _name string"))
    sizes = sorted({r["n"] for r in spark.createDataFrame([(t,) for ts in known.values() for t in ts], "t string").select(F.size(F.split(canonical(without_copyright(F.col("t"))), " ")).alias("n")).collect()})
    whole = without_copyright(whole_text(text))
    lines = F.concat(F.transform(F.split(whole, "\n"), canonical), notices(whole_text(text), sizes))
    lines = F.array_distinct(F.filter(lines, lambda x: x != ""))
    found = F.array_compact(licenses_of(lines, names))
    keyed = docs.withColumn("_text", text_key(whole_text(text))).withColumn("text_digest", F.sha2(canonical(whole), 256)).withColumn("licenses", found)
    entire = F.broadcast(table.select(F.col("digest").alias("text_digest"), F.col("license").alias("text_license")))
    out = keyed.join(entire, "text_digest", "left").join(texts, "_text", "left")
    every = F.concat("licenses", F.array_compact(F.array(F.coalesce("text_license", "_name"))))
    return out.select(*[f"`{c}`" for c in docs.columns], "text_digest", F.coalesce("text_license", "_name").alias("text_license"), F.array_sort(F.array_distinct(every)).alias("licenses"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every whole text of documents: doc_id, text_digest, text_license, licenses (comma-joined)."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "text_digest", "text_license", F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    """The query as DuckDB SQL."""

    def canon(x: str) -> str:
        x = f"lower({x})"
        for old, new in SPELLINGS:
            x = f"replace({x}, '{old}', '{new}')"
        return f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"

    def clean(x: str) -> str:
        return f"array_to_string(list_filter(string_split_regex({x}, '\\r?\\n'), lambda l: NOT regexp_matches(lower(l), '{COPYRIGHT}')), chr(10))"

    rows = ", ".join(f"('{name}', '{t}')" for name, texts in KNOWN.items() for t in texts)
    return f"""
WITH known AS (SELECT sha256({canon(clean("t"))}) AS digest, min(l) AS license FROM (VALUES {rows}) AS k(l, t) GROUP BY 1),
d AS (SELECT doc_id, {clean("coalesce(text, '')")} AS w, row_number() OVER () AS r FROM documents),
e AS (SELECT doc_id, r, sha256({canon("w")}) AS text_digest FROM d),
f AS (SELECT r, unnest(string_split(w, chr(10))) AS line FROM d),
g AS (SELECT DISTINCT f.r, k.license FROM f JOIN known k ON {canon("line")} <> '' AND sha256({canon("line")}) = k.digest),
h AS (SELECT e.r, k.license FROM e JOIN known k ON e.text_digest = k.digest),
s AS (SELECT r, string_agg(license, ',' ORDER BY license) AS licenses FROM (SELECT * FROM g UNION SELECT * FROM h) GROUP BY r)
SELECT e.doc_id, e.text_digest, h.license AS text_license, coalesce(s.licenses, '') AS licenses
FROM e LEFT JOIN h ON e.r = h.r LEFT JOIN s ON e.r = s.r
"""


ORACLE_SQL = _sql()
