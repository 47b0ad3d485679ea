"""Licence scans: texts are normalised, digested and hash-joined to the digests of known licences (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import read_table

# The public wording of short licences and usual notices.
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
    "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
    "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
    "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
#: Licence name to its wordings. Each wording is looked up as a whole text.
KNOWN_LICENSES: dict[str, tuple[str, ...]] = {
    "MIT": (f"MIT License {_MIT_GRANT} {_MIT_WARRANTY}", f"{_MIT_GRANT} {_MIT_WARRANTY}", "Released under the MIT License.", "Licensed under the MIT License."),
    "ISC": (f"ISC License {_ISC} {_ISC_WARRANTY}", f"{_ISC} {_ISC_WARRANTY}"),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY,),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."),
    "all-rights-reserved": ("All rights reserved.",),
}
#: Spellings that count as one: pattern over lower-case words, replacement.
EQUIVALENT = (("licence", "license"), ("organisation", "organization"), ("non commercial", "noncommercial"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"))
#: A line that only names the holder; where a line is scanned alone, its notice up to the first full stop after the year.
COPYRIGHT_LINE = r"(?im)^[^A-Za-z0-9\n]*(copyright\b|\(c\)|©)[^\n]*[0-9]{4}[^\n]*$"
COPYRIGHT_NOTICE = r"(?i)^[^A-Za-z0-9]*(copyright\b|\(c\)|©).*?[0-9]{4}[^.]*[.]"
# Digests of the canonical forms of whole public licence texts, too long to be written out here.
KNOWN_DIGESTS: dict[str, str] = {
    "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "452eaadd998b06b62a51be424c021eea5228803a2773e147818b9cd429a60d64": "GFDL-1.2",
    "c6db6132e3f9cfc574a0348860b9e8a36b70ab711ca7ec85d9c61871c2d90e55": "GFDL-1.3",
    "eafda7cb5e995143f4d45ef2107eb160d6856afabed7c48b1b317303bc40a7e6": "GPL-1.0",
    "633db8412bbb99b0672b664e80d260461a3f7fb1c14a45c614eb6124876ce2a7": "GPL-2.0",
    "969fd5d620157eced8b632e4ba7154859f195397976b89e7ee716615116fc70a": "GPL-3.0",
    "1f1ace2d2c5e80547f3f0517299934f8d456c17a9a9939250e76087b010f5614": "LGPL-2.0",
    "6eacb2e57ceb0cc63a48b9b4e3181e4b691c27408dfd80dc12bafc4bffff46b5": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1": "MPL-1.1",
    "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d": "MPL-2.0",
}


def canonical(text: Column, notice: str = COPYRIGHT_LINE) -> Column:
    """Copyright lines out, ASCII lower case, each run of other characters than letters and digits one space, equivalent spellings one."""
    out = F.regexp_replace(text, notice, " ")
    out = F.trim(F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}]+", " "))
    for spelling, preferred in EQUIVALENT:
        out = F.replace(out, F.lit(spelling), F.lit(preferred))
    return out


def license_digests(spark: SparkSession, known: Mapping[str, tuple[str, ...]] = KNOWN_LICENSES, digests: Mapping[str, str] = KNOWN_DIGESTS) -> DataFrame:
    """(digest, license, word) of known wordings and of whole texts that only their digest is known of, the least name of equals."""
    texts = spark.createDataFrame([(name, text) for name, texts in known.items() for text in texts], "license string, text string")
    rows = spark.createDataFrame([(digest, name, None) for digest, name in digests.items()], "digest string, license string, word string")
    return known_licenses(texts).unionByName(rows).groupBy("digest").agg(F.min("license").alias("license"), F.min("word").alias("word"))


def known_licenses(texts: DataFrame) -> DataFrame:
    """(digest, license, word) of a table of wordings (license, text); the same normalisation as for texts.

    ``word`` is the longest word of a wording, by which lines that may be it are found; null if it is not of plain letters
    and digits or if a spelling changes it. Null and empty texts are no wordings.
    """
    form = canonical(F.col("text"))
    changed = [w for pair in EQUIVALENT for side in pair for w in side.split(" ")]
    words = F.filter(F.split("form", " "), lambda w: w.rlike("^[a-z0-9]+$") & ~w.isin(*changed))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    rows = texts.select("license", form.alias("form")).filter("form <> ''").select(F.sha2("form", 256).alias("digest"), "license", longest.alias("word"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.min("word").alias("word"))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Look up every whole text of ``docs`` (doc_id, text) by the digest of its canonical form.

    Returns doc_id, fingerprint of the text, canonical_digest (null for a null text), license (of the whole text, else null),
    a row for each row. A text that is empty once normalised is no licence. The known digests are the smaller side by far;
    Spark broadcasts them while they are below its own threshold and shuffles both sides by digest beyond. Only digests are
    shuffled, never texts.
    """
    form = canonical(F.col("text"))
    digest = F.when(form != "", F.sha2(form, 256)).otherwise(F.when(F.col("text").isNotNull(), F.sha2(F.lit(""), 256)))
    digests = docs.select("doc_id", F.xxhash64("text").alias("fingerprint"), digest.alias("canonical_digest"))
    return digests.join(known.select(F.col("digest").alias("canonical_digest"), "license"), "canonical_digest", "left").select("doc_id", "fingerprint", "canonical_digest", "license")


def scan_license_lines(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, fingerprint of the text, line_no, license) of each line that is, as a whole, a known licence wording; lines count from 0.

    A copyright notice before the wording does not count. Repeated rows give their lines once. Only lines with the longest
    word of some known wording are digested; such words are collected, one for each wording of the caller's table, and
    where one has none every line is.
    """
    some = [r["word"] for r in known.select("word").distinct().collect()]
    has = (lambda c: F.col(c).rlike("(?i)" + "|".join(sorted(w for w in some if w)))) if some and all(w for w in some) else (lambda c: F.lit(True))
    lines = docs.filter(has("text")).select("doc_id", F.xxhash64("text").alias("fingerprint"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(has("line"))
    found = lines.select("doc_id", "fingerprint", "line_no", F.sha2(canonical(F.col("line"), COPYRIGHT_NOTICE), 256).alias("digest")).join(known.select("digest", "license"), "digest")
    return found.select("doc_id", "fingerprint", "line_no", "license").distinct()


def op10_license_digests(spark, sf_dir) -> DataFrame:
    """Every document with the licence that its whole text is, and the licences that whole lines of it are.

    A row of documents has one row here, whether its doc_id is null or repeated; lines are those of its own text. A null text
    has neither digest, licence nor lines.
    """
    docs = read_table(spark, sf_dir, "documents")
    known = license_digests(spark)
    lines = scan_license_lines(docs, license_digests(spark, digests={})).groupBy("doc_id", "fingerprint").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"), F.count("*").alias("n_lines"))
    lines = lines.withColumnsRenamed({"doc_id": "line_doc", "fingerprint": "line_print"})
    whole = scan_licenses(docs, known).join(lines, F.col("doc_id").eqNullSafe(F.col("line_doc")) & (F.col("fingerprint") == F.col("line_print")), "left")
    return whole.select("doc_id", "canonical_digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


QUERIES = {"op10_license_digests": op10_license_digests}


def _sql_canonical(text: str, notice: str = COPYRIGHT_LINE) -> str:
    out = f"trim(regexp_replace(lower(regexp_replace({text}, '{notice}', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for spelling, preferred in EQUIVALENT:
        out = f"replace({out}, '{spelling}', '{preferred}')"
    return out


def _sql_known() -> str:
    rows = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, texts in KNOWN_LICENSES.items() for text in texts)
    wholes = ", ".join(f"('{digest}', '{name}')" for digest, name in KNOWN_DIGESTS.items())
    return f"SELECT digest, min(license) AS license FROM (SELECT sha256({_sql_canonical('t')}) AS digest, license FROM (VALUES {rows}) AS v(license, t) UNION ALL SELECT * FROM (VALUES {wholes}) AS w(digest, license)) GROUP BY 1"


ORACLE_SQL = {
    "op10_license_digests": f"""
WITH known AS ({_sql_known()}),
whole AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS canonical_digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
hits AS (SELECT doc_id, license FROM (SELECT doc_id, sha256({_sql_canonical('line', COPYRIGHT_NOTICE)}) AS digest FROM lines) JOIN known USING (digest)),
per_doc AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n_lines FROM hits GROUP BY doc_id)
SELECT w.doc_id, w.canonical_digest, k.license, coalesce(p.line_licenses, '') AS line_licenses, coalesce(p.n_lines, 0) AS n_lines
FROM whole w LEFT JOIN known k ON k.digest = w.canonical_digest LEFT JOIN per_doc p ON p.doc_id = w.doc_id
"""
}
