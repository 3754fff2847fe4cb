"""Licence scans: digests of canonical texts joined with those of known licences."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence texts and notices by their short name. A notice names a licence too.
TEXTS = {
    "MIT": [
        "Released under the MIT License.",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."],
    "ISC": [
        "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
}
# Digests of the canonical full texts, with and without title, with and without the part on how to apply them.
FULL_TEXTS = {
    "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100": "Apache-2.0",
    "e9dbf930ca0f1e090ec68da9a37b657d11bc9e43b30643455d6a96dbf73116ca": "Apache-2.0",
    "8bc274b78ed86c607ba1cda8907d306bdcd748d87218adf3dcc786d7f5be76c9": "Apache-2.0",
    "36bf4bc3f65a3a3715a27446fcc6e075c896e3b75cb615136b59a98da8c2d2c8": "Apache-2.0",
    "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1": "GPL-2.0",
    "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999": "GPL-2.0",
    "e7bc7b2c2e4b763c9c6ceb90a3984a8273193cd39747fbab315ee26296ddd602": "GPL-2.0",
    "51784fcce02e3d6a52a2ec0260f583b9d573810cf33e46bd16fd6a821b36760b": "GPL-2.0",
    "f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f": "GPL-3.0",
    "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b": "GPL-3.0",
    "f4e87d2266314d5f9d6c3a1488d4ffd2d9992f355e6cf74f1f83fea59f3e6451": "GPL-3.0",
    "c0c9bd5f6daa38ab99b2393ea1bf3fa29104890d97df6f0e6ee8151c8ea15e08": "GPL-3.0",
    "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345": "LGPL-2.1",
    "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c": "LGPL-2.1",
    "f9d8c63510acadfc6b74bb2f6da8f29ced84841c43b4548b8aa673c7d43abba9": "LGPL-2.1",
    "359509cf11d8ff3c5d1dcc9af8aef0449aa2f4665124a5f19daa9990ee1c77eb": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7": "LGPL-3.0",
    "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9": "MPL-2.0",
    "e07dcdcc3b2c19db7e604dfb1498cc5dafa0e9cecf6ffc44f7c2b093fe9bafc2": "MPL-2.0",
}
# What stands above the text of a licence, by its short name; the empty one is a text without title.
TITLES = {"MIT": ["", "MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["", "ISC License", "The ISC License", "ISC License (ISC)"]}
# Where a licence begins behind a copyright notice on the same line.
GRANT = "(permission is hereby granted|permission to use, copy|redistribution and use in).*"
# Spellings that count as equal, applied to canonical words.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "organisation": "organization",
             "noninfringement": "non infringement"}
COPYRIGHT = r"^ ?(copyright|©|\(c\)|all rights reserved)"
NOT_WORDS = r"[^\p{L}\p{N}]+"


def canonical_lines(text: Column) -> Column:
    """Lines in lower case without copyright lines, as words with one space between; no empty ones."""
    lines = F.filter(F.split(F.lower(text), "\n"), lambda x: ~F.ltrim(x).rlike(COPYRIGHT))
    return F.filter(F.transform(lines, canonical_words), lambda x: x != "")


def granted_lines(text: Column) -> Column:
    """Like :func:`canonical_lines`, but of a copyright line what stands behind the notice stays if it is a grant."""
    lines = F.transform(F.split(F.lower(text), "\n"), lambda x: F.when(
        F.ltrim(x).rlike(COPYRIGHT), F.regexp_extract(x, GRANT, 0)).otherwise(x))
    return F.filter(F.transform(lines, canonical_words), lambda x: x != "")


def titled(texts: Mapping[str, list[str]]) -> dict[str, list[str]]:
    """The texts with all titles of their licence; those that begin with none of them stay as they are."""
    out = {}
    for name, own in texts.items():
        out[name] = list(own)
        for title in TITLES.get(name, []):
            out[name] += [f"{title} {t[len(f'{name} License '):]}".strip() for t in own if t.startswith(f"{name} License ")]
    return out


def canonical_words(line: Column) -> Column:
    out = F.concat(F.lit(" "), F.regexp_replace(line, NOT_WORDS, " "), F.lit(" "))
    for have, want in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {have} "), F.lit(f" {want} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(words: Column) -> Column:
    return F.sha2(words, 256)


def known_licenses(spark, texts: Mapping[str, list[str]]) -> DataFrame:
    """``digest, license`` of the given texts; a few rows per licence."""
    rows = [(name, text) for name, own in texts.items() for text in own]
    given = spark.createDataFrame(rows, "license string, text string")
    words = F.array_join(canonical_lines(F.col("text")), " ")
    return given.select(digest(words).alias("known"), "license").groupBy("known").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, texts: Mapping[str, list[str]] = TEXTS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: ``digest`` of its whole canonical text, ``license`` if that is a known text,
    and ``notices``, the licences that single lines name, in order and separated by commas.

    Case, punctuation, copyright lines and equivalent spellings do not matter. A null text has a
    null digest and no licence. A grant behind a copyright notice on its line counts for ``license``, not for
    ``digest``; full texts of six more licences are known by their digests. A text without words has the digest of the empty text. Only
    digests are joined; the known ones are as many as the given texts, so they are broadcast.
    """
    slim = docs.select(docs[id_col].alias("id"), canonical_lines(docs[text_col]).alias("lines"),
                       granted_lines(docs[text_col]).alias("granted")).select(
        "id", digest(F.array_join("lines", " ")).alias("digest"), F.transform("lines", digest).alias("lines"),
        digest(F.array_join("granted", " ")).alias("granted"))
    known = known_licenses(docs.sparkSession, titled(texts))
    if texts:
        known = known.union(docs.sparkSession.createDataFrame(list(FULL_TEXTS.items()), "known string, license string"))
    named = F.create_map(*[F.lit(x) for r in known.collect() for x in r]) if texts else F.create_map().cast("map<string,string>")
    whole = slim.join(F.broadcast(known), slim["granted"] == known["known"], "left")
    notices = F.array_sort(F.array_distinct(F.array_compact(F.transform("lines", lambda x: named[x]))))
    return whole.select(F.col("id").alias(id_col), "digest", "license",
                        F.coalesce(F.array_join(notices, ","), F.lit("")).alias("notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(line: str) -> str:
    out = f"concat(' ', regexp_replace({line}, {_quoted(NOT_WORDS)}, ' ', 'g'), ' ')"
    for have, want in SPELLINGS.items():
        out = f"replace({out}, ' {have} ', ' {want} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _lines_sql(text: str) -> str:
    own = f"list_filter(string_split(lower({text}), chr(10)), lambda x: not regexp_matches(ltrim(x), {_quoted(COPYRIGHT)}))"
    return f"list_filter(list_transform({own}, lambda x: {_canonical_sql('x')}), lambda x: x <> '')"


SCAN_SQL = f"""
with given(license, text) as (values {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, own in TEXTS.items() for t in own)}),
known as (select sha256(array_to_string({_lines_sql('text')}, ' ')) as known, min(license) as license from given group by 1),
docs as (select doc_id, {_lines_sql('text')} as lines, text from documents),
found as (
  select doc_id, string_agg(distinct k.license, ',' order by k.license) as notices
  from (select doc_id, unnest(lines) as line from docs) l join known k on sha256(l.line) = k.known group by doc_id)
select d.doc_id, case when d.text is not null then sha256(coalesce(array_to_string(d.lines, ' '), '')) end as digest,
  k.license, coalesce(f.notices, '') as notices
from docs d left join known k on k.known = sha256(array_to_string(d.lines, ' ')) left join found f on f.doc_id = d.doc_id
"""
