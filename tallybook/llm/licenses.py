"""Licence recognition: normalised sentences map to identifiers, identifier sequences match ordered rules. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences in normalised form (lower case, words and version numbers, single blanks).
SENTENCES = {
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "apache license": "apache-title",
    "licensed under the apache license version 2.0": "apache-2-notice",
    "licensed under the apache license version 2.0 the license": "apache-2-notice",
    "you may not use this file except in compliance with the license": "apache-2-use",
    "you may obtain a copy of the license at": "apache-2-copy",
    "this work is licensed under the gnu general public license version 2": "gpl-2-notice",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-later",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "licensed under cc by 4.0": "cc-by-4-notice",
    "licensed under cc by-sa 4.0": "cc-by-sa-4-notice",
    "licensed under cc by-nc 4.0": "cc-by-nc-4-notice",
    "licensed under cc by-nd 4.0": "cc-by-nd-4-notice",
    "all rights reserved": "reserved",
}
# Rules in order of precedence; a rule is a sequence of identifiers without a gap between known sentences.
RULES = [
    ("MIT", "mit-title mit-grant mit-condition mit-warranty"),
    ("MIT", "mit-grant mit-condition mit-warranty"),
    ("Apache-2.0", "apache-2-notice apache-2-use apache-2-copy"),
    ("BSD-2-Clause", "bsd-source bsd-binary"),
    ("GPL-3.0-or-later", "gpl-3-later"),
    ("GPL-2.0-or-later", "gpl-2-later"),
    ("GPL-3.0-only", "gpl-3-notice"),
    ("GPL-2.0-only", "gpl-2-notice"),
    ("Apache-2.0", "apache-2-notice"),
    ("MIT", "mit-notice"),
    ("CC-BY-NC-4.0", "cc-by-nc-4-notice"),
    ("CC-BY-ND-4.0", "cc-by-nd-4-notice"),
    ("CC-BY-SA-4.0", "cc-by-sa-4-notice"),
    ("CC-BY-4.0", "cc-by-4-notice"),
]
# Sentences and rules that the SQL below does not have; * is a name, a rule goes before the first one of the given licence.
GPL = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
MORE_SENTENCES = {
    f"{GPL} either version 2 of the license or at your option any later version": "gpl-2-later",
    f"{GPL} either version 3 of the license or at your option any later version": "gpl-3-later",
    f"this program is free software {GPL}": "gpl-terms",
    GPL: "gpl-terms",
    "either version 2 of the license or at your option any later version": "gpl-2-either",
    "either version 3 of the license or at your option any later version": "gpl-3-either",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
}
MORE_RULES = {
    "BSD-2-Clause": [("BSD-4-Clause", "bsd-source bsd-binary bsd-advertising bsd-name"), ("BSD-3-Clause", "bsd-source bsd-binary bsd-name")],
    "GPL-3.0-or-later": [("GPL-3.0-or-later", "gpl-terms gpl-3-either")],
    "GPL-2.0-or-later": [("GPL-2.0-or-later", "gpl-terms gpl-2-either")],
}
ALL_SENTENCES = SENTENCES | MORE_SENTENCES
#: Where a longer rule of another licence covers a rule, that place does not count for the shorter one.
ALL_RULES = [rule for known in RULES for rule in [*MORE_RULES.get(known[0], []), known]]
#: Passes over "\n", the lower-cased text and "\n\n". Marks at line starts (comments, list dots) go; a sentence ends for sure at
#: . ! ? ; : before white space and at blank lines (H), and may end or go on at a single line end (S). All else but letters,
#: digits and inner dots and hyphens becomes a blank. Marks are written twice, so that neighbours have one each.
PASSES = [
    (r"\r\n?", "\n"),
    (r"\n[^a-z0-9\n]+", "\n"),
    (r"[.!?;:]+\s+|\n\n+", " H H "),
    (r"\n", " S S "),
    (r"[^a-z0-9.\-HS]+", " "),
    (r" [.\-]+|[.\-]+ ", " "),
    (r" +", " "),
]
#: A name (*) is any words of one sentence, in which up to three abbreviations may look like sentence ends ("X Inc. of Y Co.").
NAME = "[^H]+?(?:H H(?: [^H]+?)?){0,3}?"


def _pattern() -> str:
    """Known sentences between two marks, the longest first; between words may be the end of a line."""
    known = sorted(ALL_SENTENCES, key=lambda k: (-len(k), k))
    return "[HS] (" + "|".join(" (?:S S )?".join(NAME if w == "*" else w.replace(".", r"\.") for w in k.split()) for k in known) + ") [HS]"


PATTERN = _pattern()
#: What joins a found sentence to its key: line ends, then the name.
JOINS = [(" S S ", " "), ("^neither the name of .+ nor the names of ", "neither the name of * nor the names of ")]


def marked(text: Column) -> Column:
    """Single-blank words of a text with the marks of sentence and line ends."""
    out = F.concat(F.lit("\n"), F.lower(text), F.lit("\n\n"))
    for pattern, by in PASSES:
        out = F.regexp_replace(out, pattern, by)
    return out


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    pairs = [F.lit(x) for pair in ALL_SENTENCES.items() for x in pair]

    def key(found):
        for pattern, by in JOINS:
            found = F.regexp_replace(found, pattern, by)
        return found

    return F.transform(F.regexp_extract_all(marked(text), F.lit(PATTERN), F.lit(1)), lambda s: F.element_at(F.create_map(*pairs), key(s)))


def covering(name: str, rule: str) -> list[str]:
    """Rules of other licences that contain a rule."""
    return [r for n, r in ALL_RULES if n != name and f" {rule} " in f" {r} "]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (blank-joined), licenses (distinct names in rule order, comma-joined) and license (the first).

    A rule matches where its identifiers follow each other among the known sentences. Null and empty texts and texts
    without a known sentence have empty strings and a null license. Repeated rows repeat; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", F.array_join(sentence_ids(text), " ").alias("sentence_ids"))
    line = F.concat(F.lit(" "), "sentence_ids", F.lit(" "))

    def rest(name, rule):
        out = line
        for longer in covering(name, rule):
            out = F.replace(out, F.lit(longer), F.lit(""))
        return out

    names = F.array_compact(F.array(*[F.when(rest(name, rule).contains(f" {rule} "), F.lit(name)) for name, rule in ALL_RULES]))
    found = found.withColumn("names", F.array_distinct(names))
    return found.select("doc_id", "sentence_ids", F.array_join("names", ",").alias("licenses"), F.when(F.size("names") > 0, F.element_at("names", 1)).alias("license"))


def oracle() -> str:
    """DuckDB's SQL of the given sentences, for texts without wrapped notices; it ends sentences at every single line end."""
    known = ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items())
    names = ", ".join(f"case when contains(' ' || sentence_ids || ' ', ' {rule} ') then '{name}' end" for name, rule in RULES)
    return f"""
with sentences as (
  select rowid_, doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[.!?;:]+(?:\\s+|$)|\\n+')) s, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[.!?;:]+(?:\\s+|$)|\\n+'), 1) i
  from (select row_number() over () rowid_, doc_id, text from documents)
), mapped as (
  select rowid_, doc_id, i, map {{{known}}}[trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.\\-]+', ' ', 'g'), '(^|\\s)[.\\-]+|[.\\-]+(\\s|$)', ' ', 'g'))] id from sentences
), lines as (
  select doc_id, coalesce(string_agg(id, ' ' order by i), '') sentence_ids from mapped group by rowid_, doc_id
), matched as (
  select doc_id, sentence_ids, list_filter([{names}], lambda x: x is not null) all_names from lines
), named as (
  select *, list_filter(all_names, lambda x, i: list_position(all_names, x) = i) names from matched
)
select doc_id, sentence_ids, array_to_string(names, ',') licenses, names[1] license from named"""
