"""License scan: exact set-similarity join of text blocks (paragraphs) with license templates, and base phrases.

A block is a paragraph: lines up to one that holds nothing but white space and comment marks, so a
notice that is wrapped over several lines, in a comment or not, is one block. A block holds a template if at least `threshold` of the template's different words occur in it. The
tokens of every template are put in ascending order of the number of documents of the whole input
that hold them. Filters, all exact: a block must hold one of the template's first
size - required + 1 tokens (prefix), at least `required` different words (length), and its first
matching token must stand early enough that `required` tokens can still follow (position); what
passes is counted. The templates are fixed and few, so the join runs inside each row, without a
shuffle; only the token counts, as many as the templates have words, reach the driver.
DataFrame functions throughout.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.8
BREAK = r"\n([ \t\r#*/;%!-]*\n)+"  # between two paragraphs: lines without anything but white space and comment marks

# Base phrases and license notices.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:",
    "mit-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
}


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case and nothing else; for plain ASCII text `lower` is the same and quicker."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)


def template_tokens(templates: dict[str, str]) -> dict[str, list[str]]:
    import re

    return {k: sorted(set(re.findall(WORD, t.translate(str.maketrans(UPPER, LOWER))))) for k, t in templates.items()}


def token_counts(low: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many rows of `low` each of the tokens occurs; one number a token reaches the driver."""
    if not tokens:
        return {}
    vocabulary = F.array(*[F.lit(t) for t in sorted(tokens)])
    held = low.select(F.explode(F.array_intersect(vocabulary, words(F.col("low")))).alias("token"))
    return {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}


def _starts(phrase: str) -> Column:
    """Word numbers at which the phrase stands in column `w`."""
    parts = phrase.split()
    hit = lambda i: _all([F.get("w", i + n) == p for n, p in enumerate(parts)])
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - len(parts), F.lit(0))), lambda i: F.coalesce(hit(i), F.lit(False)))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, places (struct word, label), matches (struct block, label, containment).

    places: every start of a base phrase, in words from 0. matches: every block (paragraph, from 0) and
    template label with a containment of `threshold` or more. Null counts as empty text, which has
    neither; texts of any length are taken whole; repeated rows give repeated results; null ids stay null; other columns are ignored.
    """
    low = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    tokens = template_tokens(templates)
    counts = token_counts(low, set().union(*tokens.values()))
    ordered = {k: sorted(v, key=lambda t: (counts.get(t, 0), t)) for k, v in tokens.items()}
    required = {k: max(1, ceil(threshold * len(v) - 1e-9)) for k, v in ordered.items()}
    prefix = {k: v[: len(v) - required[k] + 1] for k, v in ordered.items()}

    some_phrase = F.lit(False)
    for phrase in phrases:
        some_phrase = some_phrase | F.contains("low", F.lit(max(phrase.split(), key=len)))
    some_token = F.lit(False)
    for token in sorted(set().union(*prefix.values())):
        some_token = some_token | F.contains("low", F.lit(token))
    no_words = F.array().cast("array<string>")
    rows = low.select(
        "doc_id", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"),
        F.when(some_phrase, words(F.col("low"))).otherwise(no_words).alias("w"),
        # the prefix filter, on the text of a block: a cheap superset of the test on its words
        F.when(some_token, F.split("low", BREAK)).otherwise(no_words).alias("blocks"),
    )

    def located(phrase: str, label: str) -> Column:
        return F.transform(_starts(phrase), lambda i: F.struct(i.cast("long").alias("word"), F.lit(label).alias("label")))

    place = [located(*x) for x in phrases.items()]

    def match(block: Column, number: Column) -> Column:
        w = F.array_distinct(words(block))
        found = []
        for label, own in ordered.items():
            size, need = len(own), required[label]
            overlap = F.size(F.array_intersect(F.array(*[F.lit(t) for t in own]), w))
            # the first of the ordered tokens that the block holds; later ones are all that can follow
            first = F.coalesce(*[F.when(F.array_contains(w, t), F.lit(i)) for i, t in enumerate(prefix[label])])
            able = (F.size(w) >= need) & first.isNotNull() & (size - first >= need)
            some = F.lit(False)
            for t in prefix[label]:
                some = some | F.contains(block, F.lit(t))
            contained = F.when(some, F.when(able, F.when(overlap >= need, overlap.cast("double") / size)))
            found.append(F.struct(number.cast("long").alias("block"), F.lit(label).alias("label"), contained.alias("containment")))
        return F.filter(F.array(*found), lambda m: m["containment"].isNotNull())

    nothing = F.array().cast("array<struct<word:long,label:string>>")
    none = F.array().cast("array<struct<block:long,label:string,containment:double>>")
    return rows.select(
        "doc_id", "n_words",
        (F.when(F.size("w") > 0, F.flatten(F.array(*place))).otherwise(nothing) if place else nothing).alias("places"),
        (F.when(F.size("blocks") > 0, F.flatten(F.transform("blocks", match))).otherwise(none) if ordered else none).alias("matches"),
    )


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base, more = F.transform("places", lambda p: p["label"]), F.transform("matches", lambda m: m["label"])
    n = F.size("places").cast("long")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", n.alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def _oracle() -> str:
    tokens = template_tokens(TEMPLATES)
    values = ", ".join(f"('{k}', [{', '.join(repr(t) for t in v)}])" for k, v in tokens.items())
    phrase = lambda p: " AND ".join(f"w[i + {n}] = '{x}'" for n, x in enumerate(p.split()))
    places = " UNION ALL ".join(f"SELECT r, i - 1 AS word, '{label}' AS label FROM p WHERE {phrase(text)}" for text, label in PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(low, '{WORD}') AS w FROM d),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w),
b AS ({places}),
t(label, own) AS (VALUES {values}),
l AS (SELECT r, unnest(string_split_regex(low, '{BREAK}')) AS line FROM d),
m AS (SELECT r, label, len(list_intersect(own, regexp_extract_all(line, '{WORD}'))) / CAST(len(own) AS DOUBLE) AS c FROM l, t),
base AS (SELECT r, count(*) AS n, min(word) AS a, max(word) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM b GROUP BY r),
held AS (SELECT r, max(c) AS c FROM m WHERE c >= {THRESHOLD} GROUP BY r),
labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM
  (SELECT r, label FROM b UNION ALL SELECT r, label FROM m WHERE c >= {THRESHOLD}) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
  coalesce(base.s, '') AS base_labels, coalesce(labels.s, '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(held.c, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN held USING (r) LEFT JOIN labels USING (r)"""


QUERIES = {"op8_licenses": op8_licenses}
ORACLE = {"op8_licenses": _oracle()}
