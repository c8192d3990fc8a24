"""Licence scans: phrase places and an exact set-similarity join with notice templates (DataFrame operations only).

Texts are lower-cased (A-Z) and cut into words. Templates are put in classes by their number
of words; a class's blocks are runs of consecutive words somewhat longer than its longest
template, a new one beginning so soon that a span as long as that template lies whole in
some block wherever it stands. A block matches a template when it holds at least
THRESHOLD_PERCENT of the template's distinct words; templates of fewer than SHORT distinct
words, where a few common ones would do, need all of them. The join is exact: the distinct
words of all templates are ordered by the number of documents that hold them (rarest first,
counted over the whole table). With a the overlap that a template asks for,
  prefix filter: the block's words in this order, all but its last a - 1, meet the
  template's, all but its last a - 1; texts without a word of any template's are not cut;
  length filter: the block has at least a words of the vocabulary;
  positional filter: after the first common word both sides have a - 1 words or more left;
what remains is counted in full. The templates are a parameter and stand as data in the plan,
which grows with their classes only; the document counts of their words are all that reaches the driver.

Null texts count as empty; rows keep their place one by one, so repeated rows and null
ids need no rule. A column named scan is replaced.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: Phrases and labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licence notices as their publishers ask authors to give them (fixed values).
TEMPLATES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
)
THRESHOLD_PERCENT, SHORT = 80, 16

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_in(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def template_words(text: str) -> list[str]:
    return sorted(set(words_in(text)))


def needed(size: int, percent: int) -> int:
    """The least overlap that a template of size distinct words asks for."""
    return size if size < SHORT else -(-size * percent // 100)


def block_class(words: int) -> tuple[int, int]:
    """(longest template, words of a block) of the class of a template: classes grow by half, blocks have a quarter more."""
    longest = 8
    while longest < words:
        longest += longest // 2
    return longest, longest + -(-longest // 4)


def classes(templates=TEMPLATES) -> dict[tuple[int, int], list[tuple[int, str, list[str]]]]:
    """(words of a block, step): (number, label, distinct words) of its templates."""
    out: dict[tuple[int, int], list[tuple[int, str, list[str]]]] = {}
    for k, (label, text) in enumerate(templates):
        longest, block = block_class(len(words_in(text)))
        out.setdefault((block, block - longest + 1), []).append((k, label, template_words(text)))
    return out


def _spaced(text: Column) -> Column:
    """The words with one space before each and one at the end; a text without words is one space."""
    inner = F.trim(F.regexp_replace(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), _GAP, " "))
    return F.concat(F.lit(" "), inner, F.when(inner == "", "").otherwise(" "))


def _n_spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def _data(value: object, kind: str) -> Column:
    """A constant as data; it is folded before the plan runs."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def vocabulary(docs: DataFrame, text_col: str, templates=TEMPLATES) -> list[str]:
    """The templates' words, those in the fewest documents first."""
    words = sorted({w for _, t in templates for w in template_words(t)})
    held = F.array_intersect(_data(words, "array<string>"), F.split(_spaced(text_of(text_col)), " "))
    counts = dict(docs.select(F.explode(held).alias("word")).groupBy("word").count().collect())  # a row for each word of the templates at most
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def block_matches(words: Column, order: list[str], templates=TEMPLATES, percent: int = THRESHOLD_PERCENT) -> Column:
    """array<struct<start, label, template, containment>>: the matching blocks of an array of words."""
    rank = {w: i for i, w in enumerate(order)}

    def passes(b: Column, t: Column) -> Column:
        prefix = F.slice(b, 1, F.greatest(F.size(b) - t["a"] + 1, F.lit(0)))
        meet = F.element_at(F.array_intersect(prefix, t["head"]), 1)
        left = F.least(F.size(b) - F.array_position(b, meet), t["n"] - F.array_position(t["words"], meet))
        return (F.size(b) >= t["a"]) & F.arrays_overlap(prefix, t["head"]) & (left >= t["a"] - 1) & (F.size(F.array_intersect(b, t["words"])) >= t["a"])

    def matches(x: Column, all_: Column) -> Column:
        hit = F.filter(all_, lambda t: passes(x["b"], t))
        return F.transform(hit, lambda t: F.struct(x["start"].alias("start"), t["label"].alias("label"), t["k"].alias("template"), (F.size(F.array_intersect(x["b"], t["words"])) / t["n"]).alias("containment")))

    def of_class(block: int, step: int, known: list[dict]) -> Column:
        heads = _data(sorted({w for t in known for w in t["head"]}), "array<string>")
        own = _data(sorted({w for t in known for w in t["words"]}, key=rank.get), "array<string>")
        all_ = _data(known, "array<struct<k: int, label: string, a: int, n: int, words: array<string>, head: array<string>>>")
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step))
        blocks = F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.array_intersect(own, F.slice(words, i + 1, F.lit(block))).alias("b")))
        blocks = F.filter(blocks, lambda x: F.size(x["b"]) >= min(t["a"] for t in known))
        return F.when(F.arrays_overlap(words, heads), F.flatten(F.transform(blocks, lambda x: matches(x, all_))))

    none = F.array().cast("array<struct<start: bigint, label: string, template: int, containment: double>>")
    out = [none]
    for (block, step), own in sorted(classes(templates).items()):
        known = []
        for k, label, distinct in own:
            t = sorted(distinct, key=rank.get)
            a = needed(len(t), percent)
            known.append({"k": k, "label": label, "a": a, "n": len(t), "words": t, "head": t[: len(t) - a + 1]})
        out.append(F.coalesce(of_class(block, step, known), none))
    return F.concat(*out)


def license_scan(docs: DataFrame, text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """docs' columns and scan: struct<n_words, n_base, first_word, last_word, base_labels, matches, labels, score>."""
    order = vocabulary(docs, text_col, templates)
    keep = [c for c in docs.columns if c != "scan"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), _spaced(text_of(text_col)).alias("j"))
    # Cut before each phrase: all parts but the first begin with one.
    cut = r"(?<= )(?=(?:" + "|".join(phrases) + r") )"
    rows = rows.select("row", "j", F.split("j", cut, -1).alias("parts"), F.when(F.col("j") == " ", F.array().cast("array<string>")).otherwise(F.split(F.trim("j"), " ")).alias("words"))
    n_words = _n_spaces(F.col("j")) - 1
    n = (F.size("parts") - 1).cast("long")
    base = F.array_sort(F.array_distinct(F.transform(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda s: F.coalesce(*[F.when(s.startswith(p + " "), label) for p, label in sorted(phrases.items(), key=lambda x: -len(x[0]))]))))
    first = F.when(n > 0, _n_spaces(F.element_at("parts", 1)) - 1)
    last = F.when(n > 0, n_words - _n_spaces(F.element_at("parts", -1)))
    out = rows.select("row", F.struct(n_words.alias("n_words"), n.alias("n_base"), first.alias("first_word"), last.alias("last_word"), base.alias("base_labels"), block_matches(F.col("words"), order, templates, percent).alias("matches")).alias("s"))
    labels = F.array_sort(F.array_distinct(F.concat("s.base_labels", F.col("s.matches.label"))))
    score = F.when(F.col("s.n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("s.matches.containment"), F.lit(0.0)))
    return out.select("row.*", F.struct("s.*", labels.alias("labels"), score.alias("score")).alias("scan"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = license_scan(docs)
    return s.select("doc_id", *[F.col(f"scan.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word")], F.array_join("scan.base_labels", ",").alias("base_labels"), F.array_join("scan.labels", ",").alias("labels"), "scan.score")


def _sql() -> str:
    """Every block against every template of its class, without filters, in texts that hold enough of the template's words at all."""
    rows = [(k, label, words, needed(len(words), THRESHOLD_PERCENT), block, step) for (block, step), own in classes().items() for k, label, words in own]
    lists = ", ".join(f"({k}, '{label}', [{', '.join(repr(w) for w in words)}], {a}, {block}, {step})" for k, label, words, a, block, step in rows)
    at = "list_concat(" * (len(PHRASES) - 1)
    for k, (p, label) in enumerate(PHRASES.items()):
        w = p.split()
        one = f"[{{'i': i - 1, 'l': '{label}'}} FOR i IN range(1, len(w) + 1) IF " + " AND ".join(f"w[i + {j}] = '{x}'" if j else f"w[i] = '{x}'" for j, x in enumerate(w)) + "]"
        at += one if not k else f", {one})"
    lower = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({lower}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
t(k, label, words, a, block, step) AS (VALUES {lists}),
base AS MATERIALIZED (SELECT doc_id, len(w) AS n, {at} AS p FROM w),
d AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(w) AS x FROM w),
v AS MATERIALIZED (SELECT k, unnest(words) AS x, a FROM t),
maybe AS (SELECT doc_id, k FROM d JOIN v ON d.x = v.x GROUP BY ALL HAVING count(*) >= any_value(a)),
blocks AS (SELECT doc_id, label, words, a, w[i + 1 : i + block] AS b FROM (SELECT w.doc_id, w, label, words, a, block, unnest(range(0, len(w), step)) AS i FROM w JOIN maybe ON maybe.doc_id = w.doc_id JOIN t ON t.k = maybe.k)),
m AS (SELECT doc_id, label, len(list_intersect(words, list_distinct(b))) AS o, len(words) AS s, a FROM blocks),
best AS (SELECT doc_id, list(DISTINCT label) AS labels, max(o / s) AS c FROM m WHERE o >= a GROUP BY doc_id)
SELECT base.doc_id, n AS n_words, len(p) AS n_base, list_min([x.i FOR x IN p]) AS first_word, list_max([x.i FOR x IN p]) AS last_word,
       array_to_string(list_sort(list_distinct([x.l FOR x IN p])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat([x.l FOR x IN p], coalesce(labels, [])))), ',') AS labels,
       CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM base LEFT JOIN best ON base.doc_id = best.doc_id
"""


SQL = _sql()
