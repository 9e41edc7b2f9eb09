"""License scans with a positional rare-token index.

Each template is a word sequence, a phrase or a licence's notice, with a mandatory key phrase. Over all documents the
document frequency of every key word is counted; the rarest words of a template's key phrase (those of the
highest IDF) are its postings. The index is a map from a word to the postings that it has: template and place. Every word
of a file is asked for once, whatever the number of templates; each posting gives the start that its template would have
there, and where all postings of a template agree on a start, the key phrase is verified word by word and the whole
template is compared for the score.

A start can only hold a key phrase if all its words stand there, so lookup by any of its words finds every
place; the IDF decides which words are looked up, never which places are found. No Python runs on
executors, nothing is shuffled but one counter for each key word. Whole texts of any length are scanned.

Null or empty texts have no words and no labels. Repeated rows each get their row. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, pick

#: Between words: ASCII characters that are neither digits nor lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: The mandatory key phrase: its first word in the template, and how many words it has.
    key_at: int
    key_len: int
    base: bool = False

    @property
    def key(self) -> tuple[str, ...]:
        return self.words[self.key_at : self.key_at + self.key_len]


def template(label: str, text: str, key: str, base: bool = False) -> Template:
    words, k = tuple(text.split()), key.split()
    at = next(i for i in range(len(words)) if list(words[i : i + len(k)]) == k)
    return Template(label, words, at, len(k), base)


#: The phrases of the contract; every place of one of them counts.
BASE = (
    template("mit", "mit license", "mit license", base=True),
    template("apache", "apache license", "apache license", base=True),
    template("gpl", "general public license", "general public license", base=True),
)
#: Well-known license wordings beside them: lines that name a licence, and the notices and opening clauses of licences. Fixed values.
MORE = (
    template("apache", "licensed under the apache license version 2 0", "the apache license version 2 0"),
    template("mit", "released under the mit license", "under the mit license"),
    template("gpl", "licensed under the gnu general public license version 3", "gnu general public license version"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    template("cc", "licensed under a creative commons attribution license", "creative commons attribution"),
    template("cc0", "creative commons cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    template("boost", "distributed under the boost software license version 1 0", "boost software license"),
    template("epl", "made available under the terms of the eclipse public license v 2 0", "eclipse public license"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "permission is hereby granted free of charge"),
    template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "unless required by applicable law or agreed to in writing"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution and use in source and binary forms"),
    template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "under the terms of the gnu general public license"),
    template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    template("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute"),
    template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license"),
    template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software"),
    template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "will the authors be held liable for any damages arising"),
)
TEMPLATES = BASE + MORE


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents in all, and those with each word of the templates. The result is as small as the vocabulary."""
    hit = F.array_intersect("w", F.array(*map(F.lit, vocabulary)))
    # every document adds a row without a word, which counts the documents
    rows = words.select(F.explode(F.concat(hit, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


def postings(templates: tuple[Template, ...], n: int, df: dict[str, int], most: int) -> list[list[tuple[int, str]]]:
    """For each template the places and words of the highest IDF in its key phrase, rarest first; ties: leftmost."""
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1))
    out = []
    for t in templates:
        places = sorted(range(t.key_at, t.key_at + t.key_len), key=lambda i: (-idf(t.words[i]), i))
        out.append([(i, t.words[i]) for i in places[:most]])
    return out


#: A start is a long: the template's number above, and below it the place in the file's words, to which ZERO is added.
PLACE_BITS, ZERO = 32, 1 << 16


def index_of(templates_postings: list[list[tuple[int, str]]], level: int) -> Column:
    """A map from word to the starts, for a word at place 0, of the templates that have it as their posting of this level (or their last)."""
    by: dict[str, list[int]] = {}
    for t, posts in enumerate(templates_postings):
        place, word = posts[min(level, len(posts) - 1)]
        by.setdefault(word, []).append((t << PLACE_BITS) + ZERO - place)
    entries = [x for w, starts in sorted(by.items()) for x in (F.lit(w), F.array(*[F.lit(s).cast("long") for s in starts]))]
    return F.create_map(*entries)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, lookups: int = 2) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and matches: an array of
    (label, starts) for each template that was found. lookups: postings that must agree before a key phrase
    is verified (fewer, if the phrase is shorter)."""
    words = pick(docs, "doc_id", "text").select("doc_id", words_of(F.col("text")).alias("w"))
    vocabulary = sorted({w for t in templates for w in t.key})
    n, df = document_frequencies(words, vocabulary)
    posts = postings(templates, n, df, lookups)
    w, none = F.col("w"), F.array().cast("array<long>")
    rare = sorted({word for p in posts for _, word in p})
    table = lambda values: F.array(*values)
    key_at, key_len = table([F.lit(t.key_at) for t in templates]), table([F.lit(t.key_len) for t in templates])
    keys, wholes = (table([F.array(*map(F.lit, ws)) for ws in each]) for each in ([t.key for t in templates], [t.words for t in templates]))
    label, is_base = table([F.lit(t.label) for t in templates]), table([F.lit(t.base) for t in templates])
    number = lambda s: F.shiftright(s, PLACE_BITS).cast("int")
    start = lambda s: (s.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) - ZERO).cast("int")

    looked_up = words.withColumn("hits", F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(*rare), i))))

    def starts(index: Column) -> Column:
        return F.flatten(F.transform("hits", lambda i: F.transform(F.coalesce(F.try_element_at(index, F.get(w, i)), none), lambda s: s + i)))

    agreed = reduce(F.array_intersect, [starts(index_of(posts, level)) for level in range(lookups)])
    agreed = F.when(F.size("hits") > 0, agreed).otherwise(none)

    def verified(s: Column) -> Column:
        t, at = number(s), start(s) + F.get(key_at, number(s))
        return (at >= 0) & (F.slice(w, F.greatest(at, F.lit(0)) + 1, F.get(key_len, t)) == F.get(keys, t))

    def agreement(s: Column) -> Column:
        whole = F.get(wholes, number(s))
        same = F.transform(whole, lambda x, j: F.when(F.get(w, start(s) + j) == x, 1).otherwise(0))
        return F.aggregate(same, F.lit(0), lambda a, x: a + x) / F.size(whole).cast("double")

    found = looked_up.withColumn("agreed", agreed).withColumn("found", F.filter("agreed", verified))
    base = F.filter("found", lambda s: F.get(is_base, number(s)))
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda s: F.get(label, number(s))))), ",")
    own = lambda t: F.transform(F.filter("found", lambda s: number(s) == t), start)
    return found.withColumn("base", base).select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", start)).cast("long").alias("first_word"),
        F.array_max(F.transform("base", start)).cast("long").alias("last_word"),
        labels("base").alias("base_labels"),
        labels("found").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", agreement)), F.lit(0.0)).alias("score"),
        F.transform(F.array_sort(F.array_distinct(F.transform("found", number))), lambda t: F.struct(F.get(label, t).alias("label"), own(t).alias("starts"))).alias("matches"),
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL for the digest columns of the query: every place of a key's first word is compared with the whole key."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = ",\n".join(f"('{t.label}', {str(t.base).lower()}, {t.key_at}, {quoted(t.key)}, {quoted(t.words)})" for t in templates)
    return f"""
WITH t(label, base, key_at, phrase, whole) AS (VALUES {rows}), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), u AS (
  SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d
), p AS (
  SELECT u.r, u.i, t.* FROM u JOIN t ON u.x = t.phrase[1]
), m AS (
  SELECT p.*, list_sum(list_transform(range(len(whole)), lambda j: CASE WHEN i - key_at + j >= 0 AND w[i - key_at + j + 1] = whole[j + 1] THEN 1 ELSE 0 END)) / len(whole)::DOUBLE AS share
  FROM p JOIN d USING (r) WHERE w[i + 1 : i + len(phrase)] = phrase
), g AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score
  FROM m GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)"""
