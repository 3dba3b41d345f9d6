"""Licence scan through a positional rare-token index.

Each licence template (a whole licence text, a standard header or a one-line
notice) is a word sequence with a mandatory key phrase.  The corpus document
frequencies of the key phrases' words (a table bounded by the templates'
vocabulary) give every such word an IDF.  The index holds, for every
template, the posting of its key phrase's highest-IDF word: a match must contain
that word, so a lookup by it misses none.  A word found at ``i`` whose posting
in the template is ``o`` proposes the start ``i - o``; the template's other
postings are intersected at the same relative positions, and the key phrase is
verified.  The score is the share of all the template's words that stand in
place, so a cut or edited copy scores what is left of the whole.
Base phrases are templates that are key phrase throughout.  All of it is
DataFrame code inside one row: no shuffle but the frequency count, whose groups
are the templates' words.

Words: A-Z are lower-cased (no other letter), then
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Defined results: null or empty texts have no words, no places, empty labels
and score 0.  Rows that repeat an id are scanned each.  Of equally good places
of a template the first counts.  A text is scanned whole, as one array of words
in its row: memory grows with the longest text, by about 50 bytes a word, and
the work with the words and with the places where a key phrase's word stands.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.llm._common import id_and_text, table
from trendlens.llm.license_texts import TEXTS

#: Phrases of the base and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: One-line notices and opening words of public licence texts, with
#: the key phrase without which a match does not count.
NOTICES = {
    "agpl-3": ("licensed under the gnu affero general public license version 3", "affero general public license version 3"),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "apache license version 2",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    "cc-by": ("licensed under the creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "cc by sa"),
    "gpl-2": ("licensed under the gnu general public license version 2", "gnu general public license version 2"),
    "gpl-3": ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "for any purpose with or without fee is hereby granted",
    ),
    "lgpl-3": ("licensed under the gnu lesser general public license version 3", "lesser general public license version 3"),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "hereby granted free of charge to any person obtaining a copy",
    ),
    "mit-notice": ("released under the mit license", "the mit license"),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mozilla public license v 2 0",
    ),
}

#: All templates: the notices, and whole texts and headers.
TEMPLATES = {**NOTICES, **{name: (text, key) for name, (_, text, key) in TEXTS.items()}}

#: Labels of templates whose name is not their label.
LABELS = {"mit-notice": "mit", **{name: label for name, (label, _, _) in TEXTS.items()}}
MIN_SCORE = 0.5


def template_words(text: str) -> list[str]:
    """Words of a template, as :func:`word_array` finds them in documents."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def word_array(text: Column) -> Column:
    """Lower-cased words.  The Kelvin sign is the one other character whose
    lower case is an ASCII letter, so it is set aside first."""
    lowered = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00df")))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def word_idf(docs: DataFrame, vocabulary: set[str], text_col: str = "text") -> dict[str, float]:
    """IDF of the templates' words over all documents.  What reaches the driver
    is one count for each word of the templates."""
    known = F.array(*[F.lit(w) for w in sorted(vocabulary)])
    found = docs.select(F.explode(F.concat(F.array_intersect(word_array(docs[text_col]), known), F.array(F.lit("")))).alias("word"))
    df = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = df.pop("", 0)
    return {w: math.log((total + 1) / (df.get(w, 0) + 1)) for w in vocabulary}


def anchor(phrase: list[str], idf: Mapping[str, float]) -> int:
    """Place of the phrase's highest-IDF word."""
    return max(range(len(phrase)), key=lambda o: (idf[phrase[o]], phrase[o], -o))


def _stands(words: Column, start: Column, phrase: list[str]) -> Column:
    """Whether the phrase stands at ``start`` (0-based); null-safe at the edges."""
    return reduce(lambda a, b: a & b, [F.get(words, start + o).eqNullSafe(F.lit(w)) for o, w in enumerate(phrase)])


def _starts(hits: Column, word: str, offset: int) -> Column:
    """Proposed starts from the places of ``word``, whose posting is ``offset``."""
    return F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: h["i"] - F.lit(offset))


def _phrase_places(words: Column, hits: Column, phrase: list[str], anchor: int, label: str) -> Column:
    starts = F.filter(_starts(hits, phrase[anchor], anchor), lambda s: _stands(words, s, phrase))
    last = len(phrase) - 1
    return F.transform(
        starts, lambda s: F.struct(F.lit(label).alias("label"), s.cast("long").alias("first"), (s + last).cast("long").alias("last"))
    )


def _best_start(words: Column, hits: Column, label: str, template: list[str], key: list[str], key_at: int, anchor_at: int) -> Column:
    """The proposed start at which most postings meet, the first of equals."""
    postings = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in enumerate(template)])

    def scored(s: Column) -> Column:
        met = F.filter(postings, lambda p: F.get(words, s + p["o"]).eqNullSafe(p["w"]))
        return F.struct((F.size(met) / len(template)).alias("score"), (-s).cast("long").alias("back"), F.lit(label).alias("label"))

    proposed = F.filter(_starts(hits, key[anchor_at], key_at + anchor_at), lambda s: _stands(words, s + key_at, key))
    return F.array_max(F.transform(proposed, scored))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, tuple[str, str]] = TEMPLATES,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, places`` (array of label,
    first word, last word of every phrase), ``matches`` (array of label, start,
    score of the best place of each template at or above ``min_score``)."""
    rows = id_and_text(docs, id_col, text_col)
    split_phrases = {p: p.split(" ") for p in phrases}
    split_templates = {n: (template_words(t), template_words(k)) for n, (t, k) in templates.items()}
    idf = word_idf(rows, {w for ws in [*split_phrases.values(), *(k for _, k in split_templates.values())] for w in ws})

    phrase_at = {p: anchor(ws, idf) for p, ws in split_phrases.items()}
    key_at = {n: next(o for o in range(len(t)) if t[o : o + len(k)] == k) for n, (t, k) in split_templates.items()}
    in_key = {n: anchor(k, idf) for n, (_, k) in split_templates.items()}
    looked_up = sorted({split_phrases[p][o] for p, o in phrase_at.items()} | {split_templates[n][1][o] for n, o in in_key.items()})

    rare = F.array(*[F.lit(w) for w in looked_up])
    rows = rows.withColumn("words", word_array(F.col("text")))
    none = F.expr("cast(array() as array<struct<i:int,w:string>>)")
    indexed = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: h["w"].isin(looked_up))
    rows = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), "words", F.when(F.arrays_overlap("words", rare), indexed).otherwise(none).alias("hits")
    )

    words, hits = F.col("words"), F.col("hits")
    places = [_phrase_places(words, hits, ws, phrase_at[p], phrases[p]) for p, ws in split_phrases.items()]
    best = [
        _best_start(words, hits, LABELS.get(n, n), t, k, key_at[n], in_key[n]) for n, (t, k) in split_templates.items()
    ]
    found = F.filter(F.array(*best), lambda b: b.isNotNull() & (b["score"] >= min_score))
    # rows without any looked-up word skip the work
    some = F.size("hits") > 0
    no_places = F.expr("cast(array() as array<struct<label:string,first:bigint,last:bigint>>)")
    no_matches = F.expr("cast(array() as array<struct<label:string,start:bigint,score:double>>)")
    return rows.select(
        "doc_id",
        "n_words",
        F.when(some, F.concat(*places)).otherwise(no_places).alias("places"),
        F.when(
            some,
            F.transform(found, lambda b: F.struct(b["label"].alias("label"), (-b["back"]).alias("start"), b["score"].cast("double").alias("score"))),
        )
        .otherwise(no_matches)
        .alias("matches"),
    )


def _sql() -> str:
    """The query in DuckDB: every place of every phrase and key phrase, without an index."""
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = [f"(true, '{label}', {listed(p.split(' '))}, {listed(p.split(' '))}, 0)" for p, label in PHRASES.items()]
    for name, (text, key) in TEMPLATES.items():
        t, k = template_words(text), template_words(key)
        at = next(o for o in range(len(t)) if t[o : o + len(k)] == k)
        rows.append(f"(false, '{LABELS.get(name, name)}', {listed(t)}, {listed(k)}, {at})")
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
patterns(base, label, t, k, key_at) AS (VALUES {", ".join(rows)}),
pos AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
hits AS (
  SELECT d.r, base, label, i, len(list_filter(range(len(t)), lambda o: i - key_at + o >= 0 AND w[i - key_at + o + 1] = t[o + 1])) / len(t) AS score
  FROM pos JOIN patterns ON word = k[1] JOIN docs d ON d.r = pos.r WHERE w[i + 1 : i + len(k)] = k),
found AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM hits WHERE base OR score >= {MIN_SCORE} GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN found USING (r)
"""


SQL = _sql()


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``first_word`` and ``last_word``: smallest and largest start of a base phrase."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.col("places.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first").alias("first_word"),
        F.array_max("places.first").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("matches.label"))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.score"), F.lit(0.0))).alias("score"),
    )
