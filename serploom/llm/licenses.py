"""License scans with a positional rare-token index, in DataFrame expressions only.

The index holds, for each word of the license templates, the templates and positions it stands at, and its
inverse document frequency over the templates. Of a document only the words of the index are kept, with their
positions. For each template its rarest word is looked up first; only documents that have it read the postings
of the other words. Postings are shifted by the word's place in the template, so that equal numbers mean the
same relative position; intersecting those of a mandatory key phrase gives the places where it stands whole.
A template's label needs each of its key phrases; its score is the share of template words that stand at their
relative position to a verified place.

Postings are intersected by hashing, so the work is linear in the text; nothing is shuffled or broadcast.

Defined results: a null or empty text has no words, no places and score 0; places may overlap and repeat;
repeated rows are scanned each by itself; extra columns stay untouched; the whole text is read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom.llm.common import LOWER, UPPER, WORD_PATTERN, fresh


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: phrases of the text that must stand whole, as (first word, number of words)
    keys: tuple[tuple[int, int], ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


def _template(label: str, text: str, *phrases: str, base: bool = False) -> Template:
    words = text.split()
    keys = []
    for phrase in phrases or (text,):
        p = phrase.split()
        keys.append((next(i for i in range(len(words)) if words[i : i + len(p)] == p), len(p)))
    return Template(label, text, tuple(keys), base)


#: base phrases, then notices of public licenses with their mandatory key phrases (fixed values)
TEMPLATES = [
    _template("mit", "under the mit license", base=True),
    _template("apache-2", "apache license version 2", base=True),
    _template("cc-by-nc", "cc by nc", base=True),
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
              "documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge",
              "to deal in the software without restriction"),
    _template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
              "apache license version 2"),
    _template("gpl-3", "gnu general public license version 3", "gnu general public license version 3"),
    _template("gpl-2", "gnu general public license version 2", "gnu general public license version 2"),
    _template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    _template("agpl-3", "gnu affero general public license version 3", "gnu affero general public license"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
              "following conditions are met", "redistribution and use in source and binary forms", "following conditions are met"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
              "permission to use copy modify", "with or without fee is hereby granted"),
    _template("mpl-2", "mozilla public license v 2 0", "mozilla public license"),
    _template("epl", "eclipse public license", "eclipse public license"),
    _template("cc-by-sa", "cc by sa", "cc by sa"),
    _template("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial"),
    _template("cc0", "cc0 1 0 universal", "cc0 1 0"),
    _template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]

VOCABULARY = sorted({w for t in TEMPLATES for w in t.words})
_DOCUMENTS = {w: sum(w in t.words for t in TEMPLATES) for w in VOCABULARY}
#: inverse document frequency over the templates
IDF = {w: math.log(len(TEMPLATES) / n) for w, n in _DOCUMENTS.items()}


def rarest(words: list[str]) -> str:
    """The word of highest idf; of equals the longest, then the first."""
    return max(words, key=lambda w: (IDF[w], len(w), -words.index(w)))


def _postings(hits: Column, word: str, shift: int) -> Column:
    """Positions of a word, less its place in the template."""
    return F.transform(F.filter(hits, lambda h: h.w == word), lambda h: h.i - shift)


def _verified(hits: Column, template: Template) -> Column:
    """Places (of the template's first word) where every key phrase stands whole."""
    words = template.words
    places = sorted({i for start, n in template.keys for i in range(start, start + n)}, key=lambda i: (-IDF[words[i]], i))
    return reduce(F.array_intersect, [_postings(hits, words[i], i) for i in places])


def words_in(text: Column) -> Column:
    """Words of a whole text, A-Z lower-cased (null: none)."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD_PATTERN), F.lit(0))


def with_licenses(docs: DataFrame, text: str = "text", out: str = "licenses") -> DataFrame:
    """Adds a struct: n_words, n_base, first_word, last_word, base_labels, labels, score, found (label, place, score)."""
    words, hits, places = fresh(docs, "words", "hits", "places")
    table = docs.withColumn(words, words_in(F.col(text)))
    # of each word only what the index holds
    indexed = F.transform(F.col(words), lambda w, i: F.when(w.isin(VOCABULARY), F.struct(w.alias("w"), i.alias("i"))))
    table = table.withColumn(hits, F.filter(indexed, lambda h: h.isNotNull()))
    anchors = sorted({rarest([t.words[i] for s, n in t.keys for i in range(s, s + n)]) for t in TEMPLATES})
    (present, n_words) = fresh(table, "present", "n_words")
    table = table.withColumns({
        present: F.array_distinct(F.transform(F.filter(F.col(hits), lambda h: h.w.isin(anchors)), lambda h: h.w)),
        n_words: F.size(words).cast("bigint"),
    }).drop(words)
    empty = F.array().cast("array<int>")
    each = []
    for t in TEMPLATES:
        anchor = rarest([t.words[i] for s, n in t.keys for i in range(s, s + n)])
        each.append(F.when(F.array_contains(present, anchor), _verified(F.col(hits), t)).otherwise(empty))
    table = table.withColumn(places, F.array(*each))

    def score(k: int, t: Template) -> Column:
        own = F.element_at(places, k + 1)
        if t.base or t.keys == ((0, len(t.words)),):
            return F.when(F.size(own) > 0, F.lit(1.0))
        met = [F.arrays_overlap(_postings(F.col(hits), w, i), own).cast("int") for i, w in enumerate(t.words)]
        return F.when(F.size(own) > 0, reduce(lambda a, b: a + b, met) / F.lit(float(len(t.words))))

    base = [k for k, t in enumerate(TEMPLATES) if t.base]
    starts = F.flatten(F.array(*[F.element_at(places, k + 1) for k in base]))
    label = lambda ks: F.array_join(F.array_sort(F.array_distinct(F.filter(
        F.array(*[F.when(F.size(F.element_at(places, k + 1)) > 0, F.lit(TEMPLATES[k].label)) for k in ks]), lambda x: x.isNotNull()))), ",")
    found = F.filter(
        F.array(*[F.struct(F.lit(t.label).alias("label"), F.element_at(places, k + 1).alias("places"), score(k, t).alias("score"))
                  for k, t in enumerate(TEMPLATES)]),
        lambda x: F.size(x.places) > 0,
    )
    (found_name, start_name) = fresh(table, "found", "starts")
    table = table.withColumns({found_name: found, start_name: starts})
    value = F.struct(
        F.col(n_words).alias("n_words"), F.size(start_name).cast("bigint").alias("n_base"),
        F.array_min(start_name).cast("bigint").alias("first_word"), F.array_max(start_name).cast("bigint").alias("last_word"),
        label(base).alias("base_labels"), label(range(len(TEMPLATES))).alias("labels"),
        F.coalesce(F.array_max(F.transform(found_name, lambda x: x.score)), F.lit(0.0)).alias("score"), F.col(found_name).alias("found"),
    )
    return table.withColumn(out, value).drop(hits, present, n_words, places, found_name, start_name)
