"""Licence scan with a positional index of rare words.

Licence notices are templates: word sequences with mandatory key phrases.  A word's weight is its
inverse document frequency, counted over all documents.  The index maps the rarest words of each
template to their places in it.  Every such word of a file is looked up; word place minus template
place gives the alignment that it votes for, and at each alignment the places of the other words are
intersected: the template is found if the words that stand where it has them carry at least its share
of the weight and all its key phrases stand at their places, word for word.

A template's rarest words are taken until they weigh more than an alignment may miss, so every
alignment that reaches the share is looked up: nothing is lost against trying all alignments.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Template(NamedTuple):
    """``words`` of a notice, its ``label``, its mandatory phrases and the share of the weight (in
    hundredths) that must be found."""

    label: str
    words: str
    keys: tuple[str, ...] = ()
    share: int = 100


# The phrases that are always reported, each found word for word.
BASE = (
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
)

# Sentences of public licence notices.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",), 70),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",), 70),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",), 70),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("names of its contributors",), 70),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",), 70),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",), 70),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",), 70),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",), 70),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",), 70),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",), 70),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",), 70),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",), 70),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",), 70),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",), 70),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge to any person",), 70),
    Template("mit", "released under the mit license", ("mit license",), 70),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",), 70),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",), 70),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",), 70),
)

#: All templates together hold at most so many words: the index goes to every task.
MAX_WORDS = 2_000_000

#: Bytes of a word stay (A-Z in lower case), all others part words; bytes from 128 belong to words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: runs of digits, letters A-Z in lower case and all beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def key_places(template: Template) -> list[int]:
    """The places of the template's words that its key phrases cover, the first of each phrase counting."""
    words, places = template.words.split(), set()
    for key in template.keys or (template.words,):
        k = key.split()
        at = next((i for i in range(len(words) - len(k) + 1) if words[i:i + len(k)] == k), None)
        if at is None:
            raise ValueError(f"key phrase {key!r} does not stand in its template")
        places.update(range(at, at + len(k)))
    return sorted(places)


class Index:
    """Postings of the rarest words of each template; ``find`` gives all alignments of all templates."""

    def __init__(self, templates: Sequence[Template], weight: dict[str, int]) -> None:
        self.words = [[w.encode() for w in t.words.split()] for t in templates]
        self.weight = [[weight[w] for w in t.words.split()] for t in templates]
        self.total = [sum(w) for w in self.weight]
        self.need = [-(-t.share * n // 100) for t, n in zip(templates, self.total)]
        self.keys = [key_places(t) for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, weights in enumerate(self.weight):
            spare = self.total[t] - self.need[t]  # an alignment may miss so much
            for p in sorted(range(len(weights)), key=lambda p: (-weights[p], p)):
                self.postings.setdefault(self.words[t][p], []).append((t, p))
                spare -= weights[p]
                if spare < 0:
                    break

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, place of its first word, weight found), in this order."""
        postings = self.postings
        votes = {(t, i - p) for i, w in enumerate(words) if w in postings for t, p in postings[w]}
        found, n = [], len(words)
        for t, start in sorted(votes):
            own = self.words[t]
            if not all(0 <= start + p < n and words[start + p] == own[p] for p in self.keys[t]):
                continue
            at = range(max(0, -start), min(len(own), n - start))
            matched = sum(self.weight[t][p] for p in at if words[start + p] == own[p])
            if matched >= self.need[t]:
                found.append((t, start, matched))
        return found


def word_weights(docs: DataFrame, vocabulary: Iterable[str], text_col: str = "text") -> dict[str, int]:
    """1000 ln(1 + documents / (1 + documents that hold the word)), rounded, of each word, over all
    documents; tasks send one count per word."""
    known = {w.encode() for w in vocabulary}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seen = 0, Counter()
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                seen.update(known.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_pydict({"word": pa.array([None, *(w.decode() for w in seen)], pa.string()), "n": pa.array([rows, *seen.values()], pa.int64())})

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r["word"]: r["n"] for r in counts.collect()}  # a row per word of the templates
    rows = n.pop(None, 0)
    return {w.decode(): round(1000 * math.log(1 + rows / (1 + n.get(w.decode(), 0)))) for w in known}


def scan(docs: DataFrame, base: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, matches, score) of every row: all places where a template is found in the whole text.

    ``matches`` holds (label, base, template, start, share) with ``start`` the place of the
    template's first word, from 0, and ``share`` the part of its weight that was found, ordered by
    template and place; ``template`` numbers base and notices through.  ``score`` is the largest
    share, 0 without a match.  A notice cut off by the text's end or start may have a start outside.

    Defined cases: null and empty texts have no words and no matches; a null id stays; repeated rows
    are judged row by row, ties in weight go to the earlier word; texts of any length are read whole;
    no rows give no rows; other columns are ignored."""
    templates = [*base, *notices]
    vocabulary = {w for t in templates for w in t.words.split()}
    if any(words_of(t.words) != [w.encode() for w in t.words.split()] or not t.words.split() for t in templates):
        raise ValueError("templates are words in lower case, parted by blanks")
    if sum(len(t.words.split()) for t in templates) > MAX_WORDS:
        raise ValueError(f"templates hold more than {MAX_WORDS} words")
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    index = Index(templates, word_weights(docs, vocabulary, text_col))
    labels, n_base = [t.label for t in templates], len(base)
    match = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("template", pa.int32()), ("start", pa.int64()), ("share", pa.float64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, matches = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                n_words.append(len(words))
                matches.append([{"label": labels[t], "base": t < n_base, "template": t, "start": start, "share": matched / index.total[t]}
                                for t, start, matched in index.find(words)])
            score = pa.array([max((m["share"] for m in found), default=0.0) for found in matches], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(matches, pa.list_(match)), score],
                                             names=[id_col, "n_words", "matches", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(read, f"`{id_col}` {kind}, n_words long, matches array<struct<label: string, base: boolean, "
                                 "template: int, start: long, share: double>>, score double")


def license_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    places = F.transform(F.filter("matches", lambda m: m["base"]), lambda m: m["start"])
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    return scan(docs).select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), joined(F.filter("matches", lambda m: m["base"])).alias("base_labels"),
        joined(F.col("matches")).alias("labels"), "score")


def license_sql() -> str:
    """The same in SQL, trying every alignment."""
    rows = []
    for t, template in enumerate([*BASE, *NOTICES]):
        keys = key_places(template)
        rows += [f"({t}, '{template.label}', {t < len(BASE)}, {template.share}, {p}, '{w}', {p in keys})" for p, w in enumerate(template.words.split())]
    return rf"""
WITH template(t, label, base, share, p, word, is_key) AS (VALUES {", ".join(rows)}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
placed AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
met AS (SELECT * FROM placed WHERE word IN (SELECT word FROM template)),
df AS (SELECT word, count(DISTINCT rid) AS n FROM met GROUP BY word),
weighed AS (
  SELECT template.*, round(1000 * ln(1 + (SELECT count(*) FROM d) / (1 + coalesce(df.n, 0))))::BIGINT AS weight
  FROM template LEFT JOIN df USING (word)),
total AS (SELECT t, label, base, share, sum(weight)::BIGINT AS total, count(*) FILTER (is_key) AS keys FROM weighed GROUP BY ALL),
aligned AS (
  SELECT m.rid, w.t, m.i - w.p AS start, sum(w.weight)::BIGINT AS matched, count(*) FILTER (w.is_key) AS keys
  FROM met m JOIN weighed w USING (word) GROUP BY ALL),
found AS (
  SELECT a.*, x.label, x.base, x.total FROM aligned a JOIN total x USING (t)
  WHERE a.keys = x.keys AND a.matched * 100 >= x.share * x.total),
summed AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(matched::DOUBLE / total::DOUBLE) AS score
  FROM found GROUP BY rid)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(s.n_base, 0)::BIGINT AS n_base, s.first_word::BIGINT AS first_word,
       s.last_word::BIGINT AS last_word, coalesce(s.base_labels, '') AS base_labels, coalesce(s.labels, '') AS labels, coalesce(s.score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN summed s USING (rid)
"""
