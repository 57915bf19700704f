"""Licence scans by a positional index of rare words.

Templates are licence statements and whole notices, each with a mandatory key phrase. The words of key phrases
are counted over all documents, and a template is indexed by the words of its key phrase with the
highest IDF, with their positions. A file's licence words, the rarest of each template, look up their
postings; the starts that postings imply are intersected, as all words of a key phrase must stand. At
each start that is left the whole key phrase is verified, then the template's other words are compared.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, documents


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> tuple[bytes, ...]:
        return tuple(cut(self.text))

    @property
    def key_at(self) -> int:
        words, key = self.words, tuple(cut(self.key))
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


#: Phrases of the contract: a template that is its key phrase.
BASE = [Template("cc-by", "cc by", "cc by", True), Template("gpl", "general public license", "general public license", True), Template("reserved", "all rights reserved", "all rights reserved", True)]
TEMPLATES = BASE + [
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    Template("public-domain", "this work is released into the public domain", "public domain"),
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""", "to deal in the Software without restriction"),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""", "Redistributions of source code must retain"),
    Template("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied.""", "except in compliance with the License"),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", "published by the Free Software Foundation"),
]
#: Words of its key phrase, those of the highest IDF, by which a template is looked up.
RARE_WORDS = 2
#: Least share of a template's words around its key phrase.
LEAST_COVER = 0.5
#: A-Z in lower case, digits, a-z and bytes beyond ASCII as they are, all else a space.
_CUT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def cut(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_CUT).split()


class Scanner:
    def __init__(self, templates: list[Template] = TEMPLATES, n_docs: int = 0, frequency: dict[bytes, int] | None = None):
        """``frequency``: the documents that hold each word of a key phrase, of ``n_docs``."""
        self.templates = templates
        self.words = [t.words for t in templates]
        self.keys = [(t.key_at, tuple(cut(t.key))) for t in templates]
        self.idf = {w: math.log((n_docs + 1) / ((frequency or {}).get(w, 0) + 1)) for _, key in self.keys for w in key}
        #: word -> (template, place in it) of the words by which templates are looked up.
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for t, (at, key) in enumerate(self.keys):
            chosen = sorted(set(key), key=lambda w: (-self.idf[w], -len(w), w))[:RARE_WORDS]
            for w in chosen:
                self.postings[w].append((t, at + key.index(w)))
            self.needed.append(len(chosen))
        self.indexed = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, place of its key phrase, share of its words found) wherever a key phrase stands."""
        if self.indexed.isdisjoint(words):
            return []
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.indexed:
                places[w].append(i)
        starts: dict[int, set[int]] = {}
        met: dict[int, int] = defaultdict(int)
        for w in sorted(places, key=lambda w: (-self.idf[w], w)):
            for t, at in self.postings[w]:
                implied = {i - at for i in places[w]}
                starts[t] = starts[t] & implied if met[t] else implied
                met[t] += 1
        found = []
        for t in sorted(starts):
            if met[t] < self.needed[t]:
                continue
            (key_at, key), whole = self.keys[t], self.words[t]
            for start in sorted(starts[t]):
                i = start + key_at
                if i >= 0 and tuple(words[i : i + len(key)]) == key:
                    hit = sum(0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(whole))
                    found.append((t, i, hit / len(whole)))
        return found


def word_frequencies(docs: DataFrame, templates: list[Template] = TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """The number of documents, and of those that hold each word of a key phrase. A few rows a task reach the shuffle, a row a word the driver."""
    bound_batches(docs.sparkSession)
    wanted = frozenset(w for t in templates for w in cut(t.key))

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen[b""] += 1
                seen.update(wanted.intersection(cut(value.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r.word): r.n for r in rows}
    return found.pop(b"", 0), found


def scan_licenses(docs: DataFrame, templates: list[Template] = TEMPLATES, least_cover: float = LEAST_COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    ``docs`` has doc_id and text, other columns are ignored. n_base counts all places of the base
    phrases, first_word and last_word are the least and largest of them (null without). ``labels`` adds
    templates whose key phrase stands with at least ``least_cover`` of their words in their places around it;
    ``score`` is the largest such share. A null or empty text has no words, empty labels and score 0; very
    long texts are scanned whole. Repeated rows get equal results; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    n_docs, frequency = word_frequencies(docs, templates)
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}

    def run(batches):
        scanner = Scanner(templates, n_docs, frequency)
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = cut(value.as_py())
                found = [(templates[t], at, share) for t, at, share in scanner.scan(words) if share >= least_cover]
                base = [at for t, at, _ in found if t.base]
                labels = lambda some: ",".join(sorted({t.label for t in some}))
                rows.append((doc_id, len(words), len(base), min(base, default=None), max(base, default=None), labels(t for t, _, _ in found if t.base), labels(t for t, _, _ in found), max((s for _, _, s in found), default=0.0)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """All of documents, by all templates."""
    return scan_licenses(documents(spark, sf_dir))


def _values() -> str:
    rows = []
    for t in TEMPLATES:
        words = ", ".join(f"'{w.decode()}'" for w in t.words)
        rows.append(f"('{t.label}', {str(t.base).lower()}, [{words}], {t.key_at}, {len(cut(t.key))})")
    return ",\n  ".join(rows)


def oracle() -> str:
    return r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(label, base, words, key_at, key_n) AS (VALUES
  VALUES_HERE),
held AS (SELECT doc_id, label, base, p - 1 AS place, w, words, p - key_at AS start
  FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p), t WHERE w[p] = words[key_at + 1] AND w[p:p + key_n - 1] = words[key_at + 1:key_at + key_n]),
shared AS (SELECT doc_id, label, base, place, list_sum([CASE WHEN start + j >= 1 AND w[CAST(start + j AS BIGINT)] = words[j + 1] THEN 1 ELSE 0 END FOR j IN range(0, len(words))]) / len(words) AS share FROM held),
found AS (SELECT * FROM shared WHERE share >= 0.5),
per AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN per USING (doc_id)
""".replace("VALUES_HERE", _values())
