"""License scans by a positional index of rare tokens.

The index has a postings list for each licence word: the templates and the places
in them where it stands. A file's licence words are looked up from the one with
the highest IDF over the corpus down. A template is a candidate where postings of
the rarest words of its mandatory key phrase agree on the relative position; then
the whole key phrase is verified, and the share of the template's words that
stand in their places is its score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import chunks, small_batches, table, word_table, words

# The phrases of the base labels.
BASE_PHRASES = {
    "apache": "apache license",
    "cc-by": "cc by",
    "gpl": "gnu general public license",
    "mit": "mit license",
}

# Texts and notices of public licences in lower case without signs, each with the key phrase that it must hold.
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    (
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "you may not use this file except in compliance with the license",
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistribution and use in source and binary forms",
    ),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("boost-1.0", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc0-1.0", "licensed under cc0 1 0 universal", "cc0 1 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details",
        "under the terms of the gnu general public license as published by the free software foundation",
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "permission to use copy modify and or distribute this software",
    ),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit-notice", "released under the mit license", "mit license"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "permission is hereby granted free of charge to any person obtaining a copy",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
]

#: Rare words of a key phrase whose postings must agree on the relative position.
ANCHORS = 2
#: Least share of a template's words in their places, beside its key phrase.
COVERAGE = 0.5


class Template(NamedTuple):
    label: str
    base: bool
    hashes: np.ndarray  # of its words
    key: tuple[int, int]  # its key phrase, as a range of words
    idf: np.ndarray  # of the words of the key phrase


def hashed(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), word_table("alnum"))[0]


def vocabulary(templates=None) -> dict[str, int]:
    """Words of all templates and their indexes."""
    texts = [*BASE_PHRASES.values(), *(t for _, t, _ in templates or TEMPLATES)]
    return {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t.split()))}


def document_counts(docs: DataFrame, templates=None) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each word of the templates; over all documents."""
    names = list(vocabulary(templates))
    known = hashed(" ".join(names))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(known)
        lookup = known[order]
        sums = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for lo, hi, raw, at in chunks(batch.column("text")):
                sums[-1] += hi - lo
                hashes, _, _, offsets = words(raw, at, word_table("alnum"))
                place, which = found(hashes, lookup)
                doc = np.searchsorted(offsets, place, "right") - 1
                pairs = np.unique(doc * len(known) + which)
                sums[:-1] += np.bincount(order[pairs % len(known)], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["i", "n"])

    found_in = docs.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    with small_batches(docs.sparkSession):
        got = {r.i: r.n for r in found_in.collect()}  # a row for each licence word
    return got.get(len(names), 0), {w: got.get(i, 0) for i, w in enumerate(names)}


def found(hashes: np.ndarray, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``hashes`` that occur in the sorted ``lookup``, and which entry each is."""
    sieve = np.zeros(1 << 16, bool)
    sieve[lookup >> np.uint64(48)] = True
    place = np.flatnonzero(sieve[hashes >> np.uint64(48)])
    which = np.minimum(np.searchsorted(lookup, hashes[place]), len(lookup) - 1)
    same = lookup[which] == hashes[place]
    return place[same], which[same]


def build(total: int, counts: dict[str, int], templates=None) -> list[Template]:
    """The templates, with the IDF of the words of their key phrases over the corpus."""
    idf = {w: math.log((total + 1) / (n + 1)) for w, n in counts.items()}
    out = []
    for label, text, key, base in [*((k, v, v, True) for k, v in BASE_PHRASES.items()), *((*t, False) for t in templates or TEMPLATES)]:
        tokens, phrase = text.split(), key.split()
        at = next(i for i in range(len(tokens)) if tokens[i : i + len(phrase)] == phrase)
        out.append(Template(label, base, hashed(text), (at, at + len(phrase)), np.array([idf[w] for w in phrase])))
    return out


class Index:
    """Postings of the words of all key phrases: word to [(template, place)], with the words' IDF."""

    def __init__(self, templates: list[Template]):
        self.templates, postings, idf = templates, {}, {}
        for k, t in enumerate(templates):
            for i, h in enumerate(t.hashes[slice(*t.key)].tolist()):
                postings.setdefault(h, []).append((k, t.key[0] + i))
                idf[h] = float(t.idf[i])
        by_idf = sorted(postings, key=lambda h: (-idf[h], h))  # rarest first
        self.postings = [postings[h] for h in by_idf]
        self.of_sorted = np.argsort(np.array(by_idf, np.uint64))
        self.lookup = np.array(by_idf, np.uint64)[self.of_sorted]

    def candidates(self, hashes: np.ndarray) -> dict[int, np.ndarray]:
        """For each template the places where it would begin, on which postings of its ANCHORS rarest words agree."""
        place, which = found(hashes, self.lookup)
        word = self.of_sorted[which]
        by = np.argsort(word, kind="stable")
        edges = np.searchsorted(word[by], np.arange(len(self.postings) + 1))
        starts: dict[int, np.ndarray] = {}
        looked = dict.fromkeys(range(len(self.templates)), 0)
        for w, postings in enumerate(self.postings):  # from the highest IDF down
            here = place[by[edges[w] : edges[w + 1]]]
            spots: dict[int, list[np.ndarray]] = {}
            for k, i in postings:
                spots.setdefault(k, []).append(here - i)
            for k, found_at in spots.items():
                if looked[k] < ANCHORS:
                    begin = np.unique(np.concatenate(found_at))
                    starts[k] = np.intersect1d(starts[k], begin, assume_unique=True) if looked[k] else begin
                    looked[k] += 1
        return starts


def matches(hashes: np.ndarray, offsets: np.ndarray, index: Index):
    """(template, text, first word of the key phrase, share of the template's words in place) of each verified match."""
    for k, start in index.candidates(hashes).items():
        t = index.templates[k]
        lo, hi = t.key
        doc = np.searchsorted(offsets, start + lo, "right") - 1
        inside = (start + lo >= 0) & (doc >= 0) & (doc < len(offsets) - 1)
        start, doc = start[inside], doc[inside]
        whole = start + hi <= offsets[doc + 1]
        start, doc = start[whole], doc[whole]
        for j in range(lo, hi):
            same = hashes[start + j] == t.hashes[j]
            start, doc = start[same], doc[same]
        share = np.full(len(start), hi - lo, float)
        for j in [*range(lo), *range(hi, len(t.hashes))]:
            here = (start + j >= offsets[doc]) & (start + j < offsets[doc + 1])
            share[here] += hashes[(start + j)[here]] == t.hashes[j]
        share /= len(t.hashes)
        for s, d, x in zip((start + lo).tolist(), doc.tolist(), share.tolist(), strict=True):
            if t.base or x >= COVERAGE:
                yield t, d, s, x


def scan_licenses(docs: DataFrame, templates=None) -> DataFrame:
    """The columns of ``docs`` and what licences their texts name.

    ``lic_words`` (words), ``lic_places`` (array of (label, first word) where a
    base phrase stands), ``lic_matches`` (array of (label, first word of the key
    phrase, share of the template in place) of the templates). Columns of those
    names are replaced.

    A first pass counts, over all documents, in how many each licence word
    occurs. In the scan a text's licence words are looked up from the rarest
    down; each occurrence gives the places where templates would begin, those on
    which a template's rarest words agree are candidates, and the key phrase is
    verified word by word. As a key phrase must stand whole, no match escapes its
    rarest words. The index is as large as the list of templates.

    Null and empty texts have no words and no matches; repeated rows are scanned
    one by one; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("lic_words", "lic_places", "lic_matches")
    # Plain arrays: a few kilobytes inside the task.
    plain = [tuple(t) for t in build(*document_counts(docs, templates), templates)]
    place, match = "array<struct<label:string,at:long>>", "array<struct<label:string,at:long,share:double>>"
    nothing = {"lic_words": F.lit(0).cast("long"), "lic_places": F.array().cast(place), "lic_matches": F.array().cast(match)}
    schema = docs.limit(0).withColumns(nothing).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([Template(*t) for t in plain])
        kinds = pa.list_(pa.struct([("label", pa.string()), ("at", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("at", pa.int64()), ("share", pa.float64())]))
        for batch in batches:
            counts, places, named = [], [], []
            for lo, hi, raw, at in chunks(batch.column("text")):
                hashes, _, _, offsets = words(raw, at, word_table("alnum"))
                counts += np.diff(offsets).tolist()
                here: list[list] = [[] for _ in range(hi - lo)]
                more: list[list] = [[] for _ in range(hi - lo)]
                for t, d, s, x in matches(hashes, offsets, index):
                    (here if t.base else more)[d].append({"label": t.label, "at": s - int(offsets[d])} | ({} if t.base else {"share": x}))
                places += here
                named += more
            columns = [*batch.columns, pa.array(counts, pa.int64()), pa.array(places, kinds[0]), pa.array(named, kinds[1])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lic_words", "lic_places", "lic_matches"])

    return docs.mapInArrow(scan, schema)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.transform("lic_places", lambda p: p["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        F.col("lic_words").alias("n_words"),
        F.size("lic_places").cast("long").alias("n_base"),
        F.array_min(F.transform("lic_places", lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform("lic_places", lambda p: p["at"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("lic_matches", lambda m: m["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("lic_matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


_SQL_TEMPLATES = ", ".join(
    f"('{label}', {base}, string_split('{text}', ' '), string_split('{key}', ' '))"
    for label, base, text, key in [*((k, True, v, v) for k, v in BASE_PHRASES.items()), *((label, False, text, key) for label, text, key in TEMPLATES)]
)

# Every occurrence of a key phrase holds its rarest words, so the index finds what this search by brute force finds.
OP8_SQL = rf"""
WITH templates AS (
  SELECT *, (SELECT min(i) FROM range(1, len(t) + 1) r(i) WHERE t[i:i + len(k) - 1] = k) AS lo FROM (VALUES {_SQL_TEMPLATES}) v(label, base, t, k)
), docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), tokens AS (
  SELECT rid, i, w FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM docs)
), places AS (
  SELECT rid, label, base, i, len(list_filter(range(1, len(t) + 1), lambda j: i - lo + j >= 1 AND i - lo + j <= len(w) AND w[greatest(1, i - lo + j)] = t[j])) / len(t) AS share
  FROM tokens JOIN templates ON w[i] = k[1] AND w[i:i + len(k) - 1] = k
), found AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(i - 1) FILTER (base) AS first_word, max(i - 1) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) FILTER (NOT base) AS score
  FROM places WHERE base OR share >= {COVERAGE} GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs d LEFT JOIN found f ON f.rid = d.rid
"""
