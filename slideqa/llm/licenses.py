"""License scans as an exact set-similarity join of text blocks with license templates.

Blocks are lines and, if wanted, also all runs of as many words of a text as a template has, divided by the
threshold, wherever lines end: so notices that are wrapped are found. A template matches a block that contains
at least ``THRESHOLD`` of the template's distinct words. Words are ordered globally, rarest first, by how many blocks of the whole corpus hold them (counted over
all documents in a first pass; only template words matter). Then
- prefix: a match must hold one of a template's |T| - need + 1 first words in that order,
- length: a block of fewer than ``need`` distinct words can't match,
- position: after the first common word at place i of the template and j of the block's ordered words, at most
  1 + min(|T| - i - 1, |B| - j - 1) words can be common,
and what passes all three is verified by intersection. Runs of words are counted at once: only template words
near a prefix word matter, and each counts for the runs that end from its place on until the same word comes
again or it is left behind. No match is lost. Fixed phrases are found by their
words' places. Both passes need no shuffle beyond a few counts.

Defined results: null counts as empty; a template in several blocks counts once; repeated rows give repeated
results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slideqa.llm.tables import table
from slideqa.llm.text import ALNUM, Words, flat, lean, slices, words

#: Phrases that the query fixes, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Opening words or notices of common licenses; the label may have several templates.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
]
THRESHOLD = 0.85
_FIELDS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"


class Template(NamedTuple):
    words: np.ndarray  # places in the global order, ascending
    need: int
    label: str
    run: int  # words of a run that is a block of its own


def hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), ALNUM, keyed=True).hash


def blocks(data: np.ndarray, w: Words, at: np.ndarray) -> np.ndarray:
    """The number of the line that each of the words at the given places stands in; a new text begins one."""
    lines = np.cumsum(data == 10)
    return lines[w.start[at]] + w.doc[at]


def _counted(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                data, offsets = flat(part.column(0))
                w = words(data, offsets, ALNUM, keyed=True)
                at = np.flatnonzero(np.isin(w.hash, vocabulary))
                if len(at):
                    place = np.searchsorted(vocabulary, w.hash[at])
                    pairs = np.unique(blocks(data, w, at) * len(vocabulary) + place)
                    total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["place", "n"])

    return run


def word_order(docs: DataFrame, text_col: str, templates: list[tuple[str, str]]) -> np.ndarray:
    """The hashes of the templates' words, rarest first. What comes back is a count for each of them."""
    vocabulary = np.unique(np.concatenate([hashes(t) for t, _ in templates]))
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_counted(vocabulary)), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    n = np.zeros(len(vocabulary), np.int64)
    for r in counts.collect():
        n[r.place] = r.n
    return vocabulary[np.lexsort((vocabulary, n))]


def prepared(templates: list[tuple[str, str]], order: np.ndarray, threshold: float) -> list[Template]:
    place = {h: i for i, h in enumerate(order.tolist())}
    out = []
    for text, label in templates:
        own = np.array(sorted({place[h] for h in hashes(text).tolist()}), np.int64)
        out.append(Template(own, ceil(threshold * len(own) - 1e-9), label, ceil(len(hashes(text)) / threshold - 1e-9)))
    return out


def matches(block: np.ndarray, size: int, templates: list[Template], by_prefix: dict[int, list[tuple[int, int]]]) -> dict[str, float]:
    """Containment by label. block: ordered places of the block's template words; size: its distinct words."""
    tried, found = set(), {}
    for j, word in enumerate(block.tolist()):
        for t, i in by_prefix.get(word, ()):
            if t in tried:
                continue
            tried.add(t)
            own = templates[t]
            if size < own.need or 1 + min(len(own.words) - i - 1, len(block) - j - 1) < own.need:
                continue
            common = len(np.intersect1d(block, own.words, assume_unique=True))
            if common >= own.need:
                found[own.label] = max(found.get(own.label, 0.0), common / len(own.words))
    return found


def run_matches(at: np.ndarray, place: np.ndarray, bounds: np.ndarray, own: Template) -> tuple[np.ndarray, np.ndarray]:
    """Ends of runs of ``own.run`` words of a text that match, and their numbers of common words. at: ascending
    places of the template words in all texts; place: their places in the global order; bounds: first words of texts."""
    first = np.isin(place, own.words[: len(own.words) - own.need + 1])
    near = np.zeros(bounds[-1] + 1, np.int64)
    near[at[first] + 1] = 1
    near = np.cumsum(near)
    mine = np.isin(place, own.words)
    at, place = at[mine], place[mine]
    mine = near[np.minimum(at + own.run, bounds[-1])] > near[np.maximum(at - own.run + 1, 0)]
    at, place = at[mine], place[mine]
    if not len(at):
        return at, at
    until = np.minimum(at + own.run, bounds[np.searchsorted(bounds, at, "right")])
    order = np.lexsort((at, place))
    again = np.flatnonzero(place[order[1:]] == place[order[:-1]])
    until[order[again]] = np.minimum(until[order[again]], at[order[again + 1]])
    # runs that end at a template word: those between them hold no more
    common = np.arange(1, len(at) + 1) - np.searchsorted(np.sort(until), at, "right")
    good = common >= own.need
    return at[good], common[good]


def phrase_places(w: Words, phrase: np.ndarray) -> np.ndarray:
    """Places of words where the phrase begins, inside one text."""
    n = len(w.hash) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = w.doc[:n] == w.doc[len(phrase) - 1 :]
    for k, h in enumerate(phrase):
        hit &= w.hash[k : k + n] == h
    return np.flatnonzero(hit)


def _scanned(order: np.ndarray, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], threshold: float, wrapped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = prepared(templates, order, threshold)
        by_prefix: dict[int, list[tuple[int, int]]] = {}
        for t, own in enumerate(ready):
            for i, word in enumerate(own.words[: len(own.words) - own.need + 1].tolist()):
                by_prefix.setdefault(word, []).append((t, i))
        prefix_words = np.unique(order[list(by_prefix)])
        known = np.sort(order)
        place_of = np.argsort(order)
        fixed = [(hashes(p), label) for p, label in phrases]
        for batch in batches:
            for part in slices(batch):
                data, offsets = flat(part.column(1))
                w = words(data, offsets, ALNUM, keyed=True)
                n_docs = part.num_rows
                bounds = np.searchsorted(w.doc, np.arange(n_docs + 1))
                places = [[] for _ in range(n_docs)]
                base, labels = [set() for _ in range(n_docs)], [{} for _ in range(n_docs)]
                for phrase, label in fixed:
                    for k in phrase_places(w, phrase).tolist():
                        d = int(w.doc[k])
                        places[d].append(k - int(bounds[d]))
                        base[d].add(label)
                hits = np.flatnonzero(np.isin(w.hash, prefix_words))
                if len(hits):
                    line = blocks(data, w, np.arange(len(w.hash)))
                    for b in np.unique(line[hits]).tolist():
                        first, last = np.searchsorted(line, [b, b + 1])
                        own = np.unique(w.hash[first:last])
                        mine = own[np.isin(own, known)]
                        found = matches(np.sort(place_of[np.searchsorted(known, mine)]), len(own), ready, by_prefix)
                        for label, score in found.items():
                            at = labels[int(w.doc[first])]
                            at[label] = max(at.get(label, 0.0), score)
                if wrapped and len(hits):
                    at = np.flatnonzero(np.isin(w.hash, known))
                    place = place_of[np.searchsorted(known, w.hash[at])]
                    for own in ready:
                        ends, common = run_matches(at, place, bounds, own)
                        for d, n in zip(w.doc[ends].tolist(), common.tolist(), strict=True):
                            labels[d][own.label] = max(labels[d].get(own.label, 0.0), n / len(own.words))
                out = []
                for d in range(n_docs):
                    p = places[d]
                    score = 1.0 if p else max(labels[d].values(), default=0.0)
                    out.append((int(bounds[d + 1] - bounds[d]), len(p), min(p, default=None), max(p, default=None), sorted(base[d]), sorted(base[d] | labels[d].keys()), score))
                kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], [x.split()[0] for x in _FIELDS.split(", ")])

    return run


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, wrapped: bool = False) -> DataFrame:
    """doc_id, n_words, n_base (places of phrases), first_word, last_word, base_labels, labels, score: a row per
    row of docs. The templates are a parameter and travel with the tasks. wrapped: blocks are not only lines."""
    templates = TEMPLATES if templates is None else templates
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = word_order(rows, "text", templates)
    return rows.mapInArrow(lean(_scanned(order, templates, PHRASES if phrases is None else phrases, threshold, wrapped)), _FIELDS)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_labels(table(spark, sf_dir, "documents"), wrapped=True)
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return found.withColumns(joined)


def _values(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"(string_split('{text}', ' '), '{label}')" for text, label in pairs)


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
p(q, label) AS (VALUES {_values(PHRASES)}), tpl(q, label) AS (VALUES {_values(TEMPLATES)}),
x AS (SELECT row_number() OVER () AS t, list_distinct(q) AS q, label, ceil(len(q) / {THRESHOLD} - 1e-9)::int AS run, ceil({THRESHOLD} * len(list_distinct(q)) - 1e-9) AS need FROM tpl),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
hits AS (SELECT doc_id, i - 1 AS place, label FROM i, p WHERE w[i] = q[1] AND w[i:i + len(q) - 1] = q),
h AS (SELECT doc_id, count(*) AS n, min(place) AS low, max(place) AS high FROM hits GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
own AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS own FROM lines),
v AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
r AS (SELECT doc_id, label, count(DISTINCT word) OVER (PARTITION BY doc_id, t ORDER BY i RANGE BETWEEN run - 1 PRECEDING AND CURRENT ROW) AS n, len(q) AS size, need
      FROM v JOIN (SELECT *, unnest(q) AS word FROM x) USING (word)),
m AS (SELECT doc_id, label, len(list_intersect(own, q)) / len(q) AS s FROM own, x WHERE len(list_intersect(own, q)) >= need
      UNION SELECT doc_id, label, n / size FROM r WHERE n >= need),
b AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base FROM hits GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS every FROM (SELECT doc_id, label FROM hits UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, max(s) AS s FROM m GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, low AS first_word, high AS last_word, coalesce(base, '') AS base_labels, coalesce(every, '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(s, 0) END::double AS score
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""
