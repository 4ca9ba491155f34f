"""License scans (operator 13): an exact set-similarity join of text blocks with license templates.

A text's words are runs of ASCII letters (lower-cased), digits and characters past ASCII. Two things are found:

* places of short phrases, where all their words stand one after the other;
* for every template of L words (rounded up to a power of two, C) every block that holds at least THRESHOLD of the template's
  distinct words. Blocks of a size are windows of 2 C words, C apart, so each passage of C words lies whole in one.

The join keeps its usual filters, none of which loses a pair. All words of templates are ordered by how often the whole
corpus uses them, rarest first. A template needs a = ceil(threshold * size) common words, so one of its size - a + 1 rarest
ones stands in any block that meets the threshold (prefix filter): only blocks around such words are looked at. A block with
fewer than a words of templates is left (length filter), as is one where the places of the first common word in both orders
leave fewer than a to come (positional filter). What remains is counted exactly.

Texts stay where Spark reads them; templates, phrases and word frequencies travel to the tasks. Their size doesn't grow with
the corpus, and it is checked: past MAX_WORDS, templates are joined in several rounds of at most so many words. Frequencies
are summed over all documents; partial counts meet in one row per template word.

Rows: null and empty texts have no words, no places and no blocks; repeated rows get equal results; texts of any length are
read whole (as one number of 32 bits a word, pieces of PIECE bytes at a time); an empty table gives an empty table; templates
and phrases without words find nothing. Other columns pass through; of the new names, those that docs have are led by an
underscore.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, fresh

#: Least share of a template's distinct words, as a fraction.
THRESHOLD = (4, 5)
MAX_WORDS, PIECE, LEAST_BLOCK = 200_000, 1 << 20, 8
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
PLACE, BLOCK = ("label", "word"), ("label", "template", "first_word", "n_words", "containment")
RESULT = "n_words long, places array<struct<label: string, word: long>>, blocks array<struct<label: string, template: long, first_word: long, n_words: long, containment: double>>"
ARROW = pa.struct([("n_words", pa.int64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))), ("blocks", pa.list_(pa.struct([("label", pa.string()), ("template", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())])))])


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def class_of(n: int) -> int:
    """The power of two that a template of n words is rounded up to."""
    return max(LEAST_BLOCK, 1 << (n - 1).bit_length())


def least(size: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    return -(-threshold[0] * size // threshold[1])


def coded(text: bytes, codes: dict[bytes, int]) -> np.ndarray:
    """A number per word of a whole text: its code, or -1."""
    text, out, at = text.translate(_LOWER), [], 0
    get = codes.get
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        out.append(np.array([get(w, -1) for w in text[at:end].split()], np.int32))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.int32)


class Index:
    """Templates as ascending codes (rarest word first) under their prefix words, and phrases as sequences of codes."""

    def __init__(self, templates: list[tuple[int, str, list[bytes]]], phrases: list[tuple[str, list[bytes]]], ranks: dict[bytes, int], threshold: tuple[int, int]):
        self.codes = ranks
        self.phrases = [(label, [ranks[w] for w in ws]) for label, ws in phrases if ws]
        self.templates, self.prefixes = [], {}
        self.starts = np.zeros(len(ranks) + 1, bool)  # one more, as words of no template are -1
        for no, label, ws in templates:
            if not ws:
                continue
            own = np.unique([ranks[w] for w in ws])
            need = least(len(own), threshold)
            for i, code in enumerate(own[: len(own) - need + 1].tolist()):
                self.prefixes.setdefault(code, []).append((len(self.templates), i))
                self.starts[code] = True
            self.templates.append((no, label, own, need, class_of(len(ws))))

    def places(self, ids: np.ndarray) -> list[tuple[str, int]]:
        out = []
        for label, codes in self.phrases:
            n = len(ids) - len(codes) + 1
            if n > 0:
                hit = np.flatnonzero(ids[:n] == codes[0])
                for k, c in enumerate(codes[1:], 1):
                    hit = hit[ids[hit + k] == c]
                out += [(label, p) for p in hit.tolist()]
        return out

    def blocks(self, ids: np.ndarray) -> list[tuple[str, int, int, int, float]]:
        """Every block that meets a template's threshold: (label, template, first word, words, containment)."""
        out, sets, tried = [], {}, set()
        for p in np.flatnonzero(self.starts[ids]).tolist():
            for t, i in self.prefixes[int(ids[p])]:
                no, label, own, need, size = self.templates[t]
                for k in {max(p // size - 1, 0), p // size}:
                    if (t, k) in tried:
                        continue
                    if (block := sets.get((size, k))) is None:
                        block = np.unique(ids[k * size : (k + 2) * size])
                        block = sets[size, k] = block[block >= 0]
                    # a bound for the first common word; at a later one it may leave the pair, which was or will be looked at there
                    j = int(np.searchsorted(block, ids[p]))
                    if len(block) < need or 1 + min(len(own) - i - 1, len(block) - j - 1) < need:
                        continue
                    tried.add((t, k))
                    common = len(np.intersect1d(own, block, assume_unique=True))
                    if common >= need:
                        out.append((label, no, k * size, min(2 * size, len(ids) - k * size), common / len(own)))
        return sorted(out, key=lambda b: (b[2], b[3], b[1]))


def frequencies(docs: DataFrame, words: list[bytes], text: str = "text") -> dict[bytes, int]:
    """How often the whole corpus uses each of the given words; words are bounded, and only those met come to the driver."""
    codes = {w: i for i, w in enumerate(words)}

    def fold(batches):
        held = np.zeros(len(codes), np.int64)
        for b in batches:
            for t in b.column(0):
                ids = coded(t.as_py() or b"", codes)
                held += np.bincount(ids[ids >= 0], minlength=len(codes))
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(held[met])], ["code", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("text")).mapInArrow(fold, "code int, n long")
    return {words[r["code"]]: r["n"] for r in rows.groupBy("code").agg(F.sum("n").alias("n")).collect()}


def _rounds(templates: list[tuple[int, str, list[bytes]]]) -> list[list[tuple[int, str, list[bytes]]]]:
    """Templates in groups of at most MAX_WORDS words (a longer one by itself)."""
    out, held = [[]], 0
    for t in templates:
        if out[-1] and held + len(t[2]) > MAX_WORDS:
            out, held = [*out, []], 0
        out[-1].append(t)
        held += len(t[2])
    return out


def _scanner(index):
    """The function of a round, for a broadcast Index."""

    @F.arrow_udf(RESULT)
    def scanned(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.cast(pa.binary()):
            ids = coded(t.as_py() or b"", index.value.codes)
            places, blocks = index.value.places(ids), index.value.blocks(ids)
            rows.append({"n_words": len(ids), "places": [dict(zip(PLACE, p)) for p in places], "blocks": [dict(zip(BLOCK, b)) for b in blocks]})
        return pa.array(rows, ARROW)

    return scanned


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: tuple[int, int] = THRESHOLD, text: str = "text", names: tuple[str, str, str] = ("n_words", "places", "blocks")) -> DataFrame:
    """docs with the number of words of each whole text, the places of phrases (label, word) and the blocks that meet the threshold (label, number of the template, first word, words, containment). Labels are texts."""
    if not 0 < threshold[0] <= threshold[1]:
        raise ValueError("the threshold is a share above 0, at most 1")
    bounded_batches(docs.sparkSession)
    found = [(label, words_of(t)) for label, t in phrases]
    names = fresh(docs.columns, *names)
    out, parts = docs, []
    for k, group in enumerate(_rounds([(no, label, words_of(t)) for no, (label, t) in enumerate(templates)])):
        own = found if k == 0 else []
        distinct = sorted({w for _, _, ws in group for w in ws} | {w for _, ws in own for w in ws})
        counts = frequencies(docs, distinct, text)
        ranks = {w: i for i, w in enumerate(sorted(distinct, key=lambda w: (counts.get(w, 0), w)))}
        index = docs.sparkSession.sparkContext.broadcast(Index(group, own, ranks, threshold))
        (tmp,) = fresh([*docs.columns, *names, *parts], "scanned")
        out = out.withColumn(tmp, _scanner(index)(F.col(f"`{text}`").cast("string")))
        parts.append(tmp)
    blocks = F.concat(*(F.col(f"{p}.blocks") for p in parts)) if len(parts) > 1 else F.col(f"{parts[0]}.blocks")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"{parts[0]}.n_words").alias(names[0]), F.col(f"{parts[0]}.places").alias(names[1]), blocks.alias(names[2]))


def sql(templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: tuple[int, int] = THRESHOLD) -> str:
    """The digest of the registered query as DuckDB SQL: every block is compared with every template of its size."""
    own = [(no, label, ws, class_of(len(ws))) for no, (label, ws) in enumerate((label, words_of(t)) for label, t in templates) if ws]
    rows = ", ".join(f"({no}, '{label}', '{w.decode()}', {size})" for no, label, ws, size in own for w in sorted(set(ws)))
    seqs = ", ".join(f"('{label}', {len(ws)}, {i}, '{w.decode()}')" for label, ws in ((label, words_of(t)) for label, t in phrases) for i, w in enumerate(ws))
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
t(no, label, word, size) AS (VALUES {rows}),
tn AS (SELECT no, label, size, count(*) AS n FROM t GROUP BY ALL),
ph(label, n, i, word) AS (VALUES {seqs}),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM d),
hit AS (SELECT w.doc_id, ph.label, w.p - ph.i AS q FROM w JOIN ph USING (word) GROUP BY w.doc_id, ph.label, w.p - ph.i, ph.n HAVING count(*) = ph.n),
base AS (SELECT doc_id, count(*) AS n_base, min(q) AS first_word, max(q) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM hit GROUP BY 1),
tw AS (SELECT DISTINCT w.doc_id, w.p // t.size AS k, t.no, t.word, t.size FROM w JOIN t USING (word)),
bl AS (SELECT DISTINCT doc_id, no, word, greatest(k - b, 0) AS k FROM tw, (SELECT unnest([0, 1]) AS b)),
ov AS (SELECT doc_id, no, k, count(*) AS c FROM bl GROUP BY ALL),
got AS (SELECT ov.doc_id, tn.label, ov.c / tn.n::DOUBLE AS share FROM ov JOIN tn USING (no) WHERE {threshold[1]} * ov.c >= {threshold[0]} * tn.n),
lab AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM (SELECT doc_id, label FROM got UNION ALL SELECT doc_id, label FROM hit) GROUP BY 1),
best AS (SELECT doc_id, max(share) AS share FROM got GROUP BY 1)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN lab USING (doc_id) LEFT JOIN best USING (doc_id)
"""
