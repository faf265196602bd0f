r"""Operator 6: license scans by an exact set-similarity join.

Words are runs of characters other than ASCII non-alphanumerics, of the text
with A-Z lower-cased. Two things are looked for in every whole text:

* places where the words of a fixed phrase stand consecutively;
* text blocks that hold at least :data:`CONTAINMENT` of the distinct words of a
  template, whatever their order. Licenses that differ in a word or two hold
  enough of each other: of templates of other labels that share as much of their
  words, one that the block holds less of than of another gives way to that one.

A block is a run of words of the whole text, line breaks or not. A template of
up to L words, L a power of two from :data:`LEAST_BLOCK` on, is looked for in
blocks of 2 L words, one each L words, so a notice of up to L words stands whole
in some block, however it is wrapped.

This is a set-similarity join of all blocks with all templates. The templates'
words are ordered by their frequency in the corpus (a first pass counts in how
many texts each occurs; the rarest come first, ties in alphabetical order). A
block that holds at least o of a template's n words must hold one of the
template's first n - o + 1 (prefix filter) and at least o words of templates at
all (length filter; words of no template can't count). If the first word that
both have, in the order, is number p of the template's n and number q of the
block's m, they have no more in common than the smaller of n - p and m - q, which
must be o or more (positional filter). Only pairs that pass are compared. The
templates' inverted prefixes are a small literal table, so documents are read
twice and not shuffled.

Cases: null and empty texts have no words, no places and score 0; phrases and
blocks may repeat and overlap, all places count; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow.llm.common import table, texts

CONTAINMENT = 0.8
LEAST_BLOCK = 8
#: Phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Sentences that licenses are declared with, the notices of
#: licenses, and their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
        and limitations under the License.""",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    ),
    (
        "bsl-1.0",
        """Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at
        http://www.boost.org/LICENSE_1_0.txt""",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    (
        "cc0-1.0",
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/""",
    ),
    ("reserved", "All rights reserved"),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely""",
    ),
]
FOUND = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, found array<struct<label:string,start:bigint,n_words:bigint,containment:double>>"

_words = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def words_of(text: str) -> list[bytes]:
    """Bytes of words: whole characters, as all bytes from 80 on are in words."""
    return _words(text.encode("utf-8", "replace").lower())


def word_counts(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """In how many texts of the corpus each word of a template occurs. Counted
    in each batch, added up by Spark; as many rows as the templates have words."""
    wanted = frozenset(w for _, t in templates for w in words_of(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(wanted.intersection(words_of(text)))
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = texts(docs).select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(wanted, 0) | {bytes(r["word"]): r["n"] for r in rows}


def block_size(template: str) -> int:
    """The power of two, LEAST_BLOCK at least, that the words of a template
    fit in."""
    return max(LEAST_BLOCK, 1 << (len(words_of(template)) - 1).bit_length())


def least_words(n: int, containment: float) -> int:
    """How many of a template's n distinct words a block must hold."""
    return ceil(containment * n - 1e-9)


class Templates:
    """Templates as sets in the global order, with an index of their prefixes
    for each size of blocks."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], containment: float):
        self.labels = [label for label, _ in templates]
        #: Place of each word in the global order.
        self.rank = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
        self.words = [sorted(self.rank[w] for w in set(words_of(t))) for _, t in templates]
        self.sets = [frozenset(w) for w in self.words]
        self.least = [least_words(len(w), containment) for w in self.words]
        #: Templates of other labels that hold enough of a template's words.
        self.rivals = [frozenset(j for j, other in enumerate(self.sets) if self.labels[j] != self.labels[k] and len(mine & other) >= self.least[k]) for k, mine in enumerate(self.sets)]
        self.index: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, (words, least, (_, t)) in enumerate(zip(self.words, self.least, templates, strict=True)):
            mine = self.index.setdefault(block_size(t), {})
            for place, rank in enumerate(words[: len(words) - least + 1]):
                mine.setdefault(rank, []).append((k, place))
        #: Pairs that share a word of a prefix, and that each further filter lets pass, since it was made.
        self.met = self.long_enough = self.placed = 0

    def match(self, block: list[int], size: int) -> list[tuple[int, float]]:
        """Templates that a block, as its words' places in order, holds enough
        of."""
        index, held = self.index[size], frozenset(block)
        seen, out = set(), []
        for q, rank in enumerate(block):
            for k, p in index.get(rank, ()):
                if k in seen:
                    continue
                seen.add(k)
                self.met += 1
                if len(block) < self.least[k]:
                    continue
                self.long_enough += 1
                if min(len(self.words[k]) - p, len(block) - q) < self.least[k]:
                    continue
                self.placed += 1
                both = len(self.sets[k] & held)
                if both >= self.least[k]:
                    out.append((k, both / len(self.words[k])))
        return [(k, share) for k, share in out if not any(j in self.rivals[k] and other > share for j, other in out)]

    def scan(self, words: list[bytes]) -> list[dict]:
        """Templates in the blocks of a text, by size, then place."""
        out = []
        get = self.rank.get
        if self.rank.keys().isdisjoint(words):
            return out
        ranks = [get(w, -1) for w in words]
        for size, index in sorted(self.index.items()):
            seeds = {i // size for i, r in enumerate(ranks) if r in index}
            for at in sorted(seeds | {b - 1 for b in seeds if b}):
                start = at * size
                block = sorted(set(ranks[start : start + 2 * size]) - {-1})
                out += [{"label": self.labels[k], "start": start, "n_words": min(2 * size, len(words) - start), "containment": share} for k, share in self.match(block, size)]
        return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base (places of phrases), first_word and last_word
    (least and greatest start), base_labels, found (label, first word, number of
    words and containment for each template that a block holds) of each row of
    ``docs``."""
    known = Templates(templates, word_counts(docs, templates), containment)
    sought = [([w.encode() for w in p.split()], label) for p, label in phrases.items()]

    def base(words: list[bytes]) -> tuple[list[int], set[str]]:
        starts, labels = [], set()
        held = set(words)
        for phrase, label in sought:
            if held.issuperset(phrase):
                at = -1
                for _ in range(words.count(phrase[0])):
                    at = words.index(phrase[0], at + 1)
                    if words[at : at + len(phrase)] == phrase:
                        starts.append(at)
                        labels.add(label)
        return starts, labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                words = words_of(text)
                starts, labels = base(words)
                rows.append((doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), known.scan(words)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, FOUND)


ARROW = pa.schema(
    [
        *((n, pa.int64()) for n in ("doc_id", "n_words", "n_base", "first_word", "last_word")),
        ("base_labels", pa.list_(pa.string())),
        ("found", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())]))),
    ]
)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    both = F.array_union("base_labels", F.transform("found", lambda f: f["label"]))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        # A phrase that is there is there whole.
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda f: f["containment"])), F.lit(0.0))).alias("score"),
    )


def _sql_phrases() -> str:
    return ", ".join(f"('{label}', {[w.decode() for w in words_of(p)]})" for p, label in PHRASES.items())


def _sql_templates() -> str:
    return ", ".join(f"('{label}', {sorted({w.decode() for w in words_of(t)})}, {block_size(t)})" for label, t in TEMPLATES)


_SQL_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, {_SQL_WORD}) AS ws FROM d
), phrases(label, p) AS (
  VALUES {_sql_phrases()}
), places AS (
  SELECT row, i - 1 AS k, label FROM (SELECT row, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), phrases WHERE ws[i : i + len(p) - 1] = p
), base AS (
  SELECT row, count(*) AS n, min(k) AS low, max(k) AS high, list(DISTINCT label) AS labels FROM places GROUP BY row
), templates(label, p, size) AS (
  VALUES {_sql_templates()}
), blocks AS (
  SELECT row, size, k, list_distinct(list_slice(ws, k * size + 1, (k + 2) * size)) AS bs
  FROM (SELECT row, ws, size, unnest(range(0, (len(ws) + size - 1) // size)) AS k FROM w, (SELECT DISTINCT size FROM templates))
), held AS (
  SELECT row, size, k, label, p, len(list_intersect(bs, p)) / len(p) AS share FROM blocks JOIN templates USING (size) WHERE len(list_intersect(bs, p)) >= {CONTAINMENT} * len(p)
), found AS (
  SELECT row, max(share) AS share, list(DISTINCT label) AS labels FROM held AS h
  WHERE NOT EXISTS (SELECT 1 FROM held AS o WHERE o.row = h.row AND o.size = h.size AND o.k = h.k AND o.label <> h.label AND o.share > h.share AND len(list_intersect(o.p, h.p)) >= {CONTAINMENT} * len(h.p))
  GROUP BY row
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, low AS first_word, high AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CAST(CASE WHEN base.n > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (row) LEFT JOIN found USING (row)
"""
