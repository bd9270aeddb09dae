"""License scan: exact set-similarity join of license templates with the blocks of every text.

A template is a set of words.  A block is a run of consecutive words, as long as the template's text (shorter at the
end of a text), that begins with one of its words; line breaks do not end it, so a notice may be wrapped anywhere.  A
block matches when it holds at least ``threshold`` of the template's words, among them all that name the license
(a template's ``names``; "lesser" tells one notice from another that shares all the rest).

Template words are put into one global order, rare ones first, by their document frequency over the whole corpus.  A
block that matches must hold one of the first ``size - ceil(threshold * size) + 1`` words of the template (prefix
filter), cannot be shorter than ``ceil(threshold * size)`` words (length filter), and once the template's i-th word
is the first one met, at most ``size - i`` words can still match (positional filter).  What is left is verified by
counting along the text.  The join is exact: the filters pass every match.

The most specific license wins: a match gives way to an overlapping one of another label that holds a larger share of
its template, or the same share of a larger one, or of an earlier one of the same size.

Templates are a parameter: at most ``MAX_WORDS`` words in all, so their index, which is broadcast, has a proven size
(some ten MB); a longer list is scanned in parts.

Defined results: a null text is empty; a text without words gives zero counts, null positions and empty labels;
repeated rows are scanned each; texts of any length are scanned whole; ties are as above; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_WORDS, THRESHOLD = 100_000, 0.8
#: Words are runs of 0-9, a-z (A-Z lower-cased) and everything outside ASCII.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Fixed phrases of the op9 query and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


class Template(NamedTuple):
    label: str
    names: str  # words that a match must hold
    text: str


#: Names of licenses in one-line notices: (label, words that a match must hold, name).
NOTICES = [
    ("gpl", "gnu general public", "GNU General Public License"),
    ("lgpl", "lesser", "GNU Lesser General Public License"),
    ("agpl", "affero", "GNU Affero General Public License"),
    ("apache", "apache", "Apache License"),
    ("apache", "apache", "Apache License, Version 2.0"),
    ("mit", "mit", "MIT License"),
    ("bsd", "bsd", "BSD License"),
    ("bsd", "bsd 2 clause", "BSD 2-Clause License"),
    ("bsd", "bsd 3 clause", "BSD 3-Clause License"),
    ("isc", "isc", "ISC License"),
    ("mpl", "mozilla", "Mozilla Public License"),
    ("epl", "eclipse", "Eclipse Public License"),
    ("boost", "boost", "Boost Software License"),
    ("cc-by", "cc by", "CC BY 4.0"),
    ("cc-by-sa", "cc by sa", "CC BY-SA 4.0"),
    ("cc-by-nc", "cc by nc", "CC BY-NC 4.0"),
    ("cc-by-nd", "cc by nd", "CC BY-ND 4.0"),
    ("cc-by", "commons attribution", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "commons sharealike", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "commons noncommercial", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "commons noderivatives", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
]
_PERMISSIVE_END = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
#: Public license texts and the notices that they ask for.
TEXTS = [
    Template("gpl", "gnu general public", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl", "gnu general public", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    Template("gpl", "gnu general public", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "lesser", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("agpl", "affero", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    Template("apache", "apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("apache", "license", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    Template("mit", "sublicense", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _PERMISSIVE_END),
    Template("mit", "sublicense", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("mit", "hereby documentation", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "redistributions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    Template("bsd", "redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("isc", "fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("zlib", "altered", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    Template("mpl", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    Template("mpl", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    Template("epl", "eclipse", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    Template("boost", "boost", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"),
    Template("cc0", "waived", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    Template("unlicense", "unencumbered", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    Template("unlicense", "unencumbered", "This is free and unencumbered software released into the public domain."),
    Template("wtfpl", "fuck", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    Template("all-rights-reserved", "all rights reserved", "All rights reserved."),
]
#: Verbs of one-line notices; each name stands behind each of them.
_VERBS = ["Licensed under", "Released under", "Distributed under", "This work is licensed under"]
TEMPLATES = TEXTS + [Template(label, names, f"{verb} {article}{name}") for label, names, name in NOTICES for verb in _VERBS for article in (["", "the ", "the terms of the "] if "License" in name else [""])]


def _flat(text: str | None) -> bytes:
    """Lower-cased words, spaces between them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD)


class Index:
    """Prefix index of the templates under a global word order."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int], threshold: float):
        self.sets, self.prefix = [], {}
        for label, names, text in templates:
            run = _flat(text).split()
            words = sorted(set(run), key=lambda w: (frequency.get(w, 0), w))
            if not words:
                raise ValueError(f"a template needs words: {text[:60]!r}")
            need = ceil(threshold * len(words) - 1e-9)
            for i, w in enumerate(words[: len(words) - need + 1]):
                self.prefix.setdefault(w, []).append((len(self.sets), i))
            self.sets.append((label, frozenset(words), need, len(run), frozenset(_flat(names).split())))
        if sum(s[3] for s in self.sets) > MAX_WORDS:
            raise ValueError(f"templates of more than {MAX_WORDS} words: scan with a part of them at a time")
        self.first = frozenset(self.prefix)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, float, int]]:
        """(first word, last word, containment, template) of every block that meets a template."""
        met = self.first.intersection(words)
        if not met:
            return []
        near: dict[int, list[tuple[int, int]]] = {}  # template -> places of its prefix words, and their positions
        for at, w in enumerate(words):
            if w in met:
                for t, i in self.prefix[w]:
                    near.setdefault(t, []).append((at, i))
        there, found = set(words), []
        for t, hits in near.items():
            _, own, need, length, names = self.sets[t]
            if len(words) < need or not names <= there or len(own) - min(i for _, i in hits) < need or len(own & there) < need:  # length, position
                continue
            done = 0
            for at, _ in hits:  # blocks that hold this prefix word and none before it
                begin, end = max(done, at - length + 1), min(len(words), at + length)
                places = [p for p in range(begin, end) if words[p] in own]
                left, right, held = 0, 0, {}
                for left, p in enumerate(places):
                    if p > at:
                        break
                    while right < len(places) and places[right] < p + length:
                        held[words[places[right]]] = held.get(words[places[right]], 0) + 1
                        right += 1
                    if len(held) >= need and names <= held.keys():
                        found.append((p, places[right - 1], len(held) / len(own), t))
                    w = words[p]
                    held[w] -= 1
                    if not held[w]:
                        del held[w]
                done = at + 1
        return found

    def winners(self, found: list[tuple[int, int, float, int]]) -> list[tuple[int, int, float, int]]:
        """Without those that give way to an overlapping match of another label."""
        rank = {f: (f[2], len(self.sets[f[3]][1]), -f[3]) for f in found}
        order = sorted(found)
        kept = []
        open_: list[tuple[int, int, float, int]] = []
        lost = set()
        for f in order:
            open_ = [o for o in open_ if o[1] >= f[0]]
            for o in open_:
                if self.sets[o[3]][0] != self.sets[f[3]][0]:
                    lost.add(o if rank[o] < rank[f] else f)
            open_.append(f)
        for f in order:
            if f not in lost:
                kept.append(f)
        return kept


def frequencies(docs: DataFrame, templates: list[Template], text_col: str = "text") -> dict[bytes, int]:
    """Number of rows of the whole table whose text holds each template word (a bounded vocabulary)."""
    vocabulary = frozenset(w for t in templates for w in _flat(t[2]).split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for t in batch.column(0):
                for w in vocabulary.intersection(_flat(t.as_py()).split()):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counted = common.arrow_tasks(docs.select(F.col(text_col).alias("text")), run, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, templates: list[Template] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks (first and last
    word, label and containment of every match that gives way to no other).  score: 1 where a phrase stands, else the
    highest containment of these."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, frequencies(docs, templates, text_col), threshold))
    needles = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
    block = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.list_(block))])

    def judge(index: Index, doc_id: int | None, text: str | None) -> dict:
        words = _flat(text).split()
        joined = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for needle, label in needles:
            at = joined.find(needle)
            while at >= 0:
                places.append(joined.count(b" ", 0, at))
                base.add(label)
                at = joined.find(needle, at + 1)
        blocks: list[dict] = []
        last: dict[str, dict] = {}
        for a, b, c, t in index.winners(index.matches(words)):
            label = index.sets[t][0]
            if label in last and a <= last[label]["last_word"]:  # overlapping ones of one label are one block
                last[label].update(last_word=max(b, last[label]["last_word"]), containment=max(c, last[label]["containment"]))
            else:
                last[label] = {"first_word": a, "last_word": b, "label": label, "containment": c}
                blocks.append(last[label])
        score = 1.0 if places else max((b["containment"] for b in blocks), default=0.0)
        return {"doc_id": doc_id, "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {b["label"] for b in blocks})), "score": score, "blocks": blocks}

    def make():
        index = shared.value
        return lambda batch: pa.RecordBatch.from_pylist([judge(index, i, t.as_py()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)], schema=kind)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_arrow(rows, make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<first_word:long,last_word:long,label:string,containment:double>>")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: license phrases and labels of every document."""
    return scan(common.table(spark, sf_dir, "documents")).drop("blocks")


def _place(phrase: str) -> str:
    words = phrase.split()
    test = " AND ".join(f"ws[i + {k}] = '{w}'" if k else f"ws[i] = '{w}'" for k, w in enumerate(words))
    return f"list_filter(range(1, len(ws) + 1), lambda i: {test})"


def _words(text: str) -> list[str]:
    return [w.decode() for w in _flat(text).split()]


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, {_RUN}) AS ws FROM documents
), p AS (
  SELECT r, doc_id, ws, {", ".join(f"{_place(phrase)} AS p{i}" for i, phrase in enumerate(PHRASES))} FROM d
), templates(no, label, tw, names, size) AS (
  VALUES {", ".join(f"({n}, '{t.label}', {sorted(set(_words(t.text)))}, {sorted(set(_words(t.names)))}, {len(_words(t.text))})" for n, t in enumerate(TEMPLATES))}
), w AS (
  SELECT r, len(ws) AS n, i, ws[i] AS word FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)
), near AS (
  SELECT r, no, any_value(label) AS label, any_value(tw) AS tw, any_value(names) AS names, any_value(size) AS size
  FROM (SELECT DISTINCT r, word FROM w) JOIN (SELECT *, unnest(tw) AS word FROM templates) USING (word)
  GROUP BY r, no HAVING count(*) >= {THRESHOLD} * any_value(len(tw)) - 1e-9
), block AS (
  SELECT near.r, no, label, tw, names, i, list_slice(ws, i, i + size - 1) AS own
  FROM near JOIN d USING (r) JOIN w ON w.r = near.r AND list_contains(tw, w.word)
), met AS (
  SELECT r, no, label, i AS a, i + list_max(list_filter(range(1, len(own) + 1), lambda k: list_contains(tw, own[k]))) - 1 AS b,
    len(list_intersect(own, tw)) / len(tw) AS c, len(tw) AS size
  FROM block WHERE len(list_intersect(own, tw)) >= {THRESHOLD} * len(tw) - 1e-9 AND list_has_all(own, names)
), won AS (
  SELECT * FROM met x WHERE NOT EXISTS (
    SELECT 1 FROM met y WHERE y.r = x.r AND y.label <> x.label AND y.a <= x.b AND x.a <= y.b
      AND (y.c > x.c OR y.c = x.c AND (y.size > x.size OR y.size = x.size AND y.no < x.no)))
), best AS (
  SELECT r, list(label) AS found, max(c) AS c FROM won GROUP BY r
), base AS (
  SELECT r, doc_id, len(ws) AS n_words, list_concat({", ".join(f"p{i}" for i in range(len(PHRASES)))}) AS places,
    list_concat({", ".join(f"CASE WHEN len(p{i}) > 0 THEN ['{label}'] ELSE [] END" for i, label in enumerate(PHRASES.values()))}) AS own
  FROM p
)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
  array_to_string(list_sort(list_distinct(own)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(own, coalesce(found, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM base LEFT JOIN best USING (r)
"""
