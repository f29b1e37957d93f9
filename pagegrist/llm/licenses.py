"""License scans by a positional index of rare tokens.

Templates are passages of public licences, notices and headers; base phrases are templates that must match whole. A first pass counts, over all
documents, in how many each licence word occurs (its IDF). A scan of a file then goes:

1. Only templates count of which the file has all words of a mandatory key phrase.
2. Their highest-IDF words that the file has are looked up in the index, whose postings say at which place of which template a word stands:
   a word's place in the file less its place in the template is where the template would start. As many words are looked up as no
   file that has enough of the template can have but one of (``anchors``).
3. The postings are intersected by relative position: a start counts where two different words propose it, give or take ``drift`` words, as words
   may have been put in or left out.
4. There the template is aligned with the file: the IDF of the words that stand there in order, as a share of the template's, must
   reach ``SHARE``, and a key phrase must stand there consecutively.

Defined results: words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII; a null text is empty;
no place gives 0, nulls and empty labels; equal rows are scanned as often as given; a null doc_id is kept;
an empty table gives no row; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

WORDS = re.compile(rb"[0-9a-z\x80-\xFF]+")
#: Phrases and labels of the base.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Passages of public licences: label, key phrases of which one must stand in the place, passage.
TEMPLATES = (
    ("mit", ("mit license",), "released under the mit license"),
    ("mit", ("permission is hereby granted", "obtaining a copy of this software"), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", ("permission is hereby granted", "obtaining a copy of this software"), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", ("copies or substantial portions of the software",), "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", ("authors or copyright holders be liable",), "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache", ("apache license",), "licensed under the apache license version 2 0"),
    ("apache", ("apache license", "license for the specific language governing"), "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", ("license for the specific language governing", "without warranties or conditions of any kind"), "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache", ("hereby grants to you a perpetual worldwide",), "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("gpl", ("general public license",), "this work is licensed under the gnu general public license version 3"),
    ("gpl", ("general public license",), "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", ("general public license",), "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", ("freedom to share and change",), "the gnu general public license is intended to guarantee your freedom to share and change all versions of a program to make sure it remains free software for all its users"),
    ("lgpl", ("lesser general public license",), "licensed under the gnu lesser general public license"),
    ("lgpl", ("lesser general public license",), "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl", ("affero general public license",), "licensed under the gnu affero general public license"),
    ("agpl", ("affero general public license",), "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl", ("mozilla public license",), "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl", ("mozilla public license",), "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", ("redistribution and use in source", "with or without modification are permitted"), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", ("redistribution and use in source", "with or without modification are permitted"), "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", ("redistributions of source code must retain",), "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", ("redistributions in binary form must reproduce",), "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", ("used to endorse or promote products",), "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", ("provided by the copyright holders and contributors",), "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", ("with or without fee",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", ("with or without fee",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", ("author disclaims all warranties",), "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("zlib", ("altered source versions must be plainly marked", "this software is provided as is without any express"), "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", ("altered source versions must be plainly marked",), "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost", ("boost software license",), "distributed under the boost software license version 1 0"),
    ("unlicense", ("unencumbered software released into the public domain",), "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("epl", ("eclipse public license",), "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc0", ("cc0 1 0",), "licensed under cc0 1 0 universal"),
    ("cc-by-nc", ("cc by nc", "attribution noncommercial"), "licensed under cc by nc 4 0"),
    ("cc-by-nc", ("attribution noncommercial 4 0", "attribution noncommercial 3 0"), "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", ("cc by sa",), "licensed under cc by sa 4 0"),
    ("cc-by-sa", ("attribution sharealike 4 0", "attribution sharealike 3 0"), "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", ("cc by 4", "cc by 3"), "licensed under cc by 4 0"),
    ("cc-by", ("attribution 4 0", "attribution 3 0"), "this work is licensed under a creative commons attribution 4 0 international license"),
)
#: Weighted share of a template that must stand in a place.
SHARE = 0.7


class Template(NamedTuple):
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    base: bool


def _words(text: str) -> tuple[bytes, ...]:
    return tuple(text.encode().split())


ALL = tuple([Template(label, _words(p), (_words(p),), True) for p, label in BASE] + [Template(label, _words(t), tuple(map(_words, keys)), False) for label, keys, t in TEMPLATES])
VOCABULARY = frozenset(w for t in ALL for ws in (t.words, *t.keys) for w in ws)


def words(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


def drift(template: Template) -> int:
    """Words that may have been put into a template or left out of it between two of its words."""
    return 0 if template.base else max(3, len(template.words) // 5)


def _frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[bytes, int] = {}
    n = 0
    for batch in it:
        n += batch.num_rows
        for text in batch.column("text"):
            if text.is_valid:
                for w in VOCABULARY.intersection(words(text.as_py())):
                    count[w] = count.get(w, 0) + 1
    count[b""] = n
    yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in count], "n": pa.array(list(count.values()), pa.int64())})


def idf(docs: DataFrame) -> dict[bytes, float]:
    """The IDF of each licence word over all documents; at most one row per licence word comes to the driver."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"].encode(): r["n"] for r in rows}
    return {w: math.log((n.get(b"", 0) + 1) / (n.get(w, 0) + 1)) + 0.01 for w in VOCABULARY}


class Index:
    """The templates by their words' IDF: postings of the words that are looked up, and the rarest word of each key phrase."""

    def __init__(self, weights: dict[bytes, float]):
        self.weights = weights
        rarest = lambda ws: max(ws, key=lambda w: (weights[w], w))
        self.doors = frozenset(rarest(k) for t in ALL for k in t.keys)
        self.total = [sum(weights[w] for w in t.words) for t in ALL]
        self.anchors = [self._anchors(t, n) for t, n in zip(ALL, self.total)]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(ALL):
            for p, w in enumerate(t.words):
                if w in self.anchors[k]:
                    self.postings.setdefault(w, []).append((k, p))

    def _anchors(self, t: Template, total: float) -> frozenset[bytes]:
        """The rarest words of a template, as many as that a place which has the share has two of them at least."""
        ranked = sorted(set(t.words), key=lambda w: (-self.weights[w], w))
        if t.base:
            return frozenset(ranked)
        out, held, most = [], 0.0, 0.0
        for w in ranked:
            own = self.weights[w] * t.words.count(w)
            out.append(w)
            held, most = held + own, max(most, own)
            if held - most > (1 - SHARE) * total:
                break
        return frozenset(out)


def phrase_places(found: list[bytes], at: dict[bytes, list[int]], phrase: tuple[bytes, ...]) -> list[int]:
    """Where the words of a phrase stand consecutively; looked up by the one that the file has least often."""
    if any(w not in at for w in phrase):
        return []
    k = min(range(len(phrase)), key=lambda i: len(at[phrase[i]]))
    return [i - k for i in at[phrase[k]] if i >= k and tuple(found[i - k : i - k + len(phrase)]) == phrase]


def aligned(template: tuple[bytes, ...], window: list[bytes], weights: dict[bytes, float]) -> float:
    """The largest weight of template words that stand in a window in their order."""
    ids = {w: i for i, w in enumerate(set(template))}
    here = np.array([ids.get(w, -1) for w in window], np.int64)
    row = np.zeros(len(window) + 1)
    for w in template:
        gain = row[:-1] + weights[w] * (here == ids[w])
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], gain))
    return float(row[-1])


def starts(votes: list[tuple[int, bytes]], width: int) -> Iterator[int]:
    """First proposals of runs in which two different words agree, within a width; a new run is begun half a width on."""
    votes.sort()
    done = None
    for i, (start, word) in enumerate(votes):
        if done is not None and start <= done:
            continue
        j = i + 1
        while j < len(votes) and votes[j][0] <= start + width:
            if votes[j][1] != word:
                yield start
                done = start + width // 2
                break
            j += 1


def scan(found: list[bytes], index: Index) -> tuple[list[tuple[int, str]], dict[str, float]]:
    """(start, label) of each base place, and the best share of each label that counts."""
    if index.doors.isdisjoint(found):
        return [], {}
    at: dict[bytes, list[int]] = {}
    for i, w in enumerate(found):
        if w in VOCABULARY:
            at.setdefault(w, []).append(i)
    places, best = [], {}
    keys = [{p: phrase for phrase in t.keys for p in phrase_places(found, at, phrase)} for t in ALL]  # start of each mandatory phrase
    open_ = {k for k, there in enumerate(keys) if there}
    votes: dict[int, list[tuple[int, bytes]]] = {}
    for w, posted in index.postings.items():
        for k, p in posted if w in at else ():
            if k in open_ and not ALL[k].base:
                votes.setdefault(k, []).extend((i - p, w) for i in at[w])
    for k in open_:
        t = ALL[k]
        if t.base:
            places += [(p, t.label) for p in keys[k]]
            best[t.label] = 1.0
            continue
        d = drift(t)
        for start in starts(votes.get(k, []), d):
            lo, hi = max(0, start - d), start + len(t.words) + 2 * d
            if not any(lo <= p and p + len(phrase) <= hi for p, phrase in keys[k].items()):
                continue
            share = aligned(t.words, found[lo:hi], index.weights) / index.total[k]
            if share >= SHARE:
                best[t.label] = max(best.get(t.label, 0.0), share)
    return places, best


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _scanner(weights: dict[bytes, float]):
    def scanner(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(weights)
        for batch in it:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = words(text.as_py())
                places, best = scan(found, index)
                at = [p for p, _ in places]
                base = ",".join(sorted({label for _, label in places}))
                rows.append((doc, len(found), len(at), min(at, default=None), max(at, default=None), base, ",".join(sorted(best)), min(1.0, max(best.values(), default=0.0))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(OUT), OUT)], schema=OUT)

    return scanner


def scan_licenses(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of docs."""
    ship(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_scanner(idf(slim)), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
