"""License scans by a positional rare-token index.

Templates are licence notices and clauses. Their words form the licence vocabulary, and an index holds for each word its postings:
(template, position). Document frequencies of the vocabulary are counted over the whole corpus, and give every word its IDF. A file's
licence words are looked up in descending IDF: each opens the templates that name it as an anchor (the ANCHORS rarest words of the
template's mandatory key phrase). Where a template's anchors are all there, its candidate starts are the intersection of their postings by
relative position: place in the file minus place in the template. At each start the key phrase is verified word by word, and
the share of the template that stands in place. Every template has anchors of its own, so a file may hold any number of them.

The index holds the templates alone and is sent to the tasks; its size does not depend on the corpus.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import packed, plain

#: ASCII letters and digits lower-cased, other ASCII a blank, bytes of longer characters as they are.
_TO_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: Fixed phrases and labels of the contract.
BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

#: (label, notice, key phrase): wording of well-known licences.
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "dedicated to the public domain under cc0 1 0", "cc0 1 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copies or substantial portions of the software"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "as is basis without warranties or conditions"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    ("artistic-2.0", "licensed under the artistic license 2 0", "artistic license 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "will the authors be held liable"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
]
#: Anchors of a template (places of its key phrase, highest IDF first), and the share of its words that must stand in place.
ANCHORS = 2
COVERAGE = 0.8


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


class Index:
    """Postings of the templates' words."""

    def __init__(self, templates: list[tuple[str, str, str]]):
        self.labels = [label for label, _, _ in templates]
        self.texts = [words_of(notice.encode()) for _, notice, _ in templates]
        self.keys = []
        for (_, _, key), text in zip(templates, self.texts, strict=True):
            k = words_of(key.encode())
            at = next(i for i in range(len(text)) if text[i : i + len(k)] == k)
            self.keys.append((at, k))
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, text in enumerate(self.texts):
            for i, w in enumerate(text):
                self.postings[w].append((t, i))
        self.base = {tuple(w.encode() for w in p): label for p, label in BASE.items()}
        self.base_first = {p[0] for p in self.base}
        self.vocabulary = frozenset(self.postings) | self.base_first

    def anchors(self, idf: dict[bytes, float]) -> list[tuple[bytes, list[tuple[int, list[tuple[int, bytes]]]]]]:
        """Words in descending IDF, each with the templates whose rarest anchor it is and all anchors of those: (place, word)."""
        found: dict[bytes, list[tuple[int, list[tuple[int, bytes]]]]] = defaultdict(list)
        for t, (at, key) in enumerate(self.keys):
            order = sorted(range(len(key)), key=lambda i: (-idf.get(key[i], math.inf), key[i], i))[:ANCHORS]
            found[key[order[0]]].append((t, [(at + i, key[i]) for i in order]))
        return sorted(found.items(), key=lambda x: (-idf.get(x[0], math.inf), x[0]))

    def matches(self, words: list[bytes], places: dict[bytes, list[int]], anchors: list[tuple[bytes, list[tuple[int, list[tuple[int, bytes]]]]]]) -> dict[int, float]:
        """The best coverage of every template found in a file, from the places of its licence words."""
        found: dict[int, float] = {}
        for rarest, templates in anchors:
            if rarest not in places:
                continue
            for t, (first, *others) in templates:
                if any(w not in places for _, w in others):
                    continue
                starts = {p - first[0] for p in places[first[1]]}
                for i, w in others:
                    starts &= {p - i for p in places[w]}
                at, key = self.keys[t]
                text = self.texts[t]
                for start in starts:
                    if start + at < 0 or words[start + at : start + at + len(key)] != key:
                        continue
                    there = words[max(start, 0) : start + len(text)]
                    share = sum(a == b for a, b in zip(text[max(-start, 0) :], there, strict=False)) / len(text)
                    if share >= COVERAGE:
                        found[t] = max(share, found.get(t, 0.0))
        return found

    def base_places(self, words: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[int, str]]:
        """(start, label) of every place where a base phrase stands."""
        return [
            (i, label) for p, label in self.base.items() for i in places.get(p[0], ()) if tuple(words[i : i + len(p)]) == p
        ]


def _places(words: list[bytes], vocabulary: frozenset[bytes]) -> dict[bytes, list[int]]:
    found: dict[bytes, list[int]] = {}
    if not vocabulary.isdisjoint(words):
        for i, w in enumerate(words):
            if w in vocabulary:
                found.setdefault(w, []).append(i)
    return found


def document_frequencies(docs: DataFrame, index: Index) -> tuple[int, dict[bytes, int]]:
    """Rows of docs, and for each licence word the number of rows that hold it, over all of docs.

    Every Arrow batch is counted by itself; the counts are summed in Spark. One number for each vocabulary word arrives.
    """
    send = docs.sparkSession.sparkContext.broadcast(index)
    bare, own = plain(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = send.value.vocabulary
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for at in range(0, batch.num_rows, 512):
                for t in batch.column(0).slice(at, 512).cast(pa.binary()).to_pylist():
                    seen.update(vocabulary.intersection(words_of(t)))
            seen[b""] = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen]), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = bare.select(F.col(own["text"]).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    total = {r["word"].encode(): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return total.pop(b"", 0), total


def scan(docs: DataFrame, keep: list[str] | None = None, templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """One row for each row of docs: `_row` (its columns `keep`, all by default), n_words, n_base, first_word, last_word,
    base_labels, labels and score (the best coverage of a template; 0.5 where only base phrases stand; else 0).

    A null text counts as empty. Repeated rows each keep a row. Words of equal IDF are looked up in alphabetical order, and of several
    places of a template the best counts. Texts of any length and with any number of places are scanned whole, and every template
    is looked for. Other columns keep their values, whatever their names. No rows in: no rows out.
    """
    index = Index(templates or TEMPLATES)
    rows, counts = document_frequencies(docs, index)
    idf = {w: math.log((rows + 1) / (counts.get(w, 0) + 1)) for w in index.vocabulary}
    send = docs.sparkSession.sparkContext.broadcast((index, index.anchors(idf)))
    bare, own, row = packed(docs, keep)
    source = bare.select(F.col(own["text"]).cast("string").alias("_text"), row.alias("_row"))
    new = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
    schema = source.select("_row", *[F.lit(None).cast(kind).alias(name) for name, kind in new]).schema
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def one(text: bytes | None, index: Index, anchors: list):
        words = words_of(text)
        places = _places(words, index.vocabulary)
        if not places:
            return len(words), 0, None, None, "", "", 0.0
        base = index.base_places(words, places)
        found = index.matches(words, places, anchors)
        own = {label for _, label in base}
        labels = own | {index.labels[t] for t in found}
        starts = [i for i, _ in base]
        score = max([0.5 if base else 0.0, *found.values()])
        return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, anchors = send.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [one(t, index, anchors) for t in part.column(0).cast(pa.binary()).to_pylist()]
                columns = [pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(zip(*found, strict=True), new, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1), *columns], names=["_row", *[n for n, _ in new]])

    return source.mapInArrow(run, schema)
