"""License scan by a positional index of rare words (operator 13).

The index holds, for every word of the licence templates, the templates and positions at which it stands. Inverse document
frequencies of these words are counted over all documents. Of the words that a file shares with a template, the ``RARE`` with
the highest frequency weight are looked up: every place of such a word in the file and every posting of it give a relative
position, and where enough different words agree on one (up to ``SLACK`` words, for a word put in or left out) the template
may stand. It does if its mandatory key phrases stand there word by word, and if the words found at their places carry at
least ``LEAST`` of the template's weight. A file without all words of the mandatory phrases is passed over.

Base phrases are found at every place. The score of a file is 1 where a base phrase stands, else the largest share of weight of
a template found, else 0.

Defined results
    NULL and empty texts have no words, no label (an empty string) and score 0. Only text is read; repeated rows have equal
    results; equal weights go by the word. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RARE = 4
AGREE = 2
SLACK = 2
LEAST = 0.75

# Base phrases and their labels (fixed values)
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Opening words of common public licence notices: label, words, mandatory key phrases (fixed values)
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
            " the software to deal in the software without restriction", ("permission is hereby granted", "free of charge")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
     ("free software", "gnu general public license")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
     ("gnu lesser general public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc", "4 0")),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa", "4 0")),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("source and binary forms", "are permitted")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "hereby granted")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; A-Z in lower case."""
    return (text or "").encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]


def _split(text: str) -> tuple[bytes, ...]:
    return tuple(words_of(text))


class Index:
    """Postings of the words of templates, and the weight of every word."""

    def __init__(self, templates: tuple = TEMPLATES, phrases: tuple = PHRASES):
        self.templates = [Template(label, _split(text), tuple(map(_split, keys))) for label, text, keys in templates]
        self.phrases = [(_split(text), label) for text, label in phrases]
        self.joined = [(b" " + b" ".join(p) + b" ", p, label) for p, label in self.phrases]
        self.vocabulary = sorted({w for t in self.templates for w in t.words})
        self.known = frozenset(self.vocabulary)
        self.musts = [frozenset(w for key in t.keys for w in key) for t in self.templates]
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, t in enumerate(self.templates):
            for i, w in enumerate(t.words):
                self.postings[w][k].append(i)
        self.weight: dict[bytes, float] = {}

    def weigh(self, documents: int, frequency: dict[bytes, int]) -> None:
        self.weight = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) + 1 for w in self.vocabulary}

    def base(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start, label) of every place of a base phrase."""
        whole, out = b" " + b" ".join(words) + b" ", []
        for joined, phrase, label in self.joined:
            if joined in whole:
                n, at = len(phrase), -1
                for _ in range(words.count(phrase[0])):
                    at = words.index(phrase[0], at + 1)
                    if tuple(words[at:at + n]) == phrase:
                        out.append((at, label))
        return out

    def find(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """(label, start, share of weight) of every template that stands in the words."""
        have = self.known.intersection(words)
        out, places = [], None
        for k, must in enumerate(self.musts):
            if must and must <= have:
                if places is None:
                    places = defaultdict(list)
                    for i, w in enumerate(words):
                        if w in self.known:
                            places[w].append(i)
                out += self._stands(k, words, places)
        return out

    def rarest(self, k: int, places: dict[bytes, list[int]]) -> list[bytes]:
        """The words that the file shares with a template, highest weight first."""
        return sorted({w for w in self.templates[k].words if w in places}, key=lambda w: (-self.weight[w], w))[:RARE]

    def _stands(self, k: int, words: list[bytes], places: dict[bytes, list[int]]) -> Iterator[tuple[str, int, float]]:
        template, rare = self.templates[k], self.rarest(k, places)
        hits = sorted((p - i, w) for w in rare for i in self.postings[w][k] for p in places[w])
        need, low, last = min(AGREE, len(rare)), 0, None
        inside: dict[bytes, int] = defaultdict(int)
        for diagonal, w in hits:
            inside[w] += 1
            while hits[low][0] < diagonal - SLACK:
                inside[hits[low][1]] -= 1
                low += 1
            if sum(n > 0 for n in inside.values()) < need or (last is not None and diagonal - last <= SLACK):
                continue
            start = hits[low][0]
            if self._keys_stand(template, words, start) and (share := self._share(template, places, start)) >= LEAST:
                last = diagonal
                yield template.label, max(0, start), share

    @staticmethod
    def _keys_stand(template: Template, words: list[bytes], start: int) -> bool:
        near = words[max(0, start - SLACK):start + len(template.words) + 2 * SLACK]
        return all(any(tuple(near[i:i + len(key)]) == key for i in range(len(near))) for key in template.keys)

    def _share(self, template: Template, places: dict[bytes, list[int]], start: int) -> float:
        """The weight of the template's words that stand within the slack of their places, of the whole weight."""
        found = total = 0.0
        for i, w in enumerate(template.words):
            total += self.weight[w]
            at = places.get(w, ())
            if bisect_left(at, start + i) < bisect_right(at, start + i + 2 * SLACK) or bisect_left(at, start + i - SLACK) < bisect_right(at, start + i):
                found += self.weight[w]
        return found / total


def weighed(docs: DataFrame, index: Index, text_col: str = "text") -> Index:
    """The index with its words' frequencies over all documents: one number per word reaches the driver."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)
        n = 0
        for batch in batches:
            for text in batch.column(0):
                n += 1
                for w in index.known.intersection(words_of(text.as_py())):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.binary()), pa.array([*counts.values(), n], pa.int64())], names=["word", "n"])
    counted = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(of, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in counted}
    index.weigh(frequency.pop(None, 0), frequency)
    return index


RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
          " spans array<struct<label:string,start:long,share:double>>")


def scan(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the places of base phrases, the labels of phrases and templates, and where the templates stand."""
    index = Index(templates, phrases)
    index.postings = {w: dict(p) for w, p in index.postings.items()}
    index = weighed(docs, index, text_col)
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())]))
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), span]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                base, found = index.base(words), index.find(words)
                at = [p for p, _ in base]
                own = {label for _, label in base}
                rows.append((doc, len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)),
                             ",".join(sorted(own.union(label for label, _, _ in found))), 1.0 if base else max((s for _, _, s in found), default=0.0),
                             [{"label": a, "start": b, "share": c} for a, b, c in found]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(of, RESULT)
