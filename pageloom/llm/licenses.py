"""License notices by a positional index of rare words.

The index lists, for every licence word, the templates and positions it has in their key phrases. Of a file, the licence
words it has are looked up by falling IDF; a template whose key words are all there is placed by the two rarest of them:
the places where both stand at the distance they have in the template. There the whole key phrase must stand, further
mandatory phrases near it, and enough of the template's other words before and behind it in their order, whatever
few words were put in between or left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import LOWER_BYTES, id_and_text, slices

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Phrases of which every place counts, and opening words of public notices with their key phrase.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gnu general public license as published"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "gnu general public license as published"),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", "gnu lesser general public license"),
    ("lgpl-3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", "gnu lesser general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "without any express or implied warranty"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial"),
    ("cc-by", "creative commons attribution 4 0 international", "creative commons attribution 4 0"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]
# Mandatory phrases besides the key, by template: what tells versions of one notice apart.
ALSO = {
    ("gpl-3", "gnu general public license as published"): "version 3 of the license", ("gpl-2", "gnu general public license as published"): "version 2 of the license",
    ("lgpl-2.1", "gnu lesser general public license"): "version 2 1 of the license", ("lgpl-3", "gnu lesser general public license"): "version 3 of the license",
    ("agpl-3", "gnu affero general public license"): "version 3 of the license"}
# The words of short identifiers behind `SPDX-License-Identifier:`, and of addresses that name a licence.
IDENTIFIERS = {
    "mit": "mit", "apache 2 0": "apache-2", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3", "agpl 3 0": "agpl-3",
    "mpl 2 0": "mpl-2", "epl 2 0": "epl-2", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "isc": "isc", "unlicense": "unlicense", "zlib": "zlib",
    "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc"}
ADDRESSES = {
    "apache org licenses license 2 0": "apache-2", "opensource org licenses mit": "mit", "mozilla org mpl 2 0": "mpl-2", "creativecommons org publicdomain zero 1 0": "cc0",
    "creativecommons org licenses by 4 0": "cc-by", "creativecommons org licenses by sa 4 0": "cc-by-sa", "creativecommons org licenses by nc 4 0": "cc-by-nc"}
LOOKED_UP, STRAY, LEAST_SCORE = 2, 8, 0.8


def common_length(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of `words` and the n words of which `masks` has the positions, as bits."""
    full = (1 << n) - 1
    open_ = full
    for w in words:
        met = open_ & masks.get(w, 0)
        open_ = ((open_ + met) | (open_ - met)) & full
    return n - open_.bit_count()


def positions(words: list[bytes]) -> dict[bytes, int]:
    masks: dict[bytes, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def stands_in(phrase: list[bytes], words: list[bytes]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


class Template:
    """A notice: words, key phrase, and what else must stand within the notice's length and `STRAY` words of the key."""

    def __init__(self, label: str, text: str, key: str, also: str | None = None, base: bool = False):
        self.label, self.words, self.key, self.base = label, text.encode().split(), key.encode().split(), base
        self.also = also.encode().split() if also else None
        n = len(self.key)
        at = next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key)
        self.before, self.behind = self.words[:at], self.words[at + n :]
        self.masks = positions(self.before), positions(self.behind)

    def score(self, words: list[bytes], at: int) -> float:
        """Share of the template's words found in their order around the key phrase, 0 unless that stands at `at`."""
        end = at + len(self.key)
        if at < 0 or words[at:end] != self.key:
            return 0.0
        before = words[max(0, at - len(self.before) - STRAY) : at] if self.before else []
        behind = words[end : end + len(self.behind) + STRAY] if self.behind else []
        if self.also and not (stands_in(self.also, before) or stands_in(self.also, behind)):
            return 0.0
        found = common_length(self.masks[0], len(self.before), before) + common_length(self.masks[1], len(self.behind), behind)
        return (len(self.key) + found) / len(self.words)


def templates() -> list[Template]:
    whole = [*((x, f"spdx license identifier {w}") for w, x in IDENTIFIERS.items()), *((x, w) for w, x in ADDRESSES.items())]
    return [
        *(Template(label, phrase, phrase, base=True) for label, phrase in BASE.items()),
        *(Template(label, text, key, ALSO.get((label, key))) for label, text, key in TEMPLATES),
        *(Template(label, text, text) for label, text in whole)]


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(LOWER_BYTES))


def document_frequencies(docs: DataFrame, vocabulary: list[bytes], text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Rows, and rows with each word of the vocabulary, over the whole table; one number per word reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, n = frozenset(vocabulary), Counter(), 0
        for batch in slices(batches):
            n += batch.num_rows
            for text in batch.column("text").to_pylist():
                counts.update(known.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.binary()), pa.array([*counts.values(), n], pa.int64())], ["word", "n"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    found = {None if r[0] is None else bytes(r[0]): r[1] for r in parts.groupBy("word").agg(F.sum("n")).collect()}
    return found.pop(None, 0), found


class RareWordIndex:
    """Postings (template, position in its key phrase) of every word of a key phrase."""

    def __init__(self, listed: list[Template], n_docs: int, frequency: dict[bytes, int]):
        self.templates = listed
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for t in listed for w in t.key}
        self.keys = [frozenset(t.key) for t in listed]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(listed):
            for at, w in enumerate(t.key):
                if w not in t.key[:at]:
                    self.postings.setdefault(w, []).append((k, at))
        self.vocabulary = frozenset(self.postings)

    def lookups(self, have: frozenset[bytes]) -> dict[int, list[tuple[bytes, int]]]:
        """By template, the rarest of the file's licence words with their positions; templates that lack a key word are out."""
        taken: dict[int, list[tuple[bytes, int]]] = {}
        for w in sorted(have, key=lambda w: (-self.idf[w], w)):
            for k, at in self.postings[w]:
                if self.keys[k] <= have and len(chosen := taken.setdefault(k, [])) < LOOKED_UP:
                    chosen.append((w, at))
        return taken

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places of base phrases as (first word, label), and the best score of every label found."""
        lookups = self.lookups(self.vocabulary.intersection(words))
        rows: dict[bytes, list[int]] = {w: [] for chosen in lookups.values() for w, _ in chosen}
        if rows:
            for i, w in enumerate(words):
                if w in rows:
                    rows[w].append(i)
        places, labels = [], {}
        for k, chosen in lookups.items():
            t = self.templates[k]
            starts = set.intersection(*({i - at for i in rows[w]} for w, at in chosen))
            for start in starts:
                if not t.base and labels.get(t.label) == 1.0:
                    break  # no place can add to it
                score = t.score(words, start)
                if t.base and score == 1.0:
                    places.append((start, t.label))
                if score >= LEAST_SCORE:
                    labels[t.label] = max(score, labels.get(t.label, 0.0))
        return places, labels


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, found) per row: `places` are structs (word, label) of base phrases in text order,
    `found` are structs (label, score) of all licences, by label.

    Only A-Z are lower-cased; words are runs of digits, letters a-z and anything beyond ASCII. A null text has no
    words. The corpus frequencies only choose the words that are looked up: every place of a key phrase has them all, so
    what is found is the same whatever they are, and rows do not depend on each other. An empty table gives an empty one.
    """
    listed = templates()
    vocabulary = sorted({w for t in listed for w in t.key})
    n_docs, frequency = document_frequencies(docs, vocabulary, text_col)
    index = RareWordIndex(listed, n_docs, frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                places, labels = index.find(words)
                rows.append((len(words), [{"word": w, "label": x} for w, x in sorted(places)], [{"label": x, "score": labels[x]} for x in sorted(labels)]))
            n_words, places, found = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_words, pa.int64()),
                pa.array(places, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())])))], ["doc_id", "n_words", "places", "found"])

    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, (
        f"doc_id {kind}, n_words long, places array<struct<word:bigint,label:string>>, found array<struct<label:string,score:double>>"))
