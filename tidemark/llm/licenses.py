"""License scans as an exact set-similarity join between text blocks and license templates.

Blocks are windows of words over the whole text, line breaks or not: for a template of n words windows of 2 n words,
half of n apart, so that any passage of up to one and a half times its length lies whole in one. A template is in a block when the
block's words hold at least THRESHOLD of the template's distinct words. Words are ordered by how many
documents of the whole corpus have them, rarest first. A pair can only qualify if the block has one of the
first |T| - need + 1 words of the template in that order (prefix filter), at least ``need`` distinct words
(length filter), and if at every step of the merge what is matched and what is left on either side reach
``need`` (positional filter). The join is exact: the filters only skip pairs that can't qualify.

The templates are a fixed, small list, so they and their word counts go to every task; the counts gathered
from the corpus are one for each of the templates' words. Beside the join, three short phrases are found
wherever their words stand consecutively.

Cases: null text counts as empty; a text without words has no labels and score 0; repeated rows are handled
each; an empty corpus orders words by spelling alone. Other columns of the input aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import quoted

THRESHOLD = 0.85

#: Phrase and label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Label and template, from the notices that the licenses themselves ask for.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: A-Z become a-z, other ASCII signs but digits and letters become spaces, bytes of other characters stay.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS)


def words(text: str | None) -> list[bytes]:
    return _bytes(text).split()


def template_words() -> frozenset[bytes]:
    return frozenset(w for _, t in TEMPLATES for w in words(t))


class Index:
    """The templates in the global order, and the inverted index of their prefixes."""

    def __init__(self, frequency: dict[bytes, int], threshold: float = THRESHOLD) -> None:
        order = sorted(template_words(), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.templates = []
        self.prefixes: dict[bytes, list[int]] = {}
        for label, text in TEMPLATES:
            ranks = sorted(self.rank[w] for w in set(words(text)))
            need = math.ceil(threshold * len(ranks) - 1e-9)
            for r in ranks[: len(ranks) - need + 1]:
                self.prefixes.setdefault(order[r], []).append(len(self.templates))
            self.templates.append((label, ranks, need, len(words(text))))
        self.first = frozenset(self.prefixes)

    def found(self, held: list[bytes]) -> Iterator[tuple[str, float]]:
        """(label, containment) of every template that a window of a text's words holds. Only windows with a word of the template's prefix are looked at."""
        asked: set[tuple[int, int]] = set()
        for at, w in enumerate(held):
            if w in self.first:
                for t in self.prefixes[w]:
                    size, step = window(self.templates[t][3])
                    asked.update((t, start) for start in range(max(0, (at - size) // step + 1) * step, at + 1, step))
        for t, start in asked:
            label, ranks, need, n = self.templates[t]
            distinct = set(held[start : start + window(n)[0]])
            if len(distinct) >= need:
                shared = _overlap(ranks, sorted(self.rank[w] for w in distinct if w in self.rank), need)
                if shared >= need:
                    yield label, shared / len(ranks)


def window(n: int) -> tuple[int, int]:
    """Words of a block for a template of n words, and words from one block's start to the next."""
    return 2 * n, max(1, n // 2)


def _overlap(a: list[int], b: list[int], need: int) -> int:
    """How many values two ascending lists share, or less than need as soon as it can't be reached."""
    i = j = shared = 0
    while i < len(a) and j < len(b):
        if shared + min(len(a) - i, len(b) - j) < need:
            return 0
        if a[i] == b[j]:
            shared, i, j = shared + 1, i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return shared


def phrase_places(held: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of each place where a phrase's words stand consecutively."""
    joined, places = b" " + b" ".join(held) + b" ", []
    for phrase, label in PHRASES.items():
        sought = b" " + phrase.encode() + b" "
        at = joined.find(sought)
        while at >= 0:
            places.append((joined.count(b" ", 0, at), label))
            at = joined.find(sought, at + 1)
    return places


def scan_text(text: str | None, index: Index) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    held = words(text)
    places = phrase_places(held)
    base = {label for _, label in places}
    labels, score = set(base), 1.0 if base else 0.0
    if not index.first.isdisjoint(held):
        for label, share in index.found(held):
            labels.add(label)
            score = max(score, share)
    starts = [p for p, _ in places]
    return len(held), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 6)


_TYPES = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def frequencies(docs: DataFrame, text_col: str = "text") -> dict[bytes, int]:
    """How many documents have each of the templates' words; one number a word comes back."""
    vocabulary = template_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for t in batch.column(0):
                for w in vocabulary.intersection(words(t.as_py())):
                    counts[w] = counts.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    seen = docs.select(quoted(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return {r["word"].encode(): r["n"] for r in seen.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    frequency = frequencies(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(frequency, threshold)
        for batch in batches:
            rows = [scan_text(t.as_py(), index) for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES.values()))], names=["id", *_TYPES])

    slim = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
