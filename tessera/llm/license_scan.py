"""License scans with a positional rare-token index.

The index holds for each licence word its postings: the templates that have it, and where. How rare a word is comes from its
document frequency over the whole corpus. In a file the licence words are looked up from the highest IDF down: each of a
word's places and each of its postings give a place where the template would start, and postings of several words meet where
they give the same one. A template is looked up no further once the rarest word of each of its key phrases that the file can
hold has been: any place where a key phrase stands has been met by then. Last, a mandatory key phrase is verified where the
template has it; the score is the largest share of a template's words that stand in their places there.

Base: the places where the phrases of ``BASE`` stand, whatever surrounds them.

Defined results: a null or empty text has no words, no labels ("") and score 0; a
null doc_id stays null, and every row is scanned for itself; a negated notice has
the label that its phrase has.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, text_bytes

#: Phrases and labels: fixed values of the contract.
BASE = {
    b"gnu general public license": "gpl",
    b"apache license": "apache",
    b"cc by": "cc-by",
    b"mit license": "mit",
}
#: (label, identifier) of the short form that names a licence: fixed values.
SPDX = [("agpl", "AGPL-3.0"), ("apache-2.0", "Apache-2.0"), ("bsd-2-clause", "BSD-2-Clause"), ("bsd-3-clause", "BSD-3-Clause"), ("cc0", "CC0-1.0"), ("epl", "EPL-2.0"), ("gpl-2.0", "GPL-2.0"), ("gpl-3.0", "GPL-3.0"), ("isc", "ISC"), ("lgpl", "LGPL-2.1"), ("lgpl", "LGPL-3.0"), ("mit", "MIT"), ("mpl", "MPL-2.0"), ("unlicense", "Unlicense")]
#: (label, notice as its licence words it, mandatory key phrases, one of which must stand in it).
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", ("apache license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("agpl", "This program is licensed under the GNU Affero General Public License", ("gnu affero general public license",)),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause License", ("bsd 2 clause",)),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License", ("bsd 3 clause",)),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-Share Alike 4.0 International License", ("creative commons attribution share alike",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    ("gpl", "modify it under the terms of this license, either version 3 of the License, or (at your option) any later version", ("license or at your option any later version",)),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-2.0", "under the terms of the GPL version 2", ("gpl version 2",)),
    ("gpl-3.0", "under the terms of the GPL version 3", ("gpl version 3",)),
    ("mpl", "subject to the terms of the Mozilla Public Licence", ("mozilla public licence",)),
    *((label, f"SPDX-License-Identifier: {name}", (f"spdx license identifier {name.lower().replace('-', ' ').replace('.', ' ')}",)) for label, name in SPDX),
]

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def license_words(text: bytes) -> list[bytes]:
    """A-Z in lower case, then words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(_LETTERS).split()


def vocabulary() -> list[bytes]:
    return sorted({w for _, notice, keys in TEMPLATES for t in (notice, *keys) for w in license_words(t.encode())})


def document_frequencies(docs: DataFrame) -> dict[bytes, int]:
    """In how many texts each licence word stands, over all texts, and under "" how many texts there are. The vocabulary bounds the result."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, counts = set(vocabulary()), Counter({b"": batch.num_rows})
        for text in text_bytes(batch.column("text")):
            counts.update(known.intersection(license_words(text)))
        return pa.record_batch({"word": pa.array([w.decode() for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return {r["word"].encode(): r["n"] for r in map_rows(docs.select("text"), of_batch, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


class LicenseIndex:
    def __init__(self, frequencies: dict[bytes, int]):
        total = frequencies.get(b"", 0)
        self.idf = {w: math.log(1 + (1 + total) / (1 + frequencies.get(w, 0))) for w in vocabulary()}
        self.templates = [(label, license_words(t.encode()), [license_words(k.encode()) for k in keys]) for label, t, keys in TEMPLATES]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, _) in enumerate(self.templates):
            for at, w in enumerate(words):
                self.postings[w].append((t, at))
        #: (template, phrase, places of the phrase in the template, rarest word of it) of every key phrase.
        self.keys = [(t, key, [i for i in range(len(words)) if words[i : i + len(key)] == key], max(key, key=self._rarity)) for t, (_, words, keys) in enumerate(self.templates) for key in keys]
        self.looked_up = 0

    def _rarity(self, word: bytes) -> tuple[float, bytes]:
        return self.idf[word], word

    def scan(self, words: list[bytes]) -> tuple[set[str], float]:
        """(labels, score) of a file."""
        places: dict[bytes, list[int]] = defaultdict(list)
        known = self.idf.keys() & set(words)
        possible = [k for k in self.keys if known.issuperset(k[1])]
        if not possible:
            return set(), 0.0
        last: dict[int, tuple[float, bytes]] = {}  # of each template the least rare word that it must be looked up by
        for t, _, _, rarest in possible:
            last[t] = min(last.get(t, (math.inf, b"")), self._rarity(rarest))
        lowest = min(last.values())
        rare = {w for w in known if self._rarity(w) >= lowest}
        for at, w in enumerate(words):
            if w in rare:
                places[w].append(at)
        starts: dict[int, Counter] = defaultdict(Counter)  # by template: the postings that agree on where it starts
        self.looked_up = 0
        for w in sorted(rare, key=self._rarity, reverse=True):
            for t, inside in self.postings[w]:
                if t in last and self._rarity(w) >= last[t]:
                    self.looked_up += len(places[w])
                    starts[t].update(at - inside for at in places[w])
        labels, best = set(), 0.0
        for t, key, insides, _ in possible:
            label, template, _ = self.templates[t]
            for start in starts[t]:
                if any(start + i >= 0 and words[start + i : start + i + len(key)] == key for i in insides):
                    labels.add(label)
                    there = words[max(0, start) : max(0, start + len(template))]
                    best = max(best, sum(a == b for a, b in zip(template[max(0, -start) :], there, strict=False)) / len(template))
        return labels, best


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of each place where the words of a phrase stand consecutively."""
    line, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in BASE.items():
        at, counted, words_before = line.find(b" " + phrase + b" "), 0, 0
        while at >= 0:
            words_before, counted = words_before + line.count(b" ", counted, at), at
            out.append((words_before, label))
            at = line.find(b" " + phrase + b" ", at + 1)
    return out


def license_scan(docs: DataFrame) -> DataFrame:
    frequencies = document_frequencies(docs)
    made: list[LicenseIndex] = []

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(LicenseIndex(frequencies))
        out = []
        for text in text_bytes(batch.column("text")):
            words = license_words(text)
            base, (labels, score) = base_places(words), made[0].scan(words)
            starts, own = [s for s, _ in base], {x for _, x in base}
            out.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | labels)), score))
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        return pa.record_batch([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", *names])

    return map_rows(docs.select("doc_id", "text"), of_batch, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
