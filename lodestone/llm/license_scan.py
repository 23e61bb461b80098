"""License scan: an exact set-similarity join of text blocks with license templates.

A block is any run of a text's words, over lines, as long as SLACK times the template's number of distinct words: long
enough for the template with words put in between, and words scattered further over a text don't match. A template's words are ordered by how often the whole corpus holds them, rarest first; only words
of the templates are counted, so the order is bounded by the templates. Of a template with n words of which m must be
found, any match holds one of the n - m + 1 rarest (prefix filter); the text needs m of its words (length filter); and what is
left of the template and of the text's words behind the first common word must still make m (positional filter). Of what
passes, the template's words are counted in every block, so all at THRESHOLD or above are found and none below.

Beside the templates' labels stand those of three base phrases. Null and empty texts have no words, no label and
score 0. Score: the largest containment found, 1 with a base phrase.

Defined cases of the query besides: equal rows have equal results, each its own; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common as c

THRESHOLD = 0.8
#: Words of a block for each distinct word of the template.
SLACK = 1.5
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_W = rb"[0-9a-z\x80-\xff]"
_WORDS = re.compile(_W + rb"+")
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
_BASE = re.compile(b"|".join(b"(?P<%s>(?<!%s)%s(?!%s))" % (k.replace("-", "_").encode(), _W, (b"[^0-9a-z\\x80-\\xff]+").join(v.encode().split()), _W) for k, v in BASE.items()))
#: Label and wording of what is looked for; one entry for each sentence.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License"),
    ("apache-2.0", "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("gnu", "This work is licensed under the GNU General Public License"),
    ("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution International License"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
_CODE = c.BYTE_CODE.copy()
_CODE[65:91] = c.BYTE_CODE[97:123]


def words(text: str) -> list[bytes]:
    return _WORDS.findall(lower(text.encode()))


def lower(text: bytes) -> bytes:
    """A-Z only."""
    return text.lower()  # of bytes: ASCII only


class Templates:
    """The templates in the corpus's order, with an index of their prefixes."""

    def __init__(self, counts: dict[bytes, int], templates: list[tuple[str, str]], threshold: float):
        self.labels = [x for x, _ in templates]
        self.rank = {w: i for i, w in enumerate(sorted({w for _, t in templates for w in words(t)}, key=lambda w: (counts.get(w, 0), w)))}
        self.sets = [sorted({self.rank[w] for w in words(t)}) for _, t in templates]
        self.need = [max(1, int(np.ceil(threshold * len(s) - 1e-9))) for s in self.sets]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (s, m) in enumerate(zip(self.sets, self.need, strict=True)):
            for i, r in enumerate(s[: len(s) - m + 1]):
                self.index.setdefault(r, []).append((t, i))
        name = {i: w for w, i in self.rank.items()}
        self.rare = [name[r] for r in self.index]

    def match(self, text: bytes) -> dict[int, float]:
        """Containment of each template that some block of the lower-cased text meets."""
        if not any(w in text for w in self.rare):
            return {}
        places: dict[int, list[int]] = {}
        for at, w in enumerate(_WORDS.findall(text)):
            if (r := self.rank.get(w)) is not None:
                places.setdefault(r, []).append(at)
        own = sorted(places)
        best: dict[int, float] = {}
        tried = set()
        for at, r in enumerate(own):
            for t, i in self.index.get(r, ()):
                if t in tried or len(own) < self.need[t]:
                    continue
                tried.add(t)  # r is the first common word: those before it in either list aren't in the other
                if 1 + min(len(self.sets[t]) - i - 1, len(own) - at - 1) >= self.need[t]:
                    common = [x for x in self.sets[t] if x in places]
                    if len(common) >= self.need[t] and (n := self.most(t, common, places)) >= self.need[t]:
                        best[t] = n / len(self.sets[t])
        return best

    def most(self, t: int, common: list[int], places: dict[int, list[int]]) -> int:
        """The most distinct words of a template that one block holds."""
        width = int(np.ceil(SLACK * len(self.sets[t])))
        seats = sorted((at, x) for x in common for at in places[x])
        held: dict[int, int] = {}
        most = first = 0
        for at, x in seats:
            held[x] = held.get(x, 0) + 1
            while seats[first][0] <= at - width:
                y = seats[first][1]
                held[y] -= 1
                if not held[y]:
                    del held[y]
                first += 1
            most = max(most, len(held))
        return most


def frequencies(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """How often all documents hold each of the given words."""
    data = np.frombuffer(b" ".join(vocabulary), np.uint8)
    h, _ = c.words_of(data, np.array([0, len(data)]), WORD, _CODE)
    order = np.argsort(h)
    keys = h[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(keys), np.int64)
        for b in batches:
            w, _ = c.words_of(*c.utf8(b.column(0)), WORD, _CODE)
            at = np.searchsorted(keys, w)
            at[at == len(keys)] = 0
            n += np.bincount(at[keys[at] == w], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(order.astype(np.int32)), pa.array(n)], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {vocabulary[r.word]: r.n for r in rows}


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row of SCAN for every row of docs (doc_id, text)."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for _, t in templates for w in words(t)})
    index = Templates(frequencies(docs, vocabulary), templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = c.utf8(b.column(1))
            n_words = np.zeros(b.num_rows, np.int64)
            for i, j, s, _ in c.runs(data, off, WORD):
                n_words[i:j] = np.diff(np.searchsorted(s, off[i : j + 1]))
            rows = []
            for s, e in zip(off.tolist(), off[1:].tolist(), strict=False):
                text = lower(data[s:e].tobytes())
                base, places = set(), []
                if b"cc" in text or b"general" in text or b"reserved" in text:
                    for m in _BASE.finditer(text):
                        base.add(m.lastgroup.replace("_", "-"))
                        places.append(m.start())
                found = index.match(text)
                first, last = (len(_WORDS.findall(text[:p])) for p in (places[0], places[-1])) if places else (None, None)
                more = base | {index.labels[t] for t in found}
                rows.append((len(places), first, last, ",".join(sorted(base)), ",".join(sorted(more)), 1.0 if base else max(found.values(), default=0.0)))
            n, f, l, bl, al, sc = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n_words), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(l, pa.int64()), pa.array(bl, pa.string()), pa.array(al, pa.string()), pa.array(sc, pa.float64())], [x.split()[0] for x in SCAN.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCAN)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(c.table(spark, sf_dir, "documents"))
