"""Licence scans over a positional index of rare template words.

The templates' words form a small fixed vocabulary. A first pass counts in how
many documents each occurs; only counts of that vocabulary are gathered. The
index maps a word to postings (template, position), for the rarest positions of
each template only: those of highest inverse document frequency, until they
weigh more than what a match may miss (one less ``COVERAGE``) and the heaviest
word together. At least two of them thus stand in place wherever the template
matches, whatever else the document holds. Every occurrence of such a word votes
for the (template, shift) pairs that its postings give, and shifts with two
votes are verified: the weight of the template's words that stand in place, and
its key phrase word for word. Nothing that a comparison of every template at
every shift would find is left out. Phrases that name a licence outright are
found exactly, wherever they stand.

Nothing is joined or shuffled but the vocabulary's counts, and each document is
read whole, on its own, however long. Null and empty texts have no words, no
labels and score 0; null ids don't matter. Repeated rows are scanned like any
other (each counts as a document). Words of equal weight go by their letters.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that name a licence outright: (words, label).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Least share of a template's weight that must stand in place.
COVERAGE = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str


#: Sentences of well-known notices, as words, with the phrase that each must hold.
TEMPLATES = (
    Template("mit", "released under the mit license", "the mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        "permission is hereby granted free of charge",
    ),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "apache org licenses license 2 0",
    ),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template(
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu general public license as published by the free software foundation either version 3",
    ),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template(
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version 2 of the license or at your option any later version",
        "gnu general public license as published by the free software foundation either version 2",
    ),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    Template(
        "lgpl-2.1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
        "as published by the free software foundation either version 2 1 of the license or at your option any later version",
        "gnu lesser general public license as published by the free software foundation either version 2 1",
    ),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    Template(
        "agpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license "
        "as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu affero general public license",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    Template(
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission",
        "endorse or promote products derived from this software",
    ),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        "with or without fee",
    ),
    Template(
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
        "redistribute it freely subject to the following restrictions",
        "to alter it and redistribute it freely",
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)

_LETTERS = bytes(
    x + 32 if 0x41 <= x <= 0x5A else x if x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A else 0x20 for x in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits, in lower case, and of all that isn't ASCII."""
    return text.translate(_LETTERS).split() if text else []


class Index:
    """Postings of the templates' rarest places, weighted by document frequency."""

    def __init__(self, documents: int = 0, found: dict[bytes, int] | None = None, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = [(t.label, t.text.encode().split(), t.key.encode().split()) for t in templates]
        found = found or {}
        vocabulary = {w for _, words, _ in self.templates for w in words}
        self.weight = {w: max(math.log((documents + 1) / (found.get(w, 0) + 0.5)), 1e-6) for w in vocabulary}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed: list[int] = []
        for number, (_, words, _) in enumerate(self.templates):
            weights = [self.weight[w] for w in words]
            enough = (1 - COVERAGE) * sum(weights) + max(weights)
            indexed = 0.0
            for place in sorted(range(len(words)), key=lambda i: (-weights[i], words[i], i)):
                self.postings[words[place]].append((number, place))
                indexed += weights[place]
                if indexed > enough * (1 + 1e-9):
                    break
            # Where one word outweighs all else, its vote alone must do.
            self.needed.append(2 if indexed > enough * (1 + 1e-9) else 1)

    def matches(self, number: int, shift: int, words: list[bytes]) -> float:
        """The share of a template's weight that stands in place at a shift, or 0 where that or the key phrase doesn't suffice."""
        _, template, key = self.templates[number]
        start = max(shift, 0)
        here = words[start : shift + len(template)]
        met = sum(self.weight[w] for w, x in zip(template[start - shift :], here, strict=False) if w == x)
        score = met / sum(self.weight[w] for w in template)
        return min(score, 1.0) if score >= COVERAGE and _places(here, key) else 0.0

    def scan(self, words: list[bytes]) -> dict[str, float]:
        """Labels of verified templates with their scores."""
        postings = self.postings
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for at, word in enumerate(words):
            if word in postings:
                for number, place in postings[word]:
                    votes[number, at - place] += 1
        out: dict[str, float] = {}
        for (number, shift), n in votes.items():
            if n >= self.needed[number] and (score := self.matches(number, shift, words)):
                label = self.templates[number][0]
                out[label] = max(out.get(label, 0.0), score)
        return out


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    n = len(phrase)
    return [i for i in range(len(words) - n + 1) if words[i] == phrase[0] and words[i : i + n] == phrase]


def _phrases(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """(place, label) of every phrase, places counted in words."""
    out = []
    for phrase, label in phrases:
        first = phrase[0]
        at = -1
        try:
            while True:
                at = words.index(first, at + 1)
                if words[at : at + len(phrase)] == phrase:
                    out.append((at, label))
        except ValueError:
            continue
    return out


def document_counts(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those that hold each template word. The driver gets a row per template word."""
    vocabulary = frozenset(w for t in templates for w in t.text.encode().split())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)
        documents = 0
        for batch in batches:
            documents += batch.num_rows
            for text in batch.column(0).cast(pa.binary()):
                for word in vocabulary.intersection(words_of(text.as_py())):
                    counts[word] += 1
        rows = [(b"", documents), *counts.items()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found.pop(b"", 0), found


def scan(docs: DataFrame, phrases=PHRASES, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    index = Index(*document_counts(docs, templates), templates)
    # A phrase is looked for from its rarest word's point of view only if the text holds that word.
    named = [(phrase.encode().split(), label) for phrase, label in phrases]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()):
                words = words_of(text.as_py())
                found = _phrases(words, named)
                base = sorted({label for _, label in found})
                places = [at for at, _ in found]
                scored = index.scan(words)
                rows.append(
                    (
                        len(words),
                        len(found),
                        min(places, default=None),
                        max(places, default=None),
                        ",".join(base),
                        ",".join(sorted({*base, *scored})),
                        1.0 if base else max(scored.values(), default=0.0),
                    )
                )
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )


def base_sql(phrases=PHRASES) -> str:
    """The columns that need no index, for a check of them."""
    hits = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM p WHERE " + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
        for phrase, label in phrases
    )
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
h AS ({hits}),
g AS (SELECT doc_id, count(*) AS n, min(pos) AS f, max(pos) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS b FROM h GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
  coalesce(b, '') AS base_labels FROM w LEFT JOIN g ON w.doc_id = g.doc_id"""
