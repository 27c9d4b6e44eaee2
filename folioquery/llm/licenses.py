"""Licence scan by a positional index of rare tokens.

Templates are licence phrases and notices as word sequences. The index maps a template's words of
highest inverse document frequency (counted over the whole corpus) to their places in the template.
A file's own licence words are looked up from the rarest on; each place of a word and each posting
give a start that the template would have in the file. Starts on which enough of a template's rare
words agree, allowing ``DRIFT`` words of insertion or loss for notices and none for phrases, are
candidates, and a candidate counts if its mandatory key phrases stand where they belong. Beside the
short notices here there are whole texts and version notices in license_texts, and find_licenses()
takes any further texts as templates.

A phrase is looked up by its single rarest word and verified word by word, so every place of it is
found. The base labels are phrases of this kind; the further templates add labels of their own. A text's
score is the best share of words in place of its verified notices and bodies, and ``MENTION`` where it only
names a licence.

Words: A-Z are lower-cased, then maximal runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. A long text is
scanned in portions that overlap by more than the longest template; matches are told apart by their
start, so none counts twice.

Defined cases: a null text has no words; a text without matches has empty labels, null first and
last words and score 0; equal frequencies are ordered by word; repeated rows are scanned alike; an
empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.common import map_batches, table, text_slices
from folioquery.llm.license_texts import BODIES

QUERY = "op1_license_scan"
ORACLE_SQL = None

#: Rare words of a notice that the index holds, and the share of them that must agree.
RARE_WORDS = 8
AGREE = 0.6
DRIFT = 6
#: Score of a text that only names a licence.
MENTION = 0.5
#: Bytes of a text whose words are held at a time.
PORTION = 8 << 20

# The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Further phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd-2",
    "bsd 3 clause": "bsd-3",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0": "cc0",
    "licensed under the apache license": "apache",
    "the mit license": "mit-name",
    "the unlicense": "unlicense",
    "boost software license": "bsl",
    "open database license": "odbl",
    "spdx license identifier": "spdx",
}

#: Notices: label, words, phrases that must stand in them.
NOTICES = [
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ["hereby granted free of charge", "deal in the software without restriction"],
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ["with or without fee is hereby granted"],
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ["source and binary forms", "following conditions are met"],
    ),
    (
        "apache-2-text",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ["apache license version 2 0", "except in compliance with the license"],
    ),
    (
        "gpl-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ["you can redistribute it", "gnu general public license as published by the free software foundation"],
    ),
    (
        "lgpl-text",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        ["this library is free software", "gnu lesser general public license as published"],
    ),
    (
        "mpl-text",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ["source code form is subject to the terms"],
    ),
    (
        "unlicense-text",
        "this is free and unencumbered software released into the public domain",
        ["free and unencumbered software"],
    ),
    (
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        ["without any express or implied warranty"],
    ),
    (
        "cc-text",
        "this work is licensed under a creative commons attribution international license",
        ["licensed under a creative commons"],
    ),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, tuple[bytes, ...]], ...]  # places and words that must stand
    is_phrase: bool
    is_base: bool


def _words(text: str) -> tuple[bytes, ...]:
    return tuple(text.encode().split())


def _place(words: tuple[bytes, ...], key: tuple[bytes, ...]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def templates() -> list[Template]:
    out = []
    for phrases, is_base in ((BASE_PHRASES, True), (PHRASES, False)):
        for text, label in phrases.items():
            w = _words(text)
            out.append(Template(label, w, ((0, w),), True, is_base))
    for label, text, keys in NOTICES + BODIES:
        w = _words(text)
        out.append(Template(label, w, tuple((_place(w, _words(k)), _words(k)) for k in keys), False, False))
    return out


TEMPLATES = tuple(templates())
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def template_of(label: str, text: str) -> Template:
    """A template of a licence's text as it stands in a file: its mandatory phrases are the
    five words at each quarter of it."""
    w = tuple(words_of(text))
    at = sorted({max(0, min(len(w) - 5, len(w) * k // 4)) for k in (1, 2, 3)})
    return Template(label, w, tuple((i, w[i : i + 5]) for i in at), False, False)


def portions(text: str | None, overlap: int = 0):
    """(place of the first word, words, how many of them are new) of a text, in portions that share
    overlap words."""
    raw = (text or "").encode("utf-8", "replace").translate(_TABLE)
    if len(raw) <= PORTION:
        words = raw.split()
        yield 0, words, len(words)
        return
    at, done, carry = 0, 0, []
    while at < len(raw):
        to = at + PORTION
        if to < len(raw):
            cut = raw.find(b" ", to)
            to = len(raw) if cut < 0 else cut
        new = raw[at:to].split()
        yield done - len(carry), carry + new, len(new)
        done += len(new)
        carry = (carry + new)[-overlap:] if overlap else []
        at = to


class Index:
    """Postings of the templates' rare words: word -> [(template, place)]."""

    def __init__(self, frequency: dict[bytes, int], n_docs: int, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.overlap = max(len(t.words) for t in templates) + 2 * DRIFT + 2
        self.idf = {w: math.log((1 + n_docs) / (1 + frequency.get(w, 0))) for t in templates for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.need = []
        for k, t in enumerate(templates):
            ranked = sorted(range(len(t.words)), key=lambda i: (-self.idf[t.words[i]], t.words[i], i))
            rare = ranked[: 1 if t.is_phrase else RARE_WORDS]
            self.need.append(max(1, math.ceil(AGREE * len(rare))))
            for i in rare:
                self.postings.setdefault(t.words[i], []).append((k, i))
        self.anchors = frozenset(self.postings)

    def matches(self, words: list[bytes]) -> set[tuple[int, int, float]]:
        """(template, start, share of its words in place) of every verified candidate."""
        if self.anchors.isdisjoint(words):
            return set()
        anchors, found = self.anchors, set()
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in anchors:
                places.setdefault(w, []).append(i)
        starts: dict[int, list[tuple[int, int]]] = {}
        for w in sorted(places, key=lambda w: (-self.idf[w], w)):
            for k, offset in self.postings[w]:
                t = self.templates[k]
                if t.is_phrase:
                    n = len(t.words)
                    found |= {(k, p - offset, 1.0) for p in places[w] if p >= offset and tuple(words[p - offset : p - offset + n]) == t.words}
                else:
                    starts.setdefault(k, []).extend((p - offset, offset) for p in places[w])
        for k, votes in starts.items():
            found |= self._notices(k, sorted(votes), words)
        return found

    def _notices(self, k: int, votes: list[tuple[int, int]], words: list[bytes]) -> set[tuple[int, int, float]]:
        """Starts agreed on within DRIFT, by a window over the sorted votes."""
        t, found = self.templates[k], set()
        low, seen = 0, Counter()
        last = None
        for start, offset in votes:
            seen[offset] += 1
            while votes[low][0] < start - DRIFT:
                seen[votes[low][1]] -= 1
                if not seen[votes[low][1]]:
                    del seen[votes[low][1]]
                low += 1
            first = votes[low][0]
            if len(seen) >= self.need[k] and first != last and self._stand(t, first, start, words):
                last = first
                window = set(words[max(0, first) : start + len(t.words) + DRIFT])
                found.add((k, max(0, first), round(sum(w in window for w in t.words) / len(t.words), 6)))
        return found

    @staticmethod
    def _stand(t: Template, first: int, last: int, words: list[bytes]) -> bool:
        for offset, key in t.keys:
            n = len(key)
            near = range(max(0, first + offset - DRIFT), last + offset + DRIFT + 1)
            if not any(tuple(words[i : i + n]) == key for i in near):
                return False
        return True


def scan(text: str | None, index: Index) -> dict:
    """n_words, matches (label, start, score, is_base) and the digest columns of one text."""
    n_words, found, known = 0, set(), index.templates
    for first, words, new in portions(text, index.overlap):
        n_words += new
        found |= {(k, first + start, score) for k, start, score in index.matches(words)}
    base = [(start, known[k].label) for k, start, _ in found if known[k].is_base]
    return {
        "n_words": n_words,
        "n_base": len(base),
        "first_word": min((s for s, _ in base), default=None),
        "last_word": max((s for s, _ in base), default=None),
        "base_labels": ",".join(sorted({x for _, x in base})),
        "labels": ",".join(sorted({known[k].label for k, _, _ in found})),
        "score": max((score if not known[k].is_phrase else MENTION for k, _, score in found), default=0.0),
    }


_FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
]


def count_words(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> Index:
    """The index, with document frequencies of the templates' words over every row of docs."""
    vocabulary = frozenset(w for t in templates for w in t.words)

    def run(batches):
        n, seen = 0, Counter()
        for b in text_slices(batches):
            for t in b.column("text").to_pylist():
                n += 1
                own: set[bytes] = set()
                for _, words, _ in portions(t):
                    own |= vocabulary.intersection(words)
                seen.update(own)
        yield pa.RecordBatch.from_pydict({"word": [None, *(w.decode() for w in seen)], "n": [n, *seen.values()]})

    sums = map_batches(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in sums}  # at most one row for each word of the templates
    return Index({w.encode(): n for w, n in counts.items() if w is not None}, counts.get(None, 0), templates)


def find_licenses(docs: DataFrame, index: Index | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """doc_id and what scan() gives for each row of docs. more: further licence texts by label."""
    given = tuple(template_of(label, text) for label, text in (more or {}).items() if len(words_of(text)) >= 5)
    index = index or count_words(docs, TEMPLATES + given)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in text_slices(batches):
            rows = [scan(t, index) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([r[name] for r in rows], t) for name, t in _FIELDS)],
                ["doc_id", *(name for name, _ in _FIELDS)],
            )

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_batches(docs.select("doc_id", "text"), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return find_licenses(table(spark, sf_dir, "documents"))
