"""License scans: fuzzy search for short notices.

A notice may be found with some edits. By the pigeonhole principle, of ``edits + 1`` pieces of the
notice at least one occurs unchanged in every such place, so an Aho-Corasick automaton of all pieces
finds every candidate in one pass; bounded-error matching of the ``regex`` library then verifies the
window around a candidate and reports the span and the number of edits.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.llm.common import map_batches, utf8

#: Phrases whose words must stand consecutively and unchanged, and their labels (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices that may differ by one edit in EDIT_EVERY characters, and their labels (fixed values).
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("eclipse public license version", "epl"),
    ("boost software license version 1 0", "bsl"),
    ("licensed under a creative commons attribution", "cc"),
)
EDIT_EVERY = 16
MAX_EDITS = 5

_KEEP = [b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)]
_FOLD = bytes(_KEEP)


def words_of(data: bytes | None) -> list[bytes]:
    """Runs of digits, lower-cased ASCII letters and characters beyond ASCII."""
    return (data or b"").translate(_FOLD).split()


@dataclass(frozen=True)
class Hit:
    label: str
    first_word: int
    last_word: int
    edits: int
    score: float
    base: bool


@dataclass(frozen=True)
class Pattern:
    text: str
    label: str
    edits: int
    base: bool

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): edits + 1 pieces that make up the pattern."""
        n, k = len(self.text), self.edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def patterns(base: Iterable[tuple[str, str]] = BASE, notices: Iterable[tuple[str, str]] = NOTICES) -> list[Pattern]:
    """Base phrases and notices, each with a space before and behind it so that whole words are met."""
    exact = [Pattern(f" {p} ", label, 0, True) for p, label in base]
    return exact + [Pattern(f" {p} ", label, min(MAX_EDITS, len(p) // EDIT_EVERY), False) for p, label in notices]


class Scanner:
    """Finds the places of patterns in texts; spaces stand between words and at both ends."""

    def __init__(self, of: list[Pattern]):
        self.patterns = of
        self.verify = [regex.compile(f"(?b)(?:{regex.escape(p.text, special_only=True)}){{e<={p.edits}}}") for p in of]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, p in enumerate(of):
            for offset, piece in p.pieces():
                seeds.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, int, int]]:
        """(pattern, start, end, edits) in ``text``; of overlapping fuzzy places the one of least edits."""
        exact: list[tuple[int, int, int, int]] = []
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for k, offset in places:
                p = self.patterns[k]
                start = end + 1 - length - offset
                if p.edits == 0:
                    if self.verify[k].fullmatch(text, start, start + len(p.text)):
                        exact.append((k, start, start + len(p.text), 0))
                    continue
                a, b = max(0, start - p.edits), min(len(text), start + len(p.text) + p.edits)
                windows.setdefault(k, []).append([a, b])
        for k, own in windows.items():
            merged: list[list[int]] = []
            for a, b in sorted(own):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            # A search gives the best place of a stretch; others may stand on both sides of it.
            while merged:
                a, b = merged.pop()
                if m := self.verify[k].search(text, a, b):
                    exact.append((k, m.start(), m.end(), sum(m.fuzzy_counts)))
                    merged += [[a, m.start() + 1], [max(m.end() - 1, m.start() + 1), b]]
        return sorted(exact, key=lambda x: (x[1], x[0]))

    def hits(self, data: bytes | None) -> tuple[int, list[Hit]]:
        """The number of words, and all places by their first word."""
        words = words_of(data)
        text = f" {b' '.join(words).decode('utf-8', 'replace')} "
        out, at, word = [], 0, 0
        for k, a, b, edits in self.scan(text):
            p = self.patterns[k]
            # The word at a place is the number of spaces up to and with it, less the leading one.
            word += text.count(" ", at, a + 1)
            at = a + 1
            inner = text[a:b].strip(" ")
            first = max(0, word - 1 + (0 if text[a] == " " else 0))
            out.append(Hit(p.label, first, first + inner.count(" "), edits, 1 - edits / max(1, len(p.text) - 2), p.base))
        return len(words), out


def scan(docs: DataFrame, of: list[Pattern] | None = None) -> DataFrame:
    """(doc_id, n_words, hits): one row per row of ``docs``; hits are the places of all patterns.

    Each hit has label, first_word, last_word, edits, score and base. Null and empty texts have no word
    and no hit; repeated rows are scanned alike; a null id is passed on; a text of any length is scanned
    whole; an empty table gives an empty result; further columns are not read.
    """
    of = patterns() if of is None else of
    kind = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])

    def run(batches):
        scanner = Scanner(of)
        for batch in batches:
            found = [scanner.hits(t) for t in batch.column(1).to_pylist()]
            rows = [[vars(h) for h in hits] for _, hits in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(rows, pa.list_(kind))], ["doc_id", "n_words", "hits"])

    schema = "doc_id long, n_words long, hits array<struct<label:string,first_word:long,last_word:long,edits:long,score:double,base:boolean>>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), utf8("text")), run, schema)


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of ``scan``'s rows.

    ``first_word`` and ``last_word`` are the least and greatest start of a base place, null without one;
    labels are distinct, sorted and joined by commas; ``score`` is the best hit's, 0 without one.
    """
    base = F.filter("hits", lambda h: h["base"])
    starts = F.transform(base, lambda h: h["first_word"])
    names = lambda hits: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("score"),
    )
