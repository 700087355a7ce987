"""License scan: fuzzy search of short notices.

A notice of ``m`` characters may differ by ``k`` edits. Cut into ``k + 1`` parts,
at least one part stands in the text unchanged (pigeonhole), so an automaton over
all parts gives all candidate places. The bounded-error matching of the ``regex``
library then verifies each candidate window and gives the span and the edits.

Texts are lower-cased (A-Z) and reduced to words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
joined by one blank; places are word indices from 0. A null text counts as
empty. Whole texts are searched; overlapping places all count. Extra columns are
ignored and repeated rows each give their row.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_bytes, in_text_chunks, map_arrow

#: Phrases whose words must stand consecutively, and their labels (fixed values).
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Short notices, their labels and the edits allowed in each.
NOTICES = {
    "this work is licensed under the gnu general public license": ("gpl", 5),
    "gnu general public license": ("gpl", 2),
    "gnu lesser general public license": ("lgpl", 2),
    "gnu affero general public license": ("agpl", 2),
    "licensed under the apache license version 2 0": ("apache-2.0", 4),
    "released under the mit license": ("mit", 2),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 6),
    "redistribution and use in source and binary forms with or without modification": ("bsd", 6),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 6),
    "subject to the terms of the mozilla public license": ("mpl-2.0", 4),
    "this is free and unencumbered software released into the public domain": ("unlicense", 6),
    "licensed under cc by nc 4 0": ("cc-by-nc", 1),
    "licensed under cc by sa 4 0": ("cc-by-sa", 1),
    "creative commons attribution": ("cc-by", 2),
    "all rights reserved": ("reserved", 1),
}

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Scanner:
    def __init__(self, notices: dict[str, tuple[str, int]]):
        import ahocorasick
        import regex

        self.automaton, seeds = ahocorasick.Automaton(), {}
        self.notices = []
        for number, (notice, (label, edits)) in enumerate(notices.items()):
            raw = notice.encode().decode("latin-1")
            self.notices.append((raw, label, edits, regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(raw)}){{e<={edits}}}(?![^ ])")))
            size, at = len(raw), 0
            for k in range(edits + 1):
                end = size * (k + 1) // (edits + 1)
                seeds.setdefault(raw[at:end], []).append((number, at))
                at = end
        for seed, where in seeds.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()

    def find(self, line: str) -> list[tuple[str, int, int, int]]:
        """``(label, start, end, edits)`` in ``line`` for each notice found, in characters."""
        windows: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(line):
            for number, offset in where:
                raw, _, edits, _ = self.notices[number]
                start = last - size + 1 - offset
                low, high = max(0, start - edits), line.find(" ", min(len(line), start + len(raw) + edits))  # to the word's end
                high = len(line) if high < 0 else high
                spans = windows.setdefault(number, [])
                if spans and low <= spans[-1][1] and low >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
        out = []
        for number, spans in windows.items():
            _, label, edits, pattern = self.notices[number]
            seen = set()
            for low, high in spans:
                for m in pattern.finditer(line, low, high, overlapped=True):
                    if m.span() not in seen:
                        seen.add(m.span())
                        out.append((label, *m.span(), sum(m.fuzzy_counts)))
        return sorted(out, key=lambda x: x[1:])


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner(NOTICES)


def word_starts(words: list[bytes]) -> list[int]:
    """Where each word starts when they are joined by one blank."""
    starts, at = [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    return starts


def base_places(line: bytes, starts: list[int]) -> list[tuple[int, str]]:
    """Word index and label of every place of a base phrase in blank-joined words that begin at ``starts``."""
    padded, found = b" " + line + b" ", []
    for phrase, label in BASE.items():
        needle = b" " + phrase.encode() + b" "
        at = padded.find(needle)
        while at >= 0:
            found.append((bisect_left(starts, at), label))
            at = padded.find(needle, at + 1)
    return sorted(found)


SCHEMA = "doc_id long, n_words long, base array<struct<word:long,label:string>>, notices array<struct<label:string,first_word:long,last_word:long,edits:long,similarity:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, base, notices``: the places of base phrases, and notices with word span and edits."""

    def make():
        scanner = _scanner()

        def run(batches):
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("similarity", pa.float64())]))]
            for ids, texts in in_text_chunks(batches):
                counts, bases, notices = [], [], []
                for text in texts:
                    words = words_of(text)
                    line = b" ".join(words)
                    counts.append(len(words))
                    starts = word_starts(words)
                    bases.append([{"word": w, "label": x} for w, x in base_places(line, starts)])
                    found = []
                    line = line.decode("latin-1")
                    for label, start, end, edits in scanner.find(line):
                        first = bisect_right(starts, start + (line[start] == " ")) - 1
                        last = bisect_right(starts, end - 1 - (line[end - 1] == " ")) - 1
                        found.append({"label": label, "first_word": first, "last_word": last, "edits": edits, "similarity": 1 - edits / max(1, end - start)})
                    notices.append(found)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, counts, bases, notices), kinds, strict=True)], ["doc_id", "n_words", "base", "notices"])

        return run

    return map_arrow(doc_bytes(docs), make, SCHEMA)
