r"""License scans: fuzzy search of short notices.

Words are runs of [0-9a-z] and bytes over 0x7F after lower-casing A-Z; a text is its words joined by one space. A
notice of m characters may differ in up to k = m // PER_ERROR characters: cut into k + 1 pieces, it keeps one of them
whole (pigeonhole). All pieces of all notices are found in one pass of an Aho-Corasick automaton; around each find the
regex library matches the notice with at most k edits, best match first, and its span is reported. Short phrases
(k = 0) are their own seed and must stand between word ends.

Every find of a seed is checked; nothing is capped. Words are found by bisection, so a long text of many finds takes time
in proportion to it. Null text: no words. Every row yields a row; empty tables none;
other columns are ignored. Nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import regex
from pyspark.sql import DataFrame

from .common import has_columns, map_text

PER_ERROR = 12

#: Exact phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("the software is provided as is without warranty of any kind", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under the mit license", "mit"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("dedicated to the public domain", "public-domain"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("eclipse public license", "epl"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

_OTHER = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_TO_SPACE = bytes.maketrans(_OTHER, b" " * len(_OTHER))


class Notices:
    def __init__(self, notices: tuple = NOTICES, base: tuple = BASE):
        self.notices, self.base = [(p, label, len(p) // PER_ERROR) for p, label in notices], base
        self.fuzzy = [regex.compile(f"(?b)(?:{regex.escape(p)}){{e<={k}}}") for p, _, k in self.notices]
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (p, _, k) in enumerate(self.notices):
            for a, b in pieces(len(p), k):
                at.setdefault(p[a:b], []).append((i, a))
        for seed, where in at.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors), in characters of the normalised text."""
        windows: dict[tuple[int, int], None] = {}
        for last, (n, where) in self.seeds.iter(text):
            for i, a in where:
                windows[i, last + 1 - n - a] = None
        found: dict[tuple[int, int, int], int] = {}
        for i, begin in windows:
            phrase, _, k = self.notices[i]
            lo, hi = max(0, begin - k), min(len(text), begin + len(phrase) + k)
            if k == 0:
                if text[begin - 1 : begin] in ("", " ") and text[hi : hi + 1] in ("", " ") and text[begin:hi] == phrase and begin >= 0:
                    found[i, begin, hi] = 0
            elif m := self.fuzzy[i].search(text, lo, hi):
                found[(i, *m.span())] = sum(m.fuzzy_counts)
        return sorted((i, s, e, n) for (i, s, e), n in found.items())


def pieces(size: int, errors: int) -> list[tuple[int, int]]:
    """errors + 1 neighbouring pieces of nearly equal length."""
    n = errors + 1
    return [(size * j // n, size * (j + 1) // n) for j in range(n)]


_default: list[Notices] = []


def notices() -> Notices:
    if not _default:
        _default.append(Notices())
    return _default[0]


def normal(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_TO_SPACE).split()


def scan(raw: bytes) -> tuple:
    """n_words, base places [(label, first word, last word)], hits [(label, first word, last word, errors, score)]."""
    found = notices()
    words = normal(raw)
    text = b" ".join(words).decode("latin-1")  # a character for each byte
    padded = f" {text} "
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))  # of each word; one more for what follows the last

    def word_at(place: int) -> int:
        return max(0, min(len(words), bisect_right(starts, place)) - 1)

    base = []
    for phrase, label in found.base:
        p = padded.find(f" {phrase} ")
        while p >= 0:
            first = word_at(p)
            base.append({"label": label, "first": first, "last": first + phrase.count(" ")})
            p = padded.find(f" {phrase} ", p + 1)
    hits = []
    for i, s, e, n in found.hits(text):
        phrase, label, _ = found.notices[i]
        first = word_at(s + (text[s] == " "))
        hits.append({"label": label, "first": first, "last": max(first, word_at(e - 1 - (text[e - 1] == " "))), "errors": n, "score": 1.0 - n / len(phrase)})
    return len(words), base, hits


OUT = "n_words long, base array<struct<label:string,first:long,last:long>>, hits array<struct<label:string,first:long,last:long,errors:long,score:double>>"


def licenses(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n_words, base (exact phrases) and hits (notices with their edits), places counted in words from 0."""
    has_columns(docs, *keys, text)
    return map_text(docs, keys, text, OUT, scan)
