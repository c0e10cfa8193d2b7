"""Quality rules from tokeniser fertility.

A text that a public vocabulary spells in very short pieces, in bytes, or in few different pieces is
rarely prose. Every word is measured by itself (no merge of these vocabularies crosses white space),
so a word is tokenised once and its pieces are reused wherever it stands.

Measures of a text:
  chars_per_token  code points in words / tokens of the byte-level vocabulary
  fallback_share   bytes that the piece vocabulary can spell only as byte pieces / bytes in words
  token_entropy    Shannon entropy, in bits, of the byte-level tokens

Null text: no words, base_failed, not kept. Empty table: no rows. Repeated rows: a row each.
Columns beyond key and text are ignored, whatever their names. Nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .common import decode, has_columns, kept, map_text

#: Bands by language code, then by script: least and most chars_per_token, most
#: fallback_share, least token_entropy. "*" holds for what is not listed. The least values of en, de, fr and es are
#: fitted on a bounded sample: the texts of sf0.1 that have a label and pass the base rules, of those with an even
#: crc32 of the decimal id (1 782). They reject the most texts of quality 0 that a grid (steps of 0.01 and 0.1) can with
#: at most 3 % of those of quality 1 in the language. In fr and es chars_per_token does not separate and stays wide;
#: so do the other bounds and scripts, for which there are no labels.
BANDS = {
    "en": (2.11, 9.0, 0.05, 5.8),
    "de": (1.95, 9.0, 0.05, 5.9),
    "fr": (1.05, 9.0, 0.05, 5.9),
    "es": (1.05, 9.0, 0.05, 5.9),
    "latin": (1.0, 9.0, 0.10, 2.5),
    "greek": (0.4, 6.0, 0.30, 2.5),
    "cyrillic": (0.4, 6.0, 0.30, 2.5),
    "semitic": (0.35, 6.0, 0.60, 2.5),
    "indic": (0.25, 6.0, 1.00, 2.5),
    "cjk": (0.25, 6.0, 1.00, 2.5),
    "hangul": (0.25, 6.0, 1.00, 2.5),
    "*": (0.2, 9.0, 1.00, 2.5),
}

#: Last code point of a range, and the script counted for it.
SCRIPTS = [
    (0x24F, "latin"),
    (0x36F, "*"),
    (0x3FF, "greek"),
    (0x52F, "cyrillic"),
    (0x58F, "*"),
    (0x8FF, "semitic"),
    (0xDFF, "indic"),
    (0x1DFF, "*"),
    (0x1EFF, "latin"),
    (0x1FFF, "greek"),
    (0x2E7F, "*"),
    (0x9FFF, "cjk"),
    (0xABFF, "*"),
    (0xD7FF, "hangul"),
    (0x10FFFF, "*"),
]

SYMBOLS = b"#*$%&|<>"

#: Words whose pieces a worker keeps; a full cache starts anew.
CACHE_WORDS = 120_000

OUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, "
    "fallback_share double, token_entropy double, script string, base_failed boolean, kept boolean"
)

class Measure(dict):
    """word -> its byte-level token ids as little-endian int32, filled on demand."""

    def __init__(self, ranks_path: str, pieces_path: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        super().__init__()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.fallback: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = np.array(self.encode(" " + decode(word)), "<i4").tobytes()
        return out

    def fallback_bytes(self, word: bytes) -> int:
        n = self.fallback.get(word)
        if n is None:
            if len(self.fallback) >= CACHE_WORDS:
                self.fallback.clear()
            n = self.fallback[word] = sum(map(self.pieces.is_byte, self.pieces.encode(decode(word))))
        return n


def measure(ranks_path: str, pieces_path: str) -> Measure:
    return kept("fertility", (ranks_path, pieces_path), lambda: Measure(ranks_path, pieces_path))


def repeat_words(words: list) -> int:
    """Words that stand in a window of three words found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered, end = 0, 0  # end: first position that is not counted yet
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def dup_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def main_script(text: str) -> str:
    """The script of most letters; latin for a text without any."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    points = points[(points > 0x40) & ((points > 0x7F) | ((points | 0x20) >= 0x61) & ((points | 0x20) <= 0x7A))]
    if not len(points):
        return "latin"
    counts = np.bincount(np.searchsorted([x for x, _ in SCRIPTS], points), minlength=len(SCRIPTS))
    by: dict[str, int] = {}
    for (_, name), n in zip(SCRIPTS, counts, strict=True):
        by[name] = by.get(name, 0) + int(n)
    return max(by, key=lambda k: (by[k], k != "*", k))


def entropy(tokens: np.ndarray) -> float:
    if not len(tokens):
        return 0.0
    t = np.sort(tokens)
    ends = np.flatnonzero(np.append(t[1:] != t[:-1], True))
    p = np.diff(ends, prepend=-1) / len(t)
    return float(-(p * np.log2(p)).sum()) + 0.0


def scorer(ranks_path: str, pieces_path: str, bands: dict) -> Callable[[bytes, str | None], tuple]:
    def score(raw: bytes, lang: str | None) -> tuple:
        m = measure(ranks_path, pieces_path)
        words = raw.split()
        text = decode(raw)
        n = len(words)
        packed = b"".join(words)
        word_chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
        n_symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
        repeats = repeat_words(words)
        tokens = np.frombuffer(b"".join(map(m.__getitem__, words)), "<i4")
        fallback = 0 if packed.isascii() else sum(m.fallback_bytes(w) for w in words if not w.isascii())
        fallback /= max(1, len(packed))
        per_token, bits, script = word_chars / max(1, len(tokens)), entropy(tokens), main_script(text)
        low, high, most, least = bands.get(lang or "", bands.get(script, bands["*"])) if script == "latin" else bands.get(script, bands["*"])
        base_failed = n < 50 or 100 * repeats > 50 * n
        kept = not base_failed and low <= per_token <= high and fallback <= most and bits >= least
        return n, word_chars, n_symbols, dup_lines(raw), repeats, per_token, fallback, bits, script, base_failed, kept

    return score


def quality(docs: DataFrame, keys: list[str], text: str = "text", lang: str | None = "lang", ranks_path: str = "", pieces_path: str = "", bands: dict | None = None) -> DataFrame:
    """keys, base counts, the three measures, script, base_failed and kept, a row for each row of docs.

    A row is kept if it passes the base rules and each measure lies in the band of its language (texts
    in Latin script) or of its main script."""
    import public_tokenizers as P

    has_columns(docs, *keys, text)
    score = scorer(ranks_path or P.path("byte_bpe_50k.tiktoken"), pieces_path or P.path("piece_bpe_32k.model"), BANDS | (bands or {}))
    if lang is None or lang not in docs.columns:
        return map_text(docs, keys, text, OUT, lambda raw: score(raw, None))
    # the language travels in front of the text, so that one column carries both
    from pyspark.sql import functions as F

    both = docs.withColumn("_both", F.concat(F.coalesce(F.regexp_replace(F.col(lang).cast("string"), "\n", ""), F.lit("")), F.lit("\n"), F.coalesce(F.col(text).cast("string"), F.lit(""))))

    def each(raw: bytes) -> tuple:
        code, _, body = raw.partition(b"\n")
        return score(body, decode(code))

    return map_text(both, keys, "_both", OUT, each)
