r"""Personal data: patterns propose, checksums confirm, words nearby adjust the score.

Each kind has a pattern, a check of the match and a start score; a kind whose start score is under the
threshold needs one of its context words within WINDOW code points before the match, or begun within AFTER code points
after it, which adds BOOST. Patterns start once for each run of their characters, so that a text of any length takes
time in proportion to it.
Base kinds (email, ip, card, phone) start above the threshold: context only raises their score.

Offsets are code points, ends exclusive. Null text: no spans. Matches of one kind never overlap (leftmost
first); spans of different kinds may. Every row yields a row; empty tables yield none; columns beyond key and
text are ignored. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import column, decode, has_columns, map_text

WINDOW, AFTER, BOOST, THRESHOLD = 40, 16, 0.4, 0.5


def luhn(digits: str) -> bool:
    """Mod-10 checksum of payment cards."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod 97-10 check of an IBAN."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def only_digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def is_card(s: str) -> bool:
    d = only_digits(s)
    return 14 <= len(d) <= 19 and luhn(d)


def is_phone(s: str) -> bool:
    return 10 <= len(only_digits(s)) <= 15


def is_iban(s: str) -> bool:
    packed = s.replace(" ", "")
    return 15 <= len(packed) <= 34 and mod97(packed)


def is_ssn(s: str) -> bool:
    a, b, c = s.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


def is_key(s: str) -> bool:
    return len(set(s)) >= 10 and any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    check: Callable[[str], bool]
    score: float
    context: tuple[str, ...]
    needs: str = ""  #: a text without this character holds no match; "0": without a digit


#: The kinds in the order of their listing.
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True, 0.6, ("mail", "contact", "write"), "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)", is_ip, 0.6, ("ip", "host", "server", "address"), "."),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", is_card, 0.6, ("card", "visa", "credit", "pay"), "0"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", is_phone, 0.6, ("phone", "call", "tel", "mobile"), "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", is_iban, 0.6, ("iban", "bank", "account", "konto"), "0"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", is_ssn, 0.3, ("ssn", "social", "security", "taxpayer"), "-"),
    Kind("secret", r"(?<![A-Za-z0-9_/+-])(?:AKIA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk[-_][A-Za-z0-9_-]{20,}|[A-Za-z0-9_/+-]{24,64})(?![A-Za-z0-9_/+-])", is_key, 0.2, ("key", "token", "secret", "password", "passwd", "api"), "0"),
)
BASE = ("email", "ip", "card", "phone")
KNOWN_KEY = re.compile(r"AKIA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk[-_][A-Za-z0-9_-]{20,}")
DIGIT = re.compile(r"[0-9]")
_compiled = {k.name: re.compile(k.pattern) for k in KINDS}
_context = {k.name: re.compile(r"(?<![A-Za-z])(?:" + "|".join(k.context) + ")", re.IGNORECASE) for k in KINDS}
#: An email starts at a run of its local characters, so scanning goes from "@" to "@" instead of from word to word.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, in time linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _compiled["email"].match(text, at - 1)):
            end = m.end()
            out.append((start, end))
            done = end
        at = text.find("@", end)
    return out


def find_spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of everything at or over the threshold, by start, then kind."""
    found, digits = [], DIGIT.search(text) is not None
    for order, kind in enumerate(KINDS):
        if kind.needs == "@":
            if "@" not in text:
                continue
            spans = emails(text)
        elif not digits or kind.needs != "0" and kind.needs not in text:
            continue
        else:
            spans = [m.span() for m in _compiled[kind.name].finditer(text) if kind.check(m[0])]
        for start, end in spans:
            near = _context[kind.name].search(text, max(0, start - WINDOW), start) or _context[kind.name].search(text, end, end + AFTER)
            score = kind.score + BOOST * bool(near)
            if kind.name == "secret" and KNOWN_KEY.fullmatch(text, start, end):
                score = max(score, 0.9)
            if score >= THRESHOLD:
                found.append((start, order, end, kind.name, min(1.0, score)))
    return [(s, e, k, p) for s, _, e, k, p in sorted(found)]


def scan(raw: bytes) -> tuple:
    spans = find_spans(decode(raw))
    return ([{"kind": k, "start": s, "end": e, "score": p} for s, e, k, p in spans],)


def detect(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and spans array<struct<kind,start,end,score>>, a row for each row of docs."""
    has_columns(docs, *keys, text)
    return map_text(docs, keys, text, "spans array<struct<kind:string,start:long,end:long,score:double>>", scan)


def masked(raw: bytes) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    text = decode(raw)
    out, done = [], 0
    for start, end, kind, _ in find_spans(text):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with its texts masked; null texts stay null, columns and rows stay as they are."""
    from pyspark.sql import functions as F

    has_columns(docs, text)
    names = docs.columns
    others = [n for n in names if n != text]
    safe = docs.select(*(column(n).alias(f"c{i}") for i, n in enumerate(others)), column(text).isNull().alias("none"), column(text).alias("body"))
    made = map_text(safe, [*(f"c{i}" for i in range(len(others))), "none"], "body", "clean string", lambda raw: (masked(raw),))
    back = {n: F.col(f"c{i}") for i, n in enumerate(others)} | {text: F.when(~F.col("none"), F.col("clean"))}
    return made.select(*(back[n].alias(n) for n in names))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def digest(raw: bytes) -> tuple:
    """The contract's columns for one text."""
    spans = [(s, e, k) for s, e, k, _ in find_spans(decode(raw))]
    base = [x for x in spans if x[2] in BASE]
    counts = [sum(x[2] == k for x in base) for k in BASE]
    return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)
