"""Personal data in texts, plain and disguised: rewriting transducers that keep the offsets, detectors, spans mapped back."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import rows_of

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Those of e-mail parts run outward from an "@", so no text makes them try twice.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]\.[0-9]")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # first code point, number in KINDS, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > end and text[first - 1] in LOCAL:
            first -= 1
        found = DOMAIN.match(text, at + 1) if first < at else None
        if found:
            end = found.end()
            yield first, end
        else:
            end = at + 1  # a local part has no "@"
        at = text.find("@", end)


def ips(text: str) -> Iterator[tuple[int, int]]:
    start = DOTTED.search(text)
    for m in IP.finditer(text) if start else ():
        parts = [p.lstrip("0") for p in m.groups()]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    values = [ord(d) - 48 for d in reversed(digits)]
    return (sum(values[::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[ -]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" not in text:
        return
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


DETECTORS: tuple[Callable[[str], Iterator[tuple[int, int]]], ...] = (emails, ips, cards, phones)


def detect(text: str) -> list[Span]:
    """Spans of all kinds, by start and then kind."""
    return sorted((a, kind, b) for kind, find in enumerate(DETECTORS) for a, b in find(text))


class Rewriting:
    """A text after some replacements, with the way back: every output position belongs to a piece of the source."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        """``edits``: (first, end, replacement), ascending, not overlapping."""
        self.out: list[int] = []  # where replacements begin in the output
        self.edits = edits
        pieces, at, size = [], 0, 0
        for first, end, new in edits:
            pieces += [source[at:first], new]
            size += first - at
            self.out.append(size)
            size += len(new)
            at = end
        pieces.append(source[at:])
        self.text = "".join(pieces)

    def source_span(self, first: int, end: int) -> tuple[int, int, bool]:
        """The source characters that gave the output characters first..end-1, and whether any was replaced."""
        k = bisect_left(self.out, first)
        while k < len(self.out) and self.out[k] == first and not self.edits[k][2]:
            k += 1  # what was taken out there stands before the character
        return self._source(first)[0], self._source(end - 1)[1], k < len(self.out) and self.out[k] < end

    def _source(self, at: int) -> tuple[int, int]:
        """First and end of the source of one output character."""
        k = bisect_right(self.out, at) - 1
        if k < 0:
            return at, at + 1
        first, end, new = self.edits[k]
        beyond = at - self.out[k] - len(new)
        return (first, end) if beyond < 0 else (end + beyond, end + beyond + 1)


# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ο": "o", "ν": "v", "ρ": "p",
    "ι": "i", "κ": "k", "υ": "u", "ı": "i", "ɡ": "g", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-",
    "—": "-", "−": "-",
}
# Characters that show nothing.
UNSEEN = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
# Digits in words (English, German, French, Spanish), signs in words, ends of host names after bare words.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
    "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9", "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8",
    "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
ARTICLES = "the|a|an|this|that|our|my|your|his|her|their|le|la|les|un|une|el|los|las|der|die|das"
HOST_ENDS = "com|org|net|edu|gov|info|biz|io|co|uk|us|eu|de|fr|es|it|nl|ch|at|be|pt|mx|ar|ca|au|example|test"


@lru_cache(maxsize=None)
def folded(char: str) -> str | None:
    """The ASCII character that ``char`` looks like, "" if it shows nothing, None if it stays."""
    if char < "\x80":
        return None
    if char in UNSEEN:
        return ""
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    digit = unicodedata.decimal(char, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and " " <= plain <= "~" else None


def unify(text: str) -> list[tuple[int, int, str]]:
    """Look-alike, wide and styled characters become ASCII; unseen ones go."""
    if text.isascii():
        return []
    known = {c: folded(c) for c in set(text)}
    wanted = "".join(c for c, new in known.items() if new is not None)
    if not wanted:
        return []
    return [(m.start(), m.end(), known[m[0]]) for m in re.finditer(f"[{re.escape(wanted)}]", text)]


_GAP = "[ \t]{0,3}"
_AT_WORD, _DOT_WORD = "at|arroba|chez", "dot|punto|punkt|point"
_LABEL = "[A-Za-z0-9-]{1,63}"
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DIGIT_WORD = re.compile(f"(?:{_WORDS})(?![^\\W\\d_])", re.IGNORECASE)
_BETWEEN = (" ", "  ", "-", " - ", ",", ", ")
_DIGIT_BEFORE = re.compile(f"(?:[0-9][ -]?| (?:{_DOT_WORD}) )\\Z", re.IGNORECASE)
_DIGIT_BEHIND = re.compile(f"[ -]?[0-9]| (?:{_DOT_WORD}) ", re.IGNORECASE)
_MARKS = "-,.;:+()[]{}<>/\"'"


def spelled(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits become digits beside another digit, spelled or not, and beside a spelled dot.

    What stands between two of them goes.
    """
    low = text.lower()
    for mark in _MARKS:
        low = low.replace(mark, " ")
    if DIGIT_WORDS.keys().isdisjoint(low.split()):
        return []
    found = [m for m in _DIGIT_WORD.finditer(text) if m.start() == 0 or not text[m.start() - 1].isalnum()]
    edits: list[tuple[int, int, str]] = []
    for k, m in enumerate(found):
        first, end = m.span()
        following = found[k + 1].start() if k + 1 < len(found) else len(text) + 9
        joins = following - end <= 3 and text[end:following] in _BETWEEN
        joined = bool(edits) and edits[-1][1] == first
        if joins or joined or _DIGIT_BEFORE.search(text[max(0, first - 7) : first]) or _DIGIT_BEHIND.match(text, end):
            edits.append((first, following if joins else end, DIGIT_WORDS[m[0].lower()]))
    return edits


_DISGUISE = re.compile(
    # In brackets, and as character references.
    f"(?P<at>{_GAP}[\\[({{<]{_GAP}(?:{_AT_WORD}|@){_GAP}[\\])}}>]{_GAP}|&#0{{0,4}}64;|&#x0{{0,4}}40;|&commat;"
    # In bare words: a name, "at", a host whose first dot at least is a word.
    f"|(?<=[A-Za-z0-9]) (?:{_AT_WORD}) (?=(?!(?:{ARTICLES}) ){_LABEL} (?:{_DOT_WORD}) [A-Za-z0-9]))"
    f"|(?P<dot>{_GAP}[\\[({{<]{_GAP}(?:{_DOT_WORD}|\\.){_GAP}[\\])}}>]{_GAP}|&#0{{0,4}}46;|&#x0{{0,4}}2e;|&period;"
    f"|(?<=[A-Za-z0-9]) (?:{_DOT_WORD}) (?=(?:{HOST_ENDS})\\b|[0-9]|{_LABEL} (?:{_AT_WORD}|{_DOT_WORD}) ))"
    f"|(?P<plus>\\bplus[ -]?(?=[0-9(]))",
    re.IGNORECASE,
)
# What each disguise holds in lower case; the last pattern is that of brackets.
_CUES = (*(f" {w} " for w in _DOT_WORD.split("|")), "plus", "&#", "&commat;", "&period;")
_BRACKETED = re.compile(f"[\\[({{<]{_GAP}(?:{_AT_WORD}|@|{_DOT_WORD}|\\.){_GAP}[\\])}}>]")


def undisguised(text: str) -> list[tuple[int, int, str]]:
    """Disguised "@" and "." in brackets, references or words, and "plus" before a digit."""
    low = text.lower()
    if not any(cue in low for cue in _CUES) and not _BRACKETED.search(low):
        return []
    return [(m.start(), m.end(), {"at": "@", "dot": ".", "plus": "+"}[m.lastgroup]) for m in _DISGUISE.finditer(text)]


TRANSDUCERS: tuple[Callable[[str], list[tuple[int, int, str]]], ...] = (unify, spelled, undisguised)


def disguised(text: str) -> list[Span]:
    """Spans of ``text`` that hold an identifier only after rewriting."""
    chain: list[Rewriting] = []
    now = text
    for transducer in TRANSDUCERS:
        edits = transducer(now)
        if edits:
            chain.append(Rewriting(now, edits))
            now = chain[-1].text
    found = set()
    for first, kind, end in detect(now) if chain else ():
        touched = False
        for step in reversed(chain):
            first, end, changed = step.source_span(first, end)
            touched |= changed
        if touched:
            found.add((first, kind, end))
    return sorted(found)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans of a text, and all spans: those of disguised identifiers that no base span holds are added."""
    base = detect(text)
    firsts = [a for a, _, _ in base]
    furthest = list(accumulate((b for _, _, b in base), max))

    def held(a: int, b: int) -> bool:
        before = bisect_right(firsts, a)
        return before > 0 and furthest[before - 1] >= b

    return base, sorted([*base, *((a, k, b) for a, k, b in disguised(text) if not held(a, b))])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{first}:{end}" for first, kind, end in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``, ``n_disguised``) per row.

    The counts and the digest are those of the plain spans; ``spans`` has those of disguised identifiers too, in code
    points of the text as it came. Missing and empty texts have none. Texts are read whole, at any length, in time that
    grows with it. Repeated rows give repeated rows; rows without an id take part; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for doc, text in rows_of([batch]):
                base, spans = find(text)
                counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                made.append((doc, *counts, digest, joined(spans), len(spans) - len(base)))
            columns = zip(*made, strict=True) if made else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"]
    schema = ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return picked.mapInArrow(run, schema)
