"""Personal data: base patterns on the text as it is, and disguised identifiers found in a normalised text whose
spans are mapped back to the source characters."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_base long"

Span = tuple[int, int, int, str]  # start, place in KINDS, end, kind

_EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match can begin inside a run of digits whose first digit begins none: that is what the look-behind says.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the @ signs: the local part is the run before the sign, after the last match."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _EMAIL_LOCAL.match(text, start - 1):
            start -= 1
        m = _EMAIL_DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        # A character before this sign never helps a later one: no local part holds an @.
        done = max(done, at + 1)
        at = text.find("@", done)


def identifiers(text: str) -> Iterator[Span]:
    if "@" in text:
        for a, b in emails(text):
            yield a, 0, b, "email"
    if not _DIGITS.search(text):
        return
    for m in _IP.finditer(text):
        # Compared as digits: a part may be longer than any number is read.
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            yield m.start(), 1, m.end(), "ip"
    for m in _CARD.finditer(text):
        if 12 <= len(m[0]) <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), 2, m.end(), "card"
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                yield m.start(), 3, m.end(), "phone"


# Letters and digits that look like ASCII ones, with what they stand for.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ", " ": " ", " ": " ",
}


def styled(code: int) -> str | None:
    """The ASCII letter or digit that a styled form (mathematical, circled, full-width) or a digit of any script is."""
    c = chr(code)
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.decimal(c))
    if unicodedata.decomposition(c).startswith(("<font>", "<circle>", "<wide>")):
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain.isascii():
            return plain
    return None


GLYPHS = {c: v for c in range(0x80, 0x1FC00) if (v := styled(c))} | {ord(k): v for k, v in HOMOGLYPHS.items()}
INVISIBLE = "​‌‍⁠﻿­"
GLYPHS |= dict.fromkeys(map(ord, INVISIBLE), "")
_GLYPH_CHARS = frozenset(map(chr, GLYPHS))
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")

# Spelled digits.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NUMBER = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r"|[0-9]+)"
# At least four in a row, each set off by blanks, hyphens, commas or dots; "plus" and "dot" may stand between.
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:plus[\x20-]+)?{_NUMBER}(?:(?:[\x20,-]+|\.|[\x20]*\(?(?:dot|point|punkt|punto)\)?[\x20]*){_NUMBER}){{3,}}(?!\w)", re.I)
_TOKEN = re.compile(r"plus|dot|point|punkt|punto|[0-9]+|[^\W\d_]+|.", re.I | re.S)
# Words for @ and the dot.
AT_WORDS = ("at", "ät", "arroba", "arobase", "arrobase", "klammeraffe")
DOT_WORDS = ("dot", "punkt", "punto", "point")
_ATS, _DOTS, _STOD = "|".join(AT_WORDS), "|".join(DOT_WORDS), "|".join(w[::-1] for w in DOT_WORDS)
# Signs in brackets are a disguise anywhere; plain words only with both signs, a well-known last label and a name before.
_AT = re.compile(rf"[\[({{<]\x20*+(?:{_ATS}|@)\x20*+[\])}}>]|(?<=\x20)(?:{_ATS})(?=\x20)|@", re.I)
_SIGNS = re.compile(rf"[\[({{<]\x20*+(?:{_ATS}|@|{_DOTS}|\.)\x20*+[\])}}>]|\x20(?:{_DOTS})\x20", re.I)
_WORD = re.compile(r"[A-Za-z0-9%+-]++")
_DOT = re.compile(rf"(\x20*+[\[({{<]\x20*+(?:{_DOTS}|\.)\x20*+[\])}}>]\x20*+)|\x20++({_DOTS})\x20++|\.", re.I)
_TOD = re.compile(rf"(\x20*+[\])}}>]\x20*+(?:{_STOD}|\.)\x20*+[\[({{<]\x20*+)|\x20++({_STOD})\x20++|\.", re.I)  # the same, read backwards
_BLANKS = re.compile(r"\x20*+")
# Last labels of addresses in words.
_TLD = re.compile(r"(?:com|org|net|edu|gov|info|biz|io|co|ai|dev|eu|uk|us|ca|au|nz|ie|de|fr|es|pt|it|nl|ch|at|dk|fi|pl|cz|ru|gr|mx|br|jp|cn)(?![A-Za-z0-9])", re.I)
# Words before a plain "at" that name no mailbox, and hosts of pages.
_NO_NAMES = frozenset(
    "an am are at be been being bought buy call calls came come comes find found go goes he her hers him his hosted is it its lives live lived located look looked looking "
    "meet met more my now on one online only order our out read reading right same see seen shop shopping she site sold start stay started that the their them there they this "
    "today us visit visited was we were what where who work worked works you your "
    "bei besuchen der die das er es ich ist mehr sie sind steht uns war wir wohnt "
    "aquí en está están estoy ella él la las lo los más nos nosotros son su ver visite vive "
    "chez elle est ici il ils je le les nous plus sa se ses sont sur voir vous visitez".split()
)
_PAGE = re.compile(r"www(?![A-Za-z0-9])", re.I)
_LONE = ("un", "oh", "dos")  # words of their own; a run needs others too


def has_digits_in_words(lower: str) -> bool:
    found = [w for w in lower.replace(",", " ").replace(".", " ").replace("-", " ").split() if w in SPELLED]
    return len(found) > 1 and sum(w not in _LONE for w in found) > 1


class Mapped:
    """A text with, for each of its characters, the start and end of the source characters it stands for."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts=None, ends=None):
        self.text, self.starts, self.ends = text, starts if starts is not None else range(len(text)), ends if ends is not None else range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace the given ranges (sorted, apart). Every character of a replacement stands for its whole range."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new:
                text.append(new)
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        return Mapped("".join(text), starts, ends)

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def plain_glyphs(m: Mapped) -> Mapped:
    return m.rewrite([(x.start(), x.end(), GLYPHS[ord(x[0])]) for x in _NOT_ASCII.finditer(m.text) if ord(x[0]) in GLYPHS])


def plain_digits(m: Mapped) -> Mapped:
    """Runs of spelled digits become digits; "plus" a +, "dot" a dot, and blanks or commas in a run go."""
    edits = []
    for run in _SPELLED_RUN.finditer(m.text):
        # Words joined by bare dots are a name of something, not digits read out.
        if not has_digits_in_words(run[0].lower()) or not any(c in run[0] for c in " -,"):
            continue
        for x in _TOKEN.finditer(run[0]):
            word = x[0].lower()
            new = SPELLED.get(word) or ("+" if word == "plus" else "." if word in ("dot", "point", "punkt", "punto") else x[0] if x[0].isdigit() or x[0] == "." else "")
            if new != x[0]:
                edits.append((run.start() + x.start(), run.start() + x.end(), new))
    return m.rewrite(edits)


def walk(text: str, at: int, dot: re.Pattern) -> tuple[list[tuple[int, int, str]], int]:
    """The chain of words and dots that begins at `at`: its dots as (start, end, kind) and its end (at itself if there
    is none). Every step is one bounded match, so a walk takes time in proportion to the chain."""
    dots: list[tuple[int, int, str]] = []
    m = _WORD.match(text, at)
    end = m.end() if m else at
    while m:
        d = dot.match(text, end)
        m = _WORD.match(text, d.end()) if d else None
        if m:
            dots.append((*d.span(), "bracketed" if d[1] else "word" if d[2] else "dot"))
            end = m.end()
    return dots, end


def plain_signs(m: Mapped) -> Mapped:
    """at and dot signs become @ and a dot where they join words to an address.

    From each at-sign the text is walked outwards, on a reversed copy to the left; no chain of words and dots holds
    an at-sign, so each character is walked over at most twice. Some sign must be in brackets, or the at-sign is a
    plain word between a name and a host that has a plain "dot" and a well-known label, the last of which ends the address.
    """
    text, size = m.text, len(m.text)
    back = text[::-1]
    edits: list[tuple[int, int, str]] = []
    done = 0
    for sign in _AT.finditer(text):
        start = size - _BLANKS.match(back, size - sign.start()).end()
        end = _BLANKS.match(text, sign.end()).end()
        if sign.start() < done:
            continue
        right, stop = walk(text, end, _DOT)
        if not right:
            continue
        left, begin = walk(back, size - start, _TOD)
        left = [(size - b, size - a, kind) for a, b, kind in left if size - b >= done]
        begin = size - begin
        if begin == start:
            continue
        if sign[0][0] not in "[({<" and all(kind != "bracketed" for _, _, kind in left + right):
            # The address ends with the last well-known label; one of its dots is a word.
            last = max((i for i, (_, b, _) in enumerate(right) if _TLD.match(text, b)), default=None)
            if sign[0] == "@" or last is None or all(kind != "word" for _, _, kind in right[: last + 1]):
                continue
            if text[begin:start].lower() in _NO_NAMES or _PAGE.match(text, end):
                continue
            right = right[: last + 1]
            stop = _TLD.match(text, right[-1][1]).end()
        if (start, end) != sign.span() or sign[0] != "@":
            edits.append((start, end, "@"))
        edits += [(a, b, ".") for a, b, kind in left + right if kind != "dot"]
        done = stop
    return m.rewrite(sorted(edits))


def disguised(text: str) -> Iterator[Span]:
    """Identifiers that only the normalised text shows, as spans of the source."""
    m = Mapped(text)
    if not text.isascii() and not _GLYPH_CHARS.isdisjoint(text):
        m = plain_glyphs(m)
    lower = m.text.lower()
    if has_digits_in_words(lower):
        m = plain_digits(m)
    if _SIGNS.search(m.text):
        m = plain_signs(m)
    if m.text is text:
        return
    for a, k, b, kind in identifiers(m.text):
        start, end = m.source(a, b)
        yield start, k, end, kind


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind. An added span overlaps no base span of any kind and no
    added span of its kind."""
    if not text:
        return [], []
    base = sorted(identifiers(text))
    taken = sorted((a, b) for a, _, b, _ in base)
    reach, ends = [], 0
    for _, b in taken:
        ends = max(ends, b)
        reach.append(ends)
    added, last = [], {}
    starts = [a for a, _ in taken]
    for s in sorted(disguised(text)):
        i = bisect_left(starts, s[2])
        if (i and reach[i - 1] > s[0]) or last.get(s[1], 0) > s[0]:
            continue
        last[s[1]] = s[2]
        added.append(s)
    return base, sorted(base + added)


def render(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def detect(docs: DataFrame) -> DataFrame:
    """Columns of docs plus n_email, n_ip, n_card, n_phone (of all spans), base_sha256, spans and n_base.

    Spans are kind:start:end in code points, end exclusive. Null or empty text has none; base_sha256 then is that
    of the empty string. Equal rows get equal results. Runs are matched possessively and addresses are walked
    outwards from their at-signs, so very long texts take time in proportion. One pass without a shuffle; empty tables give empty results. Columns named
    as the new ones are replaced.
    """
    docs = docs.drop(*[x.split()[0] for x in RESULT.split(", ")])

    @F.pandas_udf(RESULT)
    def spans(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, every = find(t)
            counts = [sum(s[1] == k for s in every) for k in range(len(KINDS))]
            rows.append((*counts, hashlib.sha256(render(base).encode()).hexdigest(), render(every), len(base)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_base"])

    return docs.withColumn("__p", spans(F.col("text"))).select("*", "__p.*").drop("__p")


def redact(text: str | None, spans: str) -> str | None:
    """text with each span replaced by its kind in brackets; overlapping spans become one."""
    if not text or not spans:
        return text
    parts = sorted((int(a), int(b), kind) for kind, a, b in (x.split(":") for x in spans.split(",")))
    merged: list[tuple[int, int, str]] = []
    for a, b, kind in parts:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2])
        else:
            merged.append((a, b, kind))
    edges = [0, *[x for a, b, _ in merged for x in (a, b)], len(text)]
    kept = [text[a:b] for a, b in list(pairwise(edges))[::2]]
    return "".join(k + (f"[{merged[i][2]}]" if i < len(merged) else "") for i, k in enumerate(kept))
