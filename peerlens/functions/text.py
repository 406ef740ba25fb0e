"""Text functions on columns: names, fees, seasons, competitions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import CUP_WORDS, NAME_SUFFIXES

# Letters that decomposition leaves as they are.
_FROM = "ØøŁłĐđÐðıÞþ"
_TO = "OoLlDdDdiTt"
_TWO = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe"}


# Letters of other scripts, as they are after decomposition, and what they are written as.
CYRILLIC = """
А A Б B В V Г G Д D Е E Ж Zh З Z И I К K Л L М M Н N О O П P Р R С S Т T У U Ф F Х Kh Ц Ts Ч Ch Ш Sh Щ Shch Ъ ' Ы Y Ь ' Э E Ю Iu Я Ia
Ђ Dj Є Ie Ѕ Dz І I Ј J Љ Lj Њ Nj Ћ Tsh Џ Dzh Ґ G
"""
GREEK = "Α A Β B Γ G Δ D Ε E Ζ Z Η E Θ Th Ι I Κ K Λ L Μ M Ν N Ξ X Ο O Π P Ρ R Σ S Τ T Υ U Φ Ph Χ Kh Ψ Ps Ω O"
# Hangul syllables decompose into an initial, a vowel and a final, each in an alphabet of its own, in these orders.
HANGUL = (
    (0x1100, "g gg n d dd r m b bb s ss - j jj c k t p h"),
    (0x1161, "a ae ya yae eo e yeo ye o wa wae oe yo u weo we wi yu eu yi i"),
    (0x11A8, "g gg gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j c k t p h"),
)


@lru_cache(maxsize=1)
def letter_table() -> dict[int, str]:
    """Code points of decomposed text with their ASCII form: letters that have no marks to lose, and three other scripts.

    Code points without an entry that aren't ASCII go: marks, and scripts that aren't listed (kana, Arabic, Hebrew, Han).
    """
    table = str.maketrans(_FROM, _TO) | {ord(k): v for k, v in _TWO.items()}
    for listed in (CYRILLIC, GREEK):
        words = listed.split()
        for letter, form in zip(words[::2], words[1::2], strict=True):
            table |= {ord(letter): form, ord(letter.lower()): form.lower()}
    table[ord("ς")] = "s"
    for first, forms in HANGUL:
        table |= {first + i: form.replace("-", "") for i, form in enumerate(forms.split())}
    return table


@F.pandas_udf(T.StringType())
def to_ascii(names: pd.Series) -> pd.Series:
    """Letters without marks; Cyrillic, Greek and Hangul in Latin letters; what has no ASCII form goes."""
    table = letter_table()
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).translate(table).encode("ascii", "ignore").decode())


def squeeze_name(ascii_name: Column) -> Column:
    """Lower case words; suffixes such as "jr" go from the end while more than one word is left. Built-ins only."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.lower(ascii_name), "[^a-z0-9 ]+", " "), " +", " "))
    ends = "|".join(NAME_SUFFIXES)
    return F.coalesce(F.regexp_replace(flat, f"(?<=[a-z0-9])( ({ends}))+$", ""), F.lit(""))


def normalize_name(name: Column) -> Column:
    """Plain ASCII skips Python: only names with other letters are sent there."""
    return squeeze_name(F.when(name.rlike(r"^[\x00-\x7F]*$"), name).otherwise(to_ascii(name)))


def parse_fee(text: Column) -> Column:
    """struct(status, kind, amount, currency) of a reported fee. Commas are dropped, not decimal signs."""
    t = F.trim(text)
    low = F.lower(t)
    pattern = r"^\s*([€$£])\s*([\d.,]+)\s*([KkMm])?\s*$"
    number = F.regexp_replace(F.regexp_extract(t, pattern, 2), ",", "").try_cast("double")
    unit = F.lower(F.regexp_extract(t, pattern, 3))
    amount = number * F.when(unit == "m", 1e6).when(unit == "k", 1e3).otherwise(1.0)
    symbol = F.regexp_extract(t, pattern, 1)
    money = F.when(symbol == "€", "EUR").when(symbol == "$", "USD").when(symbol == "£", "GBP")
    make = lambda status, kind, a=None, c=None: F.struct(F.lit(status).alias("status"), F.lit(kind).alias("kind"), (a if a is not None else F.lit(None).cast("double")).alias("amount"), (c if c is not None else F.lit(None).cast("string")).alias("currency"))
    return (
        F.when(F.coalesce(t, F.lit("")) == "", make("unknown", "unknown"))
        .when(low.startswith("loan"), make("loan_fee", "loan"))
        .when(low.isin("free", "free transfer", "free agent"), make("free", "free"))
        .when(low.isin("n/a", "na", "-", "?", "undisclosed", "transfer"), make("undisclosed", "permanent"))
        .when(t.rlike(pattern) & number.isNotNull(), make("disclosed", "permanent", amount, money))
        .otherwise(make("unknown", "unknown"))
    )


def season_years(name: Column) -> Column:
    """struct(start, end) of "2015/2016" or of a name that begins with its year."""
    two = r"^(\d{4})/(\d{4})$"
    year = F.substring(name, 1, 4).try_cast("int")
    return F.struct(F.when(name.rlike(two), F.regexp_extract(name, two, 1).try_cast("int")).otherwise(year).alias("start"), F.when(name.rlike(two), F.regexp_extract(name, two, 2).try_cast("int")).otherwise(year).alias("end"))


def competition_kind(youth: Column, international: Column, in_region: Column, name: Column) -> Column:
    return F.when(youth, "youth").when(international, "international_national").when(in_region, "international_club").when(F.lower(name).rlike("|".join(CUP_WORDS)), "domestic_cup").otherwise("domestic_league")


def height_cm(text: Column) -> Column:
    """Metres (3 or less) become centimetres; what is no number is null."""
    h = F.regexp_replace(text, ",", ".").try_cast("double")
    return F.when(h <= 3, F.round(h * 100)).otherwise(F.round(h)).cast("int")


def clock_minutes(clock: Column) -> Column:
    """"MM:SS" in minutes; seconds may be missing."""
    p = F.split(clock, ":")
    return F.get(p, F.lit(0)).cast("int") + F.coalesce(F.get(p, F.lit(1)).cast("double"), F.lit(0.0)) / 60.0


def timestamp_seconds(ts: Column) -> Column:
    """"HH:MM:SS.mmm" in seconds."""
    p = F.split(ts, ":")
    return F.get(p, F.lit(0)).cast("int") * 3600 + F.get(p, F.lit(1)).cast("int") * 60 + F.get(p, F.lit(2)).cast("double")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit per place of a, all moved at once for each character of b."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = free = (1 << len(a)) - 1
    for c in b:
        at = free & places.get(c, 0)
        free = ((free + at) | (free - at)) & every
    return len(a) - free.bit_count()


def _indel_ratio(a: str, b: str) -> float:
    """100 * 2 * common subsequence / sum of lengths."""
    if not a and not b:
        return 100.0
    return 100.0 * 2 * common_length(a, b) / (len(a) + len(b))


@lru_cache(maxsize=1 << 16)  # pairs of names recur; a bounded number of them is kept per worker
def token_set_ratio(a: str | None, b: str | None) -> float:
    """0 to 100: the best of common words against each side, and of the two sides (each with the common words)."""
    x, y = set(re.split(r"\s+", a.strip())) - {""} if a else set(), set(re.split(r"\s+", b.strip())) - {""} if b else set()
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    base = " ".join(both)
    one, two = " ".join([*both, *left]), " ".join([*both, *right])
    found = [_indel_ratio(one, two)]
    if both:
        found += [_indel_ratio(base, one), _indel_ratio(base, two)]
    return max(found)


@F.pandas_udf(T.DoubleType())
def token_set_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) / 100.0 for x, y in zip(a, b, strict=True)], dtype=float)
