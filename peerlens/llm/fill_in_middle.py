"""Fill-in-middle transformation: texts are cut at two chosen boundaries and put together anew around three marks."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
UNITS = ("char", "word", "line")
DRAWS = 4
PIECES = "n_units long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int | str) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first groups of eight hex digits of sha256(seed:doc_id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(DRAWS)]


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart in any output: no mark is empty, in another one, or begins as a mark ends."""
    for a, b in itertools.product(marks, repeat=2):
        if not a or (a is not b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
            raise ValueError(f"marks {a!r} and {b!r} can't be told apart")
    if len(set(marks)) != len(marks):
        raise ValueError("marks must differ")


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where a text may be cut: 0, its length, and each place where the class of neighbouring code points changes.

    Classes: each code point is one of its own (char); blank or not (word); the line it is on (line, with its end).
    """
    n = len(points)
    if unit == "char":
        kind = np.arange(n)
    elif unit == "word":
        kind = (points == 0x20) | ((points >= 9) & (points <= 13))
    else:
        kind = np.cumsum(np.r_[0, (points == 10)[:-1]]) if n else np.zeros(0, dtype=np.int64)
    inner = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    return np.r_[0, inner, n] if n else np.zeros(1, dtype=np.int64)


def transform(docs: DataFrame, *, seed: int | str = 1, unit: str = "char", marks: tuple[str, str, str] = MARKS, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """Columns of docs plus n_units, form, prefix_chars, middle_chars, output.

    A text of n units has n + 1 boundaries; the draws h1 and h2 of a document choose two of them by h % (n + 1).
    What lies before the first is the prefix, between them the middle, after the second the suffix. h3 % 100 >=
    fim_percent, a text that holds a mark, and an empty one stay as they are (form plain); else h4 % 100 < spm_percent
    puts the suffix first (spm), and all others are psm. `restore` gives the text back.

    Null text: empty. Null doc_id: draws as one named null. Equal rows get equal results; rows that share a doc_id share
    its draws. Columns of docs with the names of results are replaced. Empty tables give empty results. A task holds
    one Arrow batch of texts, and one text at a time as code points.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    check_marks(marks)
    p, s, m = marks

    @F.pandas_udf(PIECES)
    def pieces(texts: pd.Series, h1: pd.Series, h2: pd.Series, h3: pd.Series, h4: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, b, c, d in zip(texts, h1, h2, h3, h4, strict=True):
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            cuts = boundaries(points, unit)
            if not text or c % 100 >= fim_percent or any(x in text for x in marks):
                out.append((len(cuts) - 1, "plain", None, None, text))
                continue
            i, j = sorted((int(cuts[a % len(cuts)]), int(cuts[b % len(cuts)])))
            prefix, middle, suffix = (x.tobytes().decode("utf-32-le", "surrogatepass") for x in (points[:i], points[i:j], points[j:]))
            form = "spm" if d % 100 < spm_percent else "psm"
            made = f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"
            out.append((len(cuts) - 1, form, i, j - i, made))
        made = pd.DataFrame(out, columns=["n_units", "form", "prefix_chars", "middle_chars", "output"])
        return made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = ["n_units", "form", "prefix_chars", "middle_chars", "output"]
    given = docs.drop(*made)
    own = F.struct("*").alias("__row")
    cut = given.select(own, pieces(F.coalesce(F.col("text"), F.lit("")), *draws(F.col("doc_id"), seed)).alias("__fim"))
    return cut.select("__row.*", "__fim.*")


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text behind an output: marks occur in no text that was cut, so the first ones are those put in."""
    p, s, m = marks

    def split(x: Column, mark: str) -> tuple[Column, Column]:
        return F.substring_index(x, mark, 1), F.substring(x, F.instr(x, mark) + F.lit(len(mark)), F.length(x))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one, rest = split(F.substring(output, F.lit(len(first) + 1), F.length(output)), second)
        return one, *split(rest, m)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "plain", output).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(psm)
