"""Language identification by cross-parsing entropy over suffix automata of labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_CHARS = 60_000
PIECE_CHARS = 2000
MODEL_BYTES = 512 << 20
BLOCK = 2048
RESULT = "lang_pred string, score double, phrases long, symbols long, chars long"
UNDETERMINED = "und"
# A text whose matches with the best language are shorter than MIN_MATCH code points on average is in none of the learned
# languages: random letters or a script that no sample has come to 1 to 1.7, real text to 2.9 or more. The ends of a text
# break matches, which weighs in short ones: EDGE code points are added to what was matched.
MIN_MATCH = 2.25
EDGE = 4


def suffix_automaton(codes: list[int], n_codes: int) -> np.ndarray:
    """next[state, code], 0 where there is no transition; state 1 is the root. Every path from the root spells
    a substring of codes, so a walk that follows it finds longest matches. At most 2 * len(codes) + 1 rows."""
    size = 2 * len(codes) + 2
    nxt = np.zeros((size, n_codes), dtype=np.int32)
    link, length = [0] * size, [0] * size
    last, used = 1, 2
    for c in codes:
        cur, used = used, used + 1
        length[cur] = length[last] + 1
        p = last
        while p and not nxt[p, c]:
            nxt[p, c] = cur
            p = link[p]
        if not p:
            link[cur] = 1
        else:
            q = int(nxt[p, c])
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone, used = used, used + 1
                nxt[clone] = nxt[q]
                length[clone], link[clone] = length[p] + 1, link[q]
                while p and nxt[p, c] == q:
                    nxt[p, c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt[:used]


@dataclass
class Model:
    """tables: per language, a walk with restarts. table[state * n_codes + code] is the next state times
    n_codes, negative where a new phrase begins. codes: code per byte of a normalised text, 0 for one unseen in
    training. Symbols are bytes, so that a table has at most 257 columns whatever the scripts."""

    languages: list[str]
    codes: np.ndarray
    n_codes: int
    tables: list[np.ndarray]


def fit(samples: dict[str, str], model_bytes: int = MODEL_BYTES) -> Model:
    """Learn from a bounded text per language. Languages without a letter are left out.

    All tables together have at most model_bytes: each language's sample is cut to its equal share of them, which
    for the default and some fifty byte values a language is more than SAMPLE_CHARS up to 25 languages.
    """
    coded = {k: normal(v) for k, v in sorted(samples.items())}
    coded = {k: v for k, v in coded.items() if v.strip(b" ")}
    seen = np.unique(np.frombuffer(b" " + b"".join(coded.values()), dtype=np.uint8))
    codes = np.zeros(256, dtype=np.int32)
    codes[seen] = np.arange(1, len(seen) + 1)
    n, tables = len(seen) + 1, []
    most = max(1, model_bytes // (max(1, len(coded)) * 2 * 4 * n))
    for v in coded.values():
        auto = suffix_automaton(codes[np.frombuffer(v[:most], dtype=np.uint8)].tolist(), n)
        start = auto[1]  # a failed match begins a new phrase with the same symbol; an unknown symbol is one itself
        start = np.where(start == 0, 1, start)
        step = np.where(auto == 0, -start[None, :], auto)
        step[0] = step[1]
        tables.append((step * n).astype(np.int32).ravel())
    return Model(list(coded), codes, n, tables)


@lru_cache(maxsize=1)
def fitted(samples: tuple[tuple[str, str], ...], model_bytes: int) -> Model:
    """fit(), once in a worker: samples travel, tables don't."""
    return fit(dict(samples), model_bytes)


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def normal(text: str) -> bytes:
    """Lower case in UTF-8; each run of anything but letters is one blank, none at the ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[points]
    points = np.where(is_letter, points, np.uint32(32))[is_letter | np.r_[False, is_letter[:-1]]]
    raw = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return raw.removesuffix(b" ")


def encode(text: str, model: Model) -> np.ndarray:
    return model.codes[np.frombuffer(normal(text), dtype=np.uint8)]


def counted(text: str, model: Model) -> tuple[np.ndarray, int]:
    """The codes of a text's bytes, and its number of code points: bytes 0x80 to 0xBF continue one."""
    raw = np.frombuffer(normal(text), dtype=np.uint8)
    return model.codes[raw], int(((raw & 0xC0) != 0x80).sum())


def phrases(texts: list[np.ndarray], model: Model, block: int = BLOCK) -> np.ndarray:
    """phrases[text, language]: the greedy parse of each text into longest matches with each language's sample.

    Blocks of `block` symbols are parsed apart, all blocks and languages in step, so that a very long text is
    many short walks and nothing is cut off. A block's end breaks one phrase: each block adds at most one to the
    count of an unbroken parse, in every language alike.
    """
    owner = np.concatenate([np.full(-(-len(t) // block), i, dtype=np.int64) for i, t in enumerate(texts)]) if texts else np.zeros(0, dtype=np.int64)
    out = np.zeros((len(texts), len(model.tables)), dtype=np.int64)
    if not len(owner):
        return out
    parts = [t[i : i + block] for t in texts for i in range(0, len(t), block)]
    sizes = np.array([len(p) for p in parts])
    order = np.argsort(-sizes, kind="stable")
    grid = np.zeros((sizes.max(), len(parts)), dtype=np.int32)
    for col, k in enumerate(order):
        grid[: sizes[k], col] = parts[k]
    alive = np.searchsorted(-sizes[order], -np.arange(1, len(grid) + 1), side="right")
    for j, table in enumerate(model.tables):
        state = np.full(len(parts), model.n_codes, dtype=np.int32)
        count = np.ones(len(parts), dtype=np.int64)
        for row, n in zip(grid, alive, strict=True):
            to = table[state[:n] + row[:n]]
            new = to < 0
            count[:n] += new
            np.abs(to, out=state[:n])
        np.add.at(out[:, j], owner[order], count)
    return out


def predict(texts: list[str | None], model: Model) -> pd.DataFrame:
    """score: how far the best language is ahead, 1 - best / second best in phrases (1 with one language)."""
    coded, chars = zip(*[counted(t or "", model) for t in texts], strict=True) if texts else ((), ())
    got = phrases(list(coded), model)
    best = got.argmin(axis=1) if got.shape[1] else np.zeros(len(texts), dtype=int)
    langs, scores, counts = [], [], []
    for i, c in enumerate(coded):
        if not len(model.languages) or not len(c):
            langs.append(UNDETERMINED)
            scores.append(0.0)
            counts.append(0)
            continue
        row = np.sort(got[i])
        langs.append(model.languages[best[i]])
        scores.append(float(1 - row[0] / row[1]) if len(row) > 1 else 1.0)
        counts.append(int(row[0]))
    return pd.DataFrame({"lang_pred": langs, "score": scores, "phrases": counts, "symbols": [len(c) for c in coded], "chars": chars})


def sample_texts(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS, piece_chars: int = PIECE_CHARS) -> dict[str, str]:
    """Per language a sample of pieces of texts of about sample_chars code points, chosen by a hash of the text.

    The bound is the parameter: about eight times sample_chars per language reach the driver. Equal texts count once
    and a text gives piece_chars code points at most; the share that is sampled comes from what distinct texts can give.
    Runs of anything but letters are one blank (the model reads them so), so no piece is without a letter.
    """
    letters = F.btrim(F.regexp_replace("text", r"\P{L}+", " "))
    base = labelled.filter("lang is not null and text is not null").select("lang", letters.alias("text")).filter("length(text) > 0")
    given = base.select("lang", F.xxhash64("text").alias("h"), F.least(F.length("text"), F.lit(piece_chars)).alias("n")).distinct()
    totals = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return {}
    spot = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.element_at(F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(min(1.0, 8.0 * sample_chars / n)))]), F.col("lang"))
    pieces: dict[str, list[str]] = {k: [] for k in totals}
    # Of each text, the code points that a hash points at: long texts would else be the whole sample.
    at = F.greatest(F.lit(0), F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - piece_chars, F.lit(1))))
    chosen = base.withColumn("spot", spot).filter(F.col("spot") < share).select("lang", "spot", F.substring("text", at.cast("int") + 1, F.lit(piece_chars)).alias("text")).distinct()
    for r in chosen.orderBy("lang", "spot", "text").toLocalIterator():
        if sum(map(len, pieces[r["lang"]])) < sample_chars:
            pieces[r["lang"]].append(r["text"])
    return {k: "\n".join(v)[: sample_chars + piece_chars] for k, v in pieces.items()}


def identify(docs: DataFrame, labelled: DataFrame, *, sample_chars: int = SAMPLE_CHARS, piece_chars: int = PIECE_CHARS, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """Columns of docs plus lang_pred, score (0 to 1), phrases (of the winning language), symbols and chars (bytes
    and code points of the normalised text: chars / phrases is the mean length of a match).

    labelled (text, lang) is what the languages are learned from: about sample_chars code points of each, in pieces
    of piece_chars, in tables of model_bytes together. The sample goes to the workers, each of which builds its tables once. A prediction reads the text alone, and all of it. Null
    text or text without a letter: `und`, score 0. Without any labelled text all is `und`. Ties go to the
    language first in code-point order. Every row is scored; equal texts get equal results; empty tables give
    empty results. Columns named as the new ones are replaced.
    """
    docs = docs.drop("lang_pred", "score", "phrases", "symbols", "chars")
    samples = tuple(sorted(sample_texts(labelled, sample_chars, piece_chars).items()))

    @F.pandas_udf(RESULT)
    def lang(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = fitted(samples, model_bytes)
        for batch in batches:
            yield pd.concat([predict(part, model) for part in slices(list(batch))] or [predict([], model)], ignore_index=True)

    return docs.withColumn("__l", lang(F.col("text"))).select("*", "__l.*").drop("__l")


def recognised(min_match: float = MIN_MATCH, edge: int = EDGE) -> Column:
    """Of rows of identify(): whether the text has a letter and is not foreign to the language predicted for it."""
    return (F.col("lang_pred") != UNDETERMINED) & (F.col("chars") + edge >= min_match * F.col("phrases"))


def slices(texts: list[str | None], chars: int = 4_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of about that many code points: bounds the memory of a walk."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part
