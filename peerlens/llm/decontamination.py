"""Benchmark decontamination by spaced seeds: hashes of masked word windows are matched, then the overlap on the
diagonal of each hit is verified with substitutions allowed."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

# Five words at the ones of a mask must agree; words at its zeros are ignored.
MASKS = ("111101", "1101101", "1110011")
MIN_OVERLAP = 0.8
MIN_RUN = 13
MIN_ITEM_WORDS = 1
# Below so many words the masks don't fit between the substitutions that 80 % allows: see pieces().
SHORT_ITEM = 12
HITS = 1_000_000
BLOCK_WORDS = 1_000_000
MATCHES = "array<struct<item: long, item_words: int, matched_words: int, start_word: int>>"
# Blocks of scripts that are written without blanks; each of their characters is a word.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{_ALONE}]")
_WORD = re.compile(r"\w+")
_WORD_OR_SIGN = re.compile(rf"[{_ALONE}]|[^\W{_ALONE}]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    return (_WORD if text.isascii() or not _UNSPACED.search(text) else _WORD_OR_SIGN).findall(text.lower())


def offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def pieces(n: int, min_overlap: float) -> list[tuple[int, int]]:
    """(first word, words) of pieces of a short item: one more than the words that may differ, so that one of them is
    whole wherever those lie. Without any that may differ, the item itself."""
    k = n - math.ceil(n * min_overlap - 1e-9) + 1
    return [(i * n // k, (i + 1) * n // k - i * n // k) for i in range(k)]


def seeds(ids: np.ndarray, mask: list[int], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows whose words at the mask's ones are all known (id > 0)."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    known = ids[mask[0] : mask[0] + n] > 0
    for o in mask[1:]:
        known &= ids[o : o + n] > 0
    at = np.flatnonzero(known)
    h = np.full(len(at), salt, dtype=np.uint64)
    for o in mask:
        h = (h ^ ids[at + o].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return at, h


class Index:
    """Seeds of a block of benchmark items; its size is bounded by the block's words."""

    def __init__(self, items: list[tuple[int, str]], masks=MASKS, min_overlap=MIN_OVERLAP, min_run=MIN_RUN, min_item_words=MIN_ITEM_WORDS):
        self.masks, self.min_overlap, self.min_run = [offsets(m) for m in masks], min_overlap, min_run
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            w = words(text)
            if len(w) >= max(1, min_item_words):
                self.items.append((item, np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], dtype=np.int64)))
        self.least = min((len(ids) for _, ids in self.items), default=0)
        found = [(h, k, q) for k, (_, ids) in enumerate(self.items) for s, m in enumerate(self.masks) for q, h in zip(*seeds(ids, m, s + 1), strict=True)]
        # Short items are also sought by runs of their words; a run's mask is in use only if an item has such a piece.
        short = [(k, ids, at, n) for k, (_, ids) in enumerate(self.items) if len(ids) < SHORT_ITEM for at, n in pieces(len(ids), min_overlap)]
        for n in sorted({n for *_, n in short}):
            self.masks.append(list(range(n)))
            found += [(seeds(ids[at : at + n], self.masks[-1], len(self.masks))[1][0], k, at) for k, ids, at, size in short if size == n]
        self.hash = np.array([x[0] for x in found], dtype=np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.item = np.array([x[1] for x in found], dtype=np.int64)[order]
        self.place = np.array([x[2] for x in found], dtype=np.int64)[order]

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """(item, diagonal) pairs of all seed hits, each once. A repeated word can hit everywhere: hits are gathered
        HITS at a time and reduced to their diagonals, of which an item has no more than it and the text have words."""
        out, far = np.zeros(0, dtype=np.int64), 1 << 32  # a pair as one number
        for s, m in enumerate(self.masks):
            at, h = seeds(ids, m, s + 1)
            lo = np.searchsorted(self.hash, h, "left")
            n = np.searchsorted(self.hash, h, "right") - lo
            hit = np.flatnonzero(n)
            n, lo, at = n[hit], lo[hit], at[hit]
            part = np.cumsum(n) // HITS
            for cut in np.split(np.arange(len(n)), np.flatnonzero(part[1:] != part[:-1]) + 1) if len(n) else ():
                k = n[cut]
                rows = np.repeat(lo[cut] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())
                out = np.unique(np.concatenate([out, self.item[rows] * 2 * far + np.repeat(at[cut], k) - self.place[rows] + far]))
        return np.stack([out // (2 * far), out % (2 * far) - far], axis=1)

    def run(self, same: np.ndarray) -> int:
        """Words of the longest stretch, from match to match, of which min_overlap agree."""
        score = np.r_[0, np.cumsum(np.where(same, 1 - self.min_overlap, -self.min_overlap))]
        best, low = 0, np.minimum.accumulate(score)
        for end in np.flatnonzero(same) + 1:
            start = int(np.searchsorted(-low[:end], -score[end] - 1e-9, "left"))
            best = max(best, int(end) - start)
        return best

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, its words, those that agree, where it begins) of the items that the text holds."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words(text)), dtype=np.int64)
        if not len(self.hash) or len(ids) < self.min_overlap * self.least:
            return []
        best: dict[int, tuple[int, int]] = {}
        for k, d in self.hits(ids).tolist():
            item = self.items[k][1]
            a, b = max(0, -d), min(len(item), len(ids) - d)
            same = item[a:b] == ids[a + d : b + d]
            n = int(same.sum())
            if n >= self.min_overlap * len(item) or (n >= self.min_overlap * self.min_run and self.run(same) >= self.min_run):
                best[k] = max(best.get(k, (0, 0)), (n, -(a + d)))
        return [(self.items[k][0], len(self.items[k][1]), n, -s) for k, (n, s) in sorted(best.items())]


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about block_words words: what is broadcast at once has that bound."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = b.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(total / block_words))
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]


def _matcher(index):
    names = ("item", "item_words", "matched_words", "start_word")

    @F.pandas_udf(MATCHES)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, m, strict=True)) for m in index.value.matches(t)] for t in texts], dtype=object)

    return found


def _matches(spark: SparkSession, block: list[tuple[int, str]], **options) -> Column:
    """The MATCHES of each text with the items of one block, whose index is broadcast."""
    return _matcher(spark.sparkContext.broadcast(Index(block, **options)))(F.col("text"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """doc_id, item_id, item_words, matched_words, start_word: a row per document and benchmark item in it.

    A document holds an item if, on the diagonal of a seed hit, at least 80 % of the item's words agree, or if 80 %
    agree over a stretch of 13 words or more. Words are runs of word characters in lower case; in scripts without
    blanks each character is one. Items of fewer than 12 words are found wherever the differing words lie, those of
    fewer than five, of which none may differ, if all their words stand in a row; items of fewer than min_item_words
    (an option, 1) are not sought. Longer ones are found by spaced seeds: README gives the measured recall. Null or empty texts hold nothing; repeated items are reported under each item_id;
    repeated documents each. Every text is searched whole and without a shuffle, so hot documents or passages meet no
    other rows; texts are read once per block of the benchmark, and a task holds one block's index. Empty tables give
    empty results; further columns are ignored.
    """
    d = docs.select("doc_id", "text")
    parts = [d.select("doc_id", F.explode(_matches(d.sparkSession, block, **options)).alias("m")) for block in benchmark_blocks(benchmark, block_words)]
    return reduce(DataFrame.unionAll, parts).select("doc_id", F.col("m.item").alias("item_id"), "m.item_words", "m.matched_words", "m.start_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item. What one block of the benchmark leaves is
    written before the next is sought in it, so that a task never holds more than one block's index."""
    for k, block in enumerate(benchmark_blocks(benchmark, block_words)):
        left = materialize(docs, "decontaminated") if k else docs
        docs = left.filter(F.size(_matches(left.sparkSession, block, **options)) == 0)
    return docs
