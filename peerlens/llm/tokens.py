"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import vocabulary_path

CACHE = 1_000_000
MARK = "▁"


class PieceCounter:
    """Counts of a sentencepiece BPE model with byte fallback.

    The adjacent pair whose joined piece has the best score (of equal ones the leftmost) is merged until none
    is left; count = initial symbols - merges, where a character outside the vocabulary that was never merged
    counts its UTF-8 bytes. Texts are cut where no piece of the vocabulary can cross: between two characters
    that are adjacent in no piece. Counts of the cuts add up exactly, and those seen before are kept in a
    table of a fixed size.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.rank: dict[str, float] = {}
        self.single: set[str] = set()
        for i in range(m.get_piece_size()):
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)):
                piece = m.id_to_piece(i)
                self.rank[piece] = -m.get_score(i)
                if len(piece) == 1:
                    self.single.add(piece)
        crossing = any(MARK in p.lstrip(MARK) for p in self.rank)
        # A word is a run of marks and what follows to the next mark; if pieces could cross there, don't cut.
        self.cut = re.compile(".+" if crossing else f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.S)
        inner = {c for p in self.rank if len(p) > 1 for c in p}
        self.loose = lambda c: c not in inner
        self.seen: dict[str, int] = {}

    def normalize(self, text: str) -> str:
        return self.model.normalize(text)

    def merge(self, word: str) -> int:
        n = len(word)
        if n == 1:
            return 1 if word in self.single else len(word.encode("utf-8", "surrogatepass"))
        rank = self.rank
        part: list[str | None] = list(word)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, size = heapq.heappop(heap)
            a = part[i]
            j = right[i]
            if a is None or j >= n or len(a) + len(part[j]) != size:
                continue
            a = part[i] = a + part[j]
            part[j] = None
            k = right[i] = right[j]
            count -= 1
            if k < n:
                left[k] = i
                r = rank.get(a + part[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, len(a) + len(part[k])))
            p = left[i]
            if p >= 0:
                r = rank.get(part[p] + a)
                if r is not None:
                    heapq.heappush(heap, (r, p, len(part[p]) + len(a)))
        single = self.single
        for x in part:
            if x is not None and len(x) == 1 and x not in single:
                count += len(x.encode("utf-8", "surrogatepass")) - 1
        return count

    def pieces(self, word: str) -> Iterator[str]:
        """Cut further at characters that occur in no longer piece."""
        at = 0
        for i, c in enumerate(word):
            if self.loose(c):
                if i > at:
                    yield word[at:i]
                yield c
                at = i + 1
        if at < len(word):
            yield word[at:]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        seen, total = self.seen, 0
        for word in self.cut.findall(self.normalize(text)):
            n = seen.get(word)
            if n is None:
                n = sum(map(self.merge, self.pieces(word)))
                if len(word) < 64:
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen[word] = n
            total += n
        return total


class ByteCounter:
    """Counts of a byte-level BPE in a tokenizers .json file: merges by rank, leftmost first."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.tokenizer = Tokenizer.from_file(path)
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.suffix = model.get("end_of_word_suffix") or ""
        self.seen: dict[str, int] = {}

    def merge(self, word: str) -> int:
        symbols: list[str | None] = list(word)
        if self.suffix and symbols:
            symbols[-1] += self.suffix
        n, rank = len(symbols), self.rank
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, None
            k = right[i] = right[j]
            count -= 1
            if k < n:
                left[k] = i
                if (r := rank.get((a + b, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, symbols[k]))
            p = left[i]
            if p >= 0 and (r := rank.get((symbols[p], a + b))) is not None:
                heapq.heappush(heap, (r, p, symbols[p], a + b))
        return count

    def plain(self, text: str) -> int:
        total = 0
        norm = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(norm):
            n = self.seen.get(word)
            if n is None:
                n = self.merge(word)
                if len(word) < 64:
                    if len(self.seen) >= CACHE:
                        self.seen.clear()
                    self.seen[word] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.special:
            return self.plain(text)
        parts = self.special.split(text)  # special strings inside a text are one token each, as by default
        return sum(map(self.plain, filter(None, parts))) + len(parts) - 1


_COUNTERS: dict[str, PieceCounter | ByteCounter] = {}


def counter(name: str) -> PieceCounter | ByteCounter:
    """One counter per Python worker and vocabulary."""
    if name not in _COUNTERS:
        path = vocabulary_path(name)
        _COUNTERS[name] = PieceCounter(path) if path.endswith(".model") else ByteCounter(path)
    return _COUNTERS[name]


def count_tokens(docs: DataFrame, vocabulary: str, *, limit: int = 4096) -> DataFrame:
    """Columns of docs plus n_bytes, n_tokens and over_limit (n_tokens > limit).

    vocabulary: a file of a public tokenizer, by path or name; executors load it from their own installation.
    Null or empty text: 0 bytes, 0 tokens. Whole texts are counted; equal rows get equal results; empty tables
    give empty results. Columns named as the new ones are replaced. One pass, no shuffle; a worker keeps at
    most CACHE words.
    """
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(vocabulary)
        for batch in batches:
            yield pd.Series([c.count(t) for t in batch], dtype="int64")

    return docs.withColumns({"n_bytes": F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), "n_tokens": tokens(F.col("text"))}).withColumn("over_limit", F.col("n_tokens") > limit)
