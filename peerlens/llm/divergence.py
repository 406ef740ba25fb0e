"""Source divergence audit: how the term shares of each (lang, source) group differ from those of its siblings and lang."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MIN_DOCS = 30
SMOOTHING = 5
DIGITS = 9
TOP = 50
BLOCK = 16
CHUNK = 1024
SLAB = 32
FLUSH_TERMS = 200_000
PIECE_BYTES = 4 << 20
BROADCAST_ROWS = 200_000
COUNTS = "lang string, source string, term string, n long, docs long"
PAIRS = "lang string, source string, item string, value long"

# Bytes of a term stay, A-Z in lower case; all others become blanks. Bytes of 128 and more are parts of letters.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of some megabytes at a time."""
    spaced, at = text.translate(_LETTERS), 0
    while at < len(spaced):
        end = spaced.find(b" ", at + PIECE_BYTES) if len(spaced) - at > PIECE_BYTES else -1
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term in each group. docs: lang, source, text, no nulls.

    Tasks count in memory and hand on their sums whenever these hold FLUSH_TERMS terms, so a common term or a hot
    group sends a few rows a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], Counter] = defaultdict(Counter)
        held: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            langs, sources, terms, n, in_docs = [], [], [], [], []
            for group, counts in seen.items():
                langs += [group[0]] * len(counts)
                sources += [group[1]] * len(counts)
                terms += counts.keys()
                n += counts.values()
                in_docs += map(held[group].__getitem__, counts)
            seen.clear()
            held.clear()
            columns = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        size = 0
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, batch.column("text").cast(pa.binary()), strict=True):
                group = (lang, source)
                counts, before, own = seen[group], len(seen[group]), set()
                for terms in terms_of(text.as_py()):
                    counts.update(terms)
                    own.update(terms)
                held[group].update(own)
                size += len(counts) - before
                if size >= FLUSH_TERMS:
                    yield flush()
                    size = 0
        if seen:
            yield flush()

    parts = docs.select("lang", "source", "text").mapInArrow(count, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def bounded(df: DataFrame, name: str) -> DataFrame:
    """df written; broadcast while it has at most BROADCAST_ROWS rows, else joined by shuffling."""
    df = materialize(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def share(count: str, total: str) -> Column:
    """1 + floor(10^9 * (count + 5) / total), exactly: total is that of the smoothed counts."""
    return F.expr(f"1 + (cast({10**DIGITS} as decimal(10,0)) * cast({count} + {SMOOTHING} as decimal(19,0))) div cast({total} as decimal(19,0))")


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """The same by long division, digit by digit: exact for totals up to 9 * 10^17."""
    rest, out = count + SMOOTHING, np.zeros(len(count), dtype=np.int64)
    for _ in range(DIGITS):
        rest = rest * 10
        out = out * 10 + rest // total
        rest = rest % total
    return out + 1


def place_terms(counts: DataFrame, langs: DataFrame, min_docs: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term, total, chunk, pos, width), dealt by hash into chunks of about `chunk` terms, and a row per lang."""
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    per = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("total").alias("lang_sum"))
    per = langs.join(per, "lang", "left").na.fill(0, ["n_terms", "lang_sum"])
    per = bounded(per.withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.col("n_terms") / chunk)).cast("int")), "langs")
    cell = Window.partitionBy("lang", "chunk")
    dealt = kept.join(per, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("n_chunks")).cast("int"))
    return materialize(dealt.withColumn("pos", (F.row_number().over(cell.orderBy("term")) - 1).cast("int")).withColumn("width", F.count("*").over(cell).cast("int")), "terms"), per


def tile_sums(vectors: DataFrame) -> DataFrame:
    """lang, source, item, value: sums of |p - q| over all kept terms for each ordered pair of groups of a lang.

    vectors: lang, source, block, n_blocks, chunk, width, total, pos, n: a packed vector of counts for every group and
    chunk. Each goes to the tiles of its block with every block; a task has one tile and SLAB successive chunks, at
    most 2 * BLOCK vectors of CHUNK terms or so each at a time, and adds up the tile's submatrix chunk after chunk.
    """
    dealt = vectors.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.select("lang", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), F.floor(F.col("chunk") / SLAB).alias("slab"), "block", "source", "chunk", "width", "total", "pos", "n")

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["chunk", "block", "source"], kind="stable")
        i, j = int(df["i"].iloc[0]), int(df["j"].iloc[0])
        first = df[df["chunk"] == df["chunk"].iloc[0]]
        names, left = first["source"].to_numpy(), (first["block"] == i).to_numpy()
        rows, columns = np.flatnonzero(left), np.flatnonzero(first["block"] == j)
        sums = np.zeros((len(rows), len(columns)), dtype=np.int64)
        for _, cell in df.groupby("chunk", sort=False):
            dense = np.empty((len(cell), int(cell["width"].iloc[0])), dtype=np.int64)
            for r, (total, pos, n) in enumerate(zip(cell["total"], cell["pos"], cell["n"], strict=True)):
                dense[r] = shares(np.zeros(1, dtype=np.int64), total)[0] if total else 0
                if pos is not None and len(pos):
                    dense[r, pos] = shares(np.asarray(n, dtype=np.int64), total)
            for x, r in enumerate(rows):
                sums[x] += np.abs(dense[columns] - dense[r]).sum(axis=1)
        a, b = np.repeat(names[rows], len(columns)), np.tile(names[columns], len(rows))
        value = sums.ravel()
        if i == j:
            other = np.repeat(rows, len(columns)) != np.tile(columns, len(rows))
            a, b, value = a[other], b[other], value[other]
        else:
            a, b, value = np.r_[a, b], np.r_[b, a], np.r_[value, value]
        return pd.DataFrame({"lang": df["lang"].iloc[0], "source": a, "item": b, "value": value})

    parts = dealt.groupBy("lang", "i", "j", "slab").applyInPandas(compare, PAIRS)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part, item, value, rank: where groups of documents (lang, source, text) differ in their terms.

    Terms are runs of ASCII letters, lower-cased, and of code points beyond ASCII. A lang keeps the terms of at least
    min_docs of its documents. A group gives each kept term p = 1 + floor(10^9 * (count + 5) / (sum + 5 * kept
    terms)); all arithmetic is exact. Part pair: the groups of a lang against one another, value the sum of |p - q|
    over the kept terms. Part term: the kept terms of a group that have a larger share there than in the whole lang,
    value p - q, the `top` first. Ranks: by value descending, then item by its bytes.

    Null text, lang or source: ''. A group without terms is compared as the others are; a lang that keeps none has
    sums of 0. A lang of one source has no pairs. Repeated rows count as often as they are there; further columns
    are ignored; an empty table gives an empty result.
    """
    clean = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = materialize(term_counts(clean), "term-counts")
    groups = materialize(clean.select("lang", "source").distinct(), "groups")
    terms, langs = place_terms(counts, groups.select("lang").distinct(), min_docs, chunk)
    entries = materialize(counts.drop("docs").join(terms.select("lang", "term", "total", "chunk", "pos"), ["lang", "term"]), "entries")

    of_lang = Window.partitionBy("lang")
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    groups = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["sum"]).join(langs, "lang")
    groups = groups.withColumn("smoothed", F.col("sum") + SMOOTHING * F.col("n_terms")).withColumn("lang_smoothed", F.col("lang_sum") + SMOOTHING * F.col("n_terms"))
    groups = groups.withColumn("block", F.floor((F.row_number().over(of_lang.orderBy("source")) - 1) / block).cast("int"))
    groups = bounded(groups.withColumn("n_blocks", F.ceil(F.count("*").over(of_lang) / block).cast("int")), "group-sums")

    packed = entries.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("pos", "n")).alias("e"))
    packed = packed.select("lang", "source", "chunk", F.col("e.pos").alias("pos"), F.col("e.n").alias("n"))
    cells = groups.select("lang", "source", "block", "n_blocks", F.col("smoothed").alias("total"), F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))
    widths = bounded(terms.groupBy("lang", "chunk").agg(F.max("width").alias("width")), "widths")
    vectors = cells.join(widths, ["lang", "chunk"], "left").na.fill(0, ["width"]).join(packed, ["lang", "source", "chunk"], "left")

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pair = ranked(tile_sums(vectors)).withColumn("part", F.lit("pair"))
    above = entries.join(groups.select("lang", "source", "smoothed", "lang_smoothed"), ["lang", "source"])
    above = above.select("lang", "source", F.col("term").alias("item"), (share("n", "smoothed") - share("total", "lang_smoothed")).alias("value")).filter("value > 0")
    term = ranked(above).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(columns).unionAll(term.select(columns))
