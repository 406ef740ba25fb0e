"""Near-duplicate detection: banded MinHash candidates, odd-sketch verification, exact confirmation, components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SAMPLES = 256
ROWS = 4
BANDS = 24
SKETCH_BITS = 1024
WORDS = 5
PERCENT = 80
SLACK = 0.125
CHUNK = 512
PACK = 20_000
BROADCAST_IDS = 2_000_000
PARITY_WORDS = 32
FINGERPRINT = "n_shingles long, set_key string, bands array<long>, sketch array<long>, parity array<long>"

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_C = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; of all words where there are fewer.

    A-Z are lowered; words are runs of anything but space and the controls 9 to 13.
    """
    from xxhash import xxh3_64_intdigest

    # On bytes, lower() and split() know ASCII only, which is just that.
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = _mix(h ^ (w[i : len(w) - size + 1 + i] * _C[i % 64]))
    return np.unique(h)


def minhash(s: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 8192):
        np.minimum(low, (x[i : i + 8192, None] * _A + _B).min(axis=0), out=low)
    return low


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap: each (sample number, value) flips one bit."""
    at = _mix(samples.astype(np.uint64) * np.uint64(SAMPLES) + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(bits)
    odd = np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """PARITY_WORDS numbers of 64 bits: a bit for each bucket of hashes, set where a set has an odd number there. Of two
    sets, the bits that differ are at most as many as the shingles that only one of them has."""
    odd = np.bincount((_mix(s) % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def similarity_of(flips: int | float, bits: int = SKETCH_BITS, samples: int = SAMPLES) -> float:
    """The Jaccard similarity that a population count of the XOR of two sketches estimates."""
    return 1.0 if flips <= 0 else max(0.0, 1 + bits / (4 * samples) * math.log(max(1e-9, 1 - 2 * flips / bits)))


def most_flips(similarity: float) -> int:
    return max(f for f in range(SKETCH_BITS // 2) if similarity_of(f) >= similarity)


def fingerprint_column(text: Column, size: int) -> Column:
    @F.pandas_udf(FINGERPRINT)
    def fingerprint(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingles(t, size)
            if not len(s):
                rows.append((0, None, None, None, None))
                continue
            m = minhash(s)
            pair = m[: BANDS * ROWS].view(np.uint64).reshape(BANDS, ROWS // 2)
            bands = _mix(pair[:, 0] ^ _mix(pair[:, 1] + np.arange(BANDS, dtype=np.uint64)))
            key = f"{len(s)}-{int(s.sum(dtype=np.uint64)):x}-{int(_mix(s).sum(dtype=np.uint64)):x}"
            rows.append((len(s), key, bands.view(np.int64), odd_sketch(m), parity(s)))
        return pd.DataFrame(rows, columns=["n_shingles", "set_key", "bands", "sketch", "parity"])

    return fingerprint(text)


def flips(a: str, b: str, words: int = SKETCH_BITS // 64) -> Column:
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i))))
    return total


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity. texts: rep, text of the documents in pairs.

    A text travels to the pairs it is in; a hub's pairs are split by the skew join.
    """

    @F.pandas_udf("boolean")
    def linked(ids: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        out, last, sets = [], None, None
        for i, a, b in zip(ids, left, right, strict=True):
            if i != last:
                last, sets = i, shingles(a, size)
            other = shingles(b, size)
            both = len(np.intersect1d(sets, other, assume_unique=True))
            out.append(100 * both >= percent * (len(sets) + len(other) - both))
        return pd.Series(out, dtype=bool)

    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(two, "b").join(one, "a")
    return both.filter(linked(F.col("a"), F.col("ta"), F.col("tb"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star steps: each node's neighbours are hung below its smallest neighbour.
    The smallest neighbour is a partial aggregate and is joined back, so a hub is never gathered in one task.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        print_of = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (print_of["n"], print_of["s"]) == seen:
            break
        seen = (print_of["n"], print_of["s"])
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = materialize(small, "edges")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def cross_pairs(members: DataFrame, limit: int, percent: int) -> DataFrame:
    """(a, b) of the pairs in a bucket that are in different components and whose sketches differ in at most
    `limit` bits and whose sizes and parity bits allow the similarity (both exactly). members: bucket, rep, component,
    sketch, parity, bands, n_shingles, n (the bucket's size).

    A bucket is compared in blocks of CHUNK by CHUNK members, so neither memory nor one task grows with a bucket;
    small blocks share a group of about PACK rows. Only pairs that pass are emitted, and each only once: in the
    bucket of the first band that the two share.
    """
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    placed = members.withColumn("c", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), parts - 1)))
    placed = placed.select("bucket", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "rep", "component", "sketch", "parity", "bands", "n_shingles")
    packs = max(64, (members.agg(F.sum(parts.cast("long"))).first()[0] or 0) // PACK)  # of rows as placed, so no pack grows with a bucket

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["bucket", "i", "j", "c"], kind="stable")
        bucket, i, j, c, rep, of, n = (df[x].to_numpy() for x in ("bucket", "i", "j", "c", "rep", "component", "n_shingles"))
        bits, bands = np.stack(df["sketch"].to_numpy()).view(np.uint64), np.stack(df["bands"].to_numpy())  # bits of a signed number are those of its size
        par = np.stack(df["parity"].to_numpy()).view(np.uint64)
        new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        out_a, out_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for lo, hi in zip(np.r_[0, new], np.r_[new, len(df)], strict=True):
            if (of[lo:hi] == of[lo]).all():
                continue
            # Within one chunk all rows meet; between two, the rows of the first meet those of the second.
            split = hi if i[lo] == j[lo] else lo + int((c[lo:hi] == i[lo]).sum())
            start = lo if i[lo] == j[lo] else split
            for x in range(lo, split, 64):
                y = slice(x, min(x + 64, split))
                near = np.bitwise_count(bits[y, None, :] ^ bits[None, start:hi, :]).sum(axis=2) <= limit
                near &= of[y, None] != of[None, start:hi]
                near &= 100 * np.minimum(n[y, None], n[None, start:hi]) >= percent * np.maximum(n[y, None], n[None, start:hi])
                if near.any():
                    differ = np.bitwise_count(par[y, None, :] ^ par[None, start:hi, :]).sum(axis=2, dtype=np.int64)
                    near &= differ * (100 + percent) <= (n[y, None] + n[None, start:hi]) * (100 - percent)
                p, q = np.nonzero(near)
                p, q = p + x, q + start
                if start == lo:
                    p, q = p[p < q], q[p < q]
                same = bands[p] == bands[q]
                once = bands[p, same.argmax(axis=1)] == bucket[p]
                out_a.append(np.minimum(rep[p], rep[q])[once])
                out_b.append(np.maximum(rep[p], rep[q])[once])
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return placed.groupBy(F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(packs))).applyInPandas(compare, "a long, b long").distinct()


def place() -> Column:
    """Order of the rows of a component: by doc_id, null last, then by the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")


def _linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, first: a row per row of docs. first is the place of the component's first row;
    it is null without shingles. Nodes are distinct shingle sets, with numbers of their own, so that texts which share
    a doc_id are apart.
    """
    prints = materialize(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint_column(F.col("text"), words).alias("f")).select("doc_id", "text_hash", "f.*"), "fingerprints")
    sets = prints.filter("n_shingles > 0").groupBy("set_key").agg(F.min(place()).alias("of"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"))
    reps = materialize(sets.withColumn("rep", F.monotonically_increasing_id()), "sets")  # once written, the numbers stay
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    # The member that a bucket picks is the smallest by rep XOR bucket: another one in each bucket of a group.
    heads = rows.groupBy("bucket").agg(F.min(F.col("rep").bitwiseXOR(F.col("bucket"))).alias("p"), F.count("*").alias("n")).filter("n > 1").select("bucket", F.col("p").bitwiseXOR(F.col("bucket")).alias("head"), "n")
    shared = materialize(rows.join(heads, "bucket"), "buckets")

    limit = most_flips(percent / 100 - SLACK)
    ends = lambda pairs: pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep"))).distinct()
    sketches = reps.select("rep", "sketch", "parity", "n_shingles")
    star = shared.filter("rep <> head").select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
    star = star.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("parity").alias("pa"), F.col("n_shingles").alias("na")), "a").join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("parity").alias("pb"), F.col("n_shingles").alias("nb")), "b")
    same = flips("pa", "pb", PARITY_WORDS) * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    star = materialize(star.filter((flips("sa", "sb") <= limit) & same & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "b"), "pairs")

    def texts_of(pairs: DataFrame) -> DataFrame:
        """A text of each set: of the row with the smallest doc_id, told from others with that id by its hash."""
        wanted = materialize(ends(pairs).join(reps.select("rep", F.col("of.doc_id").alias("__id"), F.col("of.text_hash").alias("__hash")), "rep"), "wanted")
        if wanted.count() <= BROADCAST_IDS:  # 48 MB of numbers; beyond, Spark shuffles both sides
            wanted = F.broadcast(wanted)
        named = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")))
        return named.dropDuplicates(["rep"]).select("rep", "text")

    edges = materialize(confirm(star, materialize(texts_of(star), "texts"), words, percent), "links")
    found = materialize(components(edges), "components")
    for_members = shared.select("bucket", "rep", "n").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = for_members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    members = materialize(for_members.join(mixed, "bucket", "left_semi").join(reps.select("rep", "sketch", "parity", "bands", "n_shingles"), "rep"), "members")
    rest = materialize(cross_pairs(members, limit, percent).join(star, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = materialize(confirm(rest, materialize(texts_of(rest), "texts"), words, percent), "links")
        if not more.isEmpty():
            found = materialize(components(edges.unionAll(more)), "components")
    of_set = materialize(reps.select("set_key", F.col("rep").alias("node"), "of").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "set-components")
    first = of_set.groupBy("component").agg(F.min("of").alias("first"))
    of_set = of_set.join(first, "component").select("set_key", "first")
    return prints.select("doc_id", "text_hash", "n_shingles", "set_key").join(of_set, "set_key", "left").drop("set_key")


def link(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: near-duplicate components of docs (doc_id, text).

    Two documents are linked if 100 * shared shingles >= percent * all shingles of both; component_id is the
    smallest doc_id reachable. Candidates share one of 24 bands of four MinHash samples (a pair at 80 % is missed
    with a chance of 3e-6) and pass the odd sketch with a slack of five standard errors; parity bits of whole sets rule out
    more, exactly, and what passes is confirmed on full shingle sets. Equal sets are joined first and go on as one. Then every member of a bucket is compared
    with one member that the bucket's hash picks, which joins nearly all; members of one bucket that are still in
    different components are all compared, in blocks. So no link between components of the result is left out and
    no group is expanded into pairs.

    Null, empty or blank texts: no shingles, linked with nothing. Every row is returned. Rows with one doc_id and
    different texts are documents of their own, each with its own links; equal rows get equal results. A row with a
    null doc_id is linked as others are, but no component is named after it; if a component has no other rows, its id
    is null. kept is doc_id = component_id, two nulls being equal (keep_one keeps one of those). Empty tables give empty results; further columns are ignored.
    """
    first = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    out = _linked(docs, words, percent).select("doc_id", "n_shingles", first.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each component the smallest doc_id stays.

    A null doc_id comes after all others; of different texts with that doc_id in one component, one text stays, picked
    by its hash. Different texts of one doc_id that are not linked all stay. Of rows that repeat both doc_id and text
    one stays, also without words. The texts are not shuffled while the removed rows number at most BROADCAST_IDS;
    beyond, Spark joins by doc_id and hash.
    """
    linked = materialize(_linked(docs, words, percent), "linked")
    gone = linked.filter(F.col("first").isNotNull() & ~place().eqNullSafe(F.col("first"))).select("doc_id", "text_hash")
    again = linked.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_hash")

    def named(ids: DataFrame) -> DataFrame:
        ids = materialize(ids.distinct().toDF("__id", "__hash"), "ids")
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    hashed = docs.withColumn("__text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    left = hashed.join(named(gone), same, "left_anti")
    repeats = named(again)
    if repeats.isEmpty():
        return left.select(docs.columns)
    one = left.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "__text_hash"])
    return left.join(repeats, same, "left_anti").unionByName(one).select(docs.columns)
