"""Removal of repeated byte strings by suffix arrays that are built by Lyndon grouping."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LENGTH = 100
GRAM = 16
GROUP_CONTEXTS = 512
PACK_BYTES = 1 << 18
ARRAY_BYTES = 1 << 12
BROADCAST_KEYS = 500_000
NO_ID = (1 << 63) - 1


def suffix_array(text: Sequence[int] | np.ndarray) -> list[int]:
    """Order of the suffixes of text, in linear time and without renaming.

    Phase 1 groups suffixes by their Lyndon prefixes: groups are taken from the highest down, and for each member
    the nearest suffix before it in a lower group (its previous-smaller pointer) gains the member's prefix. The
    suffixes gained for leave their group for a new one right above it, those that gained more times for a higher
    one. Phase 2 emits: whenever a suffix gets its place, the suffix before it and those along its pointers take
    the next places of their groups. text: non-negative numbers; a shorter suffix comes before its extensions.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    # One more symbol, smaller than all, ends the text; group[i] is the first place of the group of suffix i.
    s = np.append(np.asarray(text, dtype=np.int64) + 1, 0)
    n += 1
    by_symbol = np.argsort(s, kind="stable")
    sorted_symbols = s[by_symbol]
    firsts = np.flatnonzero(np.r_[True, sorted_symbols[1:] != sorted_symbols[:-1]])
    sizes = np.diff(np.r_[firsts, n])
    by_place = np.zeros((3, n), dtype=np.int64)
    by_place[0, by_symbol] = np.arange(n)
    by_place[1, by_symbol] = np.repeat(firsts, sizes)
    by_place[2, firsts] = sizes
    order = by_symbol.tolist()
    place, group, size = by_place.tolist()  # size: by the group's first place
    prev = [-1] * n
    hi = n
    while hi > 0:
        g = group[order[hi - 1]]
        if hi - g == 1:
            i = order[g]
            hi = g
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0 and size[group[j]] > 1:
                h = group[j]
                size[h] -= 1
                at = h + size[h]
                p, other = place[j], order[at]
                order[p], order[at] = other, j
                place[other], place[j] = p, at
                group[j] = at
                size[at] = 1
            continue
        members = sorted(order[g:hi])
        hi = g
        gained: list[int] = []
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                gained.append(j)
        batches = [gained]
        if len(set(gained)) < len(gained):
            by: dict[int, list[int]] = {}
            for j, times in Counter(gained).items():
                by.setdefault(times, []).append(j)
            # Most gains first: each batch goes right above what stays, so below the batches that gained more.
            batches = [by[times] for times in sorted(by, reverse=True)]
        for batch in batches:
            moved: dict[int, list[int]] = {}
            for j in batch:
                h = group[j]
                if h in moved:
                    moved[h].append(j)
                else:
                    moved[h] = [j]
            for h, js in moved.items():
                if len(js) == size[h]:
                    continue
                new = h + size[h] - len(js)
                at = h + size[h]
                for j in js:
                    at -= 1
                    p, other = place[j], order[at]
                    order[p], order[at] = other, j
                    place[other], place[j] = p, at
                for j in js:
                    group[j] = new
                size[new] = len(js)
                size[h] -= len(js)
    out = [-1] * n
    out[0] = n - 1
    next_place = group  # the next free place of a group is kept at its first place
    free = list(range(n))
    done = [False] * n
    done[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            h = next_place[j]
            out[free[h]] = j
            free[h] += 1
            done[j] = True
            j = prev[j]
    return out[1:]


_rng = np.random.default_rng(7)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def powers(data: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """{k: hash of the k bytes from each position} for powers of two up to top, by doubling."""
    h, k, m = _BYTE[data], 1, _M
    out = {}
    while k < top:
        h = h[:-k] * np.uint64(m) + h[k:] if len(h) > k else h[:0]
        m, k = m * m % (1 << 64), k * 2
        out[k] = h
    return out


def ranges_hash(h: np.ndarray, k: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, start + size) out of hashes of k bytes, for k <= size <= 3 * k - 4."""
    last = start + size - k
    middle = np.minimum(start + k - 4, last)
    return _mix(h[start] * np.uint64(3) + h[middle] * np.uint64(5 * _M % (1 << 64)) + h[last] * np.uint64(_M) + size.astype(np.uint64))


ANCHOR = "doc_id long, text_hash long, anchor long, context long, left long, right long, first int, place int, windows int"


def anchors(raw: bytes, length: int = LENGTH, alone: bool = False) -> dict[str, np.ndarray]:
    """Runs of windows of `length` bytes that share their anchor: its hash and place, the first window, how many.

    A window's anchor is its gram of smallest hash, the leftmost of equal ones. Equal windows have equal anchors at
    equal offsets, so they meet under the anchor's hash. context: hash of the bytes that the run's windows cover,
    and of the anchor's place in them. A window holds the `side_of(length)` bytes left of its anchor, or those
    right of it: left and right are their hashes. alone: only the anchors' hashes.
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    by = powers(data, GRAM if alone else 64)
    h = _mix(by[GRAM])
    # The place in the low bits makes the leftmost of equal hashes the smallest.
    bits = max(24, int(len(h)).bit_length())
    key = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    span, low, k = length - GRAM + 1, key, 1
    while 2 * k <= span:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    if k < span:
        low = np.minimum(low[: len(low) - (span - k)], low[span - k :])
    at = (low & np.uint64((1 << bits) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    if alone:
        return {"anchor": h[at[first]].view(np.int64)}
    windows = np.diff(np.r_[first, len(at)])
    place, side = at[first], side_of(length)
    context = _mix(ranges_hash(by[64], 64, first, windows + length - 1) + (place - first).astype(np.uint64))
    ends = np.full(len(first), side)
    left, right = np.zeros(len(first), dtype=np.uint64), np.zeros(len(first), dtype=np.uint64)
    has = place - first >= side
    left[has] = ranges_hash(by[GRAM], GRAM, place[has] - side, ends[has]) | np.uint64(1)
    has = place - (first + windows - 1) < side
    right[has] = ranges_hash(by[GRAM], GRAM, place[has] + GRAM, ends[has]) | np.uint64(1)
    return {"anchor": h[place].view(np.int64), "context": context.view(np.int64), "left": left.view(np.int64), "right": right.view(np.int64), "first": first.astype(np.int32), "place": place.astype(np.int32), "windows": windows.astype(np.int32)}


def side_of(length: int) -> int:
    """Of the bytes besides the gram, at least half lie on one side."""
    return (length - GRAM) // 2


def repeats(contexts: list[tuple[bytes, int, tuple]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Per context the ranges of window starts whose `length` bytes also start in an earlier one.

    contexts: (bytes, offset of the anchor, sort key). All windows of a context hold the anchor, and no window is in
    a context twice, so "earlier" is the order of the sort keys. One suffix array over all contexts, set apart by
    symbols of their own. Suffixes that start with the same `length` bytes stand next to each other in it, and with
    no other between them, so window starts alone are compared, each with the one before.
    """
    n = len(contexts)
    sizes = np.array([len(raw) + 1 for raw, _, _ in contexts])
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(n), sizes)
    start = np.arange(len(owner)) - begin[owner]
    text = np.frombuffer(b"\0".join(raw for raw, _, _ in contexts) + b"\0", dtype=np.uint8).astype(np.int64) + n
    text[begin + sizes - 1] = np.arange(n)
    order = np.array(suffix_array(text), dtype=np.int64)
    order = order[(sizes[owner] - start)[order] > length]
    marked: list[list[int]] = [[] for _ in contexts]
    run: list[tuple[int, int]] = []
    before = None

    def close() -> None:
        if len(run) > 1:
            first = min((contexts[c][2], x) for c, x in run)
            for c, x in run:
                if (contexts[c][2], x) != first:
                    marked[c].append(x)

    for c, x in zip(owner[order].tolist(), start[order].tolist(), strict=True):
        window = contexts[c][0][x : x + length]
        if window != before:
            close()
            run, before = [], window
        run.append((c, x))
    close()
    out = []
    for starts in marked:
        ranges: list[tuple[int, int]] = []
        for x in sorted(starts):
            if ranges and ranges[-1][1] == x:
                ranges[-1] = (ranges[-1][0], x + 1)
            else:
                ranges.append((x, x + 1))
        out.append(ranges)
    return out


def anchor_rows(texts: DataFrame, length: int, alone: bool = False) -> DataFrame:
    """A row per run of windows; alone: the anchor's hash is its only column."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            parts = []
            for doc, text_hash, text in zip(df["doc_id"], df["text_hash"], df["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) >= length:
                    found = anchors(raw, length, alone)
                    n = len(found["anchor"])
                    parts.append(found if alone else {"doc_id": np.full(n, doc, dtype=np.int64), "text_hash": np.full(n, text_hash, dtype=np.int64), **found})
            if parts:
                yield pd.DataFrame({n: np.concatenate([p[n] for p in parts]) for n in parts[0]})

    return texts.mapInPandas(rows, "anchor long" if alone else ANCHOR)


def cut_contexts(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """wanted (doc_id, text_hash, cuts: array of (group, first, windows, at)) with the bytes that the windows cover."""
    schema = "group long, doc_id long, text_hash long, first int, windows int, at int, bytes binary"

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for doc, text_hash, text, cuts in zip(df["doc_id"], df["text_hash"], df["text"], df["cuts"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(c["group"], doc, text_hash, c["first"], c["windows"], c["at"], raw[c["first"] : c["first"] + c["windows"] + length - 1]) for c in cuts]
            yield pd.DataFrame(out, columns=["group", "doc_id", "text_hash", "first", "windows", "at", "bytes"])

    return texts.join(wanted, ["doc_id", "text_hash"]).mapInPandas(cut, schema)


MARK = "doc_id long, text_hash long, start long, end long"
DOC = ("doc_id", "text_hash")  # a document; documents come in this order

Row = tuple[bytes, int, int, int, int]  # bytes, doc_id, text_hash, first, at


def partners(rows: list[Row], length: int, core: int) -> list[Row]:
    """The contexts of a group that can share a window with another one of it.

    All agree on the `core` bytes from `at`. A shared window has at least half of its other bytes on one side of
    those, so two contexts that share it agree on that many bytes left or right.
    """
    more = (length - core) // 2
    ends = [(("l", raw[at - more : at]) if at >= more else None, ("r", raw[at + core : at + core + more]) if len(raw) >= at + core + more else None) for raw, *_, at in rows]
    seen = Counter(x for e in ends for x in e if x)
    return [r for r, e in zip(rows, ends, strict=True) if any(x and seen[x] > 1 for x in e)]


def by_suffix_array(contexts: DataFrame, length: int, core: int, packs: int) -> DataFrame:
    """Marked byte ranges of contexts (group, doc_id, text_hash, first, at, bytes) that share `core` bytes by group.

    Equal windows are always in one group. Groups are dealt to `packs` packs; in one, whole groups share a suffix
    array until it has ARRAY_BYTES.
    """

    def mark(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        groups: dict[int, list[Row]] = {}
        for group, *row in zip(df["group"].tolist(), df["bytes"], *(df[c].tolist() for c in (*DOC, "first", "at")), strict=True):
            groups.setdefault(group, []).append(tuple(row))
        together: list[Row] = []
        n_bytes, last = 0, len(groups) - 1
        for k, members in enumerate(groups.values()):
            rows = partners(members, length, core)
            together += rows
            n_bytes += sum(len(r[0]) for r in rows)
            if together and (n_bytes >= ARRAY_BYTES or k == last):
                found = repeats([(raw, at, doc) for raw, *doc, at in together], length)
                out += [(r[1], r[2], r[3] + a, r[3] + b + length - 1) for r, ranges in zip(together, found, strict=True) for a, b in ranges]
                together, n_bytes = [], 0
        return pd.DataFrame(out, columns=[x.split()[0] for x in MARK.split(", ")]).astype("int64")

    # A number of partitions of its own, which Spark doesn't merge: else a few tasks would get all arrays.
    named = contexts.select(F.pmod(F.xxhash64("group"), F.lit(packs)).alias("pack"), "group", *DOC, "first", "at", "bytes")
    return named.repartition(packs, "pack").groupBy("pack").applyInPandas(mark, MARK)


def longer_core(contexts: DataFrame, core: int, more: int, length: int) -> DataFrame:
    """Contexts whose group shares `core` bytes, cut into those whose group shares `more` bytes in front as well and
    those whose group shares them behind. Each window falls to one of the two: to the first where it begins `more`
    bytes or further before the core."""
    at, first, windows = F.col("at"), F.col("first"), F.col("windows")
    before = F.greatest(F.lit(0), F.least(windows, at - more + 1))  # windows that hold the bytes in front
    # Of the others those that hold the bytes behind: all, as 2 * more <= length - core + 1, if the context has any.
    part = lambda which, skip, n, shared, key: contexts.select(F.xxhash64("group", F.lit(which), key).alias("group"), *DOC, (first + skip).cast("int").alias("first"), n.cast("int").alias("windows"), shared.cast("int").alias("at"), F.substring("bytes", skip + 1, n + (length - 1)).alias("bytes")).filter("windows > 0")
    front = part("l", F.lit(0), before, at - more, F.substring("bytes", at - more + 1, F.lit(more)))
    behind = part("r", before, windows - before, at - before, F.substring("bytes", at + core + 1, F.lit(more)))
    return front.unionByName(behind)


def marked_ranges(texts: DataFrame, length: int = LENGTH, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """(doc_id, text_hash, start, end): byte ranges of texts (doc_id, text_hash, text; equal rows are one) covered by an
    earlier string of `length` bytes.

    Windows meet under their anchors; runs whose anchor occurs once are dropped first. Of equal contexts the first
    keeps its windows and all others are marked whole. Of contexts that differ, only those can share a window that
    agree left or right of the anchor: they form groups, whose members are compared in a suffix array. A group of
    more than group_contexts different ones is split by longer shared bytes, half of what is left each time, and
    equal contexts are settled again: at the latest when a context is one window, none is left. Counts are partial
    aggregates and joins split skewed keys, so nothing that one task holds grows with the corpus.
    """
    side = side_of(length)
    repeated = materialize(anchor_rows(texts, length, alone=True).groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    rows = materialize(anchor_rows(texts, length).join(repeated, "anchor", "left_semi"), "runs")
    distinct = materialize(rows.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct(*DOC, "first", "place", "windows", "left", "right")).alias("f")).select("anchor", "context", "n", "f.*"), "contexts")
    parts = [_all_but_first(rows, distinct, ["anchor", "context"], length)]
    halves = []
    last = F.col("first") + F.col("windows") - 1
    for which, start, end, shared in (("left", F.col("first"), F.least(last, F.col("place") - side), F.col("place") - side), ("right", F.greatest(F.col("first"), F.col("place") - side + 1), last, F.col("place"))):
        have = distinct.filter(F.col(which) != 0)
        many = have.groupBy("anchor", which).agg(F.count("*").alias("k")).filter("k > 1").drop("k")
        half = have.join(many, ["anchor", which], "left_semi").select(*DOC, F.xxhash64(F.lit(which), "anchor", which).alias("group"), start.alias("first"), (end - start + 1).alias("windows"), (shared - start).alias("at"))
        halves.append(half.filter("windows > 0"))
    cuts = halves[0].unionByName(halves[1]).groupBy(*DOC).agg(F.collect_list(F.struct("group", "first", "windows", "at")).alias("cuts"))
    contexts, core = cut_contexts(cuts, texts, length), side + GRAM
    while True:
        contexts = materialize(contexts.withColumn("context", F.xxhash64("bytes")), "cuts")
        once = materialize(contexts.groupBy("group", "context").agg(F.count("*").alias("n"), F.min(F.struct(*DOC, "first", "windows", "at", "bytes")).alias("f")).select("group", "context", "n", "f.*"), "halves")
        parts.append(_all_but_first(contexts.drop("bytes"), once.drop("bytes"), ["group", "context"], length))
        many = materialize(once.groupBy("group").agg(F.count("*").alias("k"), F.sum(F.length("bytes")).alias("size")).filter("k > 1"), "groups")
        differing = once.select("group", *DOC, "first", "windows", "at", "bytes").join(many, "group")
        small = F.col("k") <= group_contexts
        total = many.agg(F.sum(F.when(small, F.col("size"))).alias("b"), F.sum(F.when(~small, 1)).alias("large")).first()
        if total["b"]:
            parts.append(by_suffix_array(differing.filter(small), length, core, max(64, total["b"] // PACK_BYTES)))
        if not total["large"] or core >= length:
            break
        more = max(1, (length - core) // 2)
        contexts, core = longer_core(differing.filter(~small), core, more, length), core + more
    return reduce(DataFrame.unionByName, parts)


def _all_but_first(rows: DataFrame, distinct: DataFrame, key: list[str], length: int) -> DataFrame:
    copies = distinct.filter("n > 1").select(*key, F.struct(*DOC, "first").alias("f"))
    return rows.join(copies, key).filter(F.struct(*DOC, "first") != F.col("f")).select(*DOC, F.col("first").cast("long").alias("start"), (F.col("first") + F.col("windows") + length - 1).cast("long").alias("end"))


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def remove(docs: DataFrame, *, length: int = LENGTH, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans for docs (doc_id, text).

    A byte goes if a string of `length` bytes covers it that also starts earlier: in an earlier document, or in the
    same one further left. spans are the maximal removed runs, in bytes. Documents come by doc_id, null last; rows
    with one doc_id (or none) and different texts are documents of their own, ordered by a hash of the text, and rows
    with one doc_id and text are one document and get equal results. Texts of fewer than `length` bytes lose nothing.
    Null text: as empty. Equal texts are settled first: all but the first document go whole. Empty tables give empty
    results; further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    keyed = base.select("doc_id", F.sha2("text", 256).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"))
    owner = materialize(keyed.filter(F.col("n_bytes") >= length).groupBy("key").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies")), "owners")
    copied = materialize(owner.filter("copies > 1").select("key", "owner"), "copied")
    if copied.count() <= BROADCAST_KEYS:  # about 100 bytes each, so that texts stay where they are; else shuffled
        copied = F.broadcast(copied)
    with_key = base.withColumn("key", F.sha2("text", 256)).join(copied, "key", "left")
    with_key = with_key.withColumn("is_copy", F.col("owner").isNotNull() & (F.col("doc_id") != F.col("owner")))
    unique = with_key.filter(~F.col("is_copy") & (F.octet_length("text") >= length)).select(*DOC, "text")
    ranges = materialize(marked_ranges(unique, length, group_contexts).groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges")), "marks")

    @F.pandas_udf(RESULT)
    def cut(texts: pd.Series, is_copy: pd.Series, marks: pd.Series) -> pd.DataFrame:
        out = []
        for t, all_of_it, found in zip(texts, is_copy, marks, strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            spans: list[list[int]] = [[0, len(raw)]] if all_of_it else []
            for r in found if not all_of_it and found is not None else ():
                if spans and r["start"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r["end"])
                else:
                    spans.append([r["start"], r["end"]])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out.append((len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    marked = with_key.select("id", *DOC, "text", "is_copy").join(ranges, list(DOC), "left")
    return marked.select(F.col("id").alias("doc_id"), cut(F.col("text"), F.col("is_copy"), F.col("ranges")).alias("c")).select("doc_id", "c.*")
