"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words_of

CELLS = 4096
HEAVY = 1024
DIMS = ("bytes", "tokens", "rows")


def pack(items: list[tuple], n_shards: int) -> list[int]:
    """Shard of each item, a tuple of loads. Items go in descending norm to the shard whose residual
    capacity has the largest dot product with the item; ties go to the lowest shard.

    The driver packs at most CELLS + HEAVY items whatever the input's size.
    """
    if not items:
        return []
    total = [sum(x) or 1 for x in zip(*items, strict=True)]
    unit = [[v / t for v, t in zip(x, total, strict=True)] for x in items]
    left = [[1.0 / n_shards] * len(total) for _ in range(n_shards)]
    chosen = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-sum(v * v for v in unit[i]), i)):
        x = unit[i]
        k = max(range(n_shards), key=lambda s: (sum(a * b for a, b in zip(x, left[s], strict=True)), -s))
        chosen[i] = k
        left[k] = [a - b for a, b in zip(left[k], x, strict=True)]
    return chosen


def shard(docs: DataFrame, n_shards: int, *, cells: int = CELLS, heavy: int = HEAVY, rows_per_run: int = 50_000) -> DataFrame:
    """Columns of docs plus size, text_crc32, shard and slot.

    Groups of equal texts stay together. Groups are dealt by hash into `cells` cells; a group with more than
    1 / heavy of all bytes or rows (so fewer than 2 * heavy can exist) is an item of its own. Only the loads
    of cells and heavy groups reach the driver. A group above 1 / (4 * n_shards) of the whole can't be
    balanced as one piece: it is cut into that many pieces by doc_id, each an item. Cells, not single groups, are
    the unit of packing: their number is fixed, so neither the driver's work nor its memory grows with the texts, and
    a row finds its shard without a join; what balance this costs is measured in README. Slots count from 0 in
    each shard without a gap, in order of runs (a hash of doc_id) and doc_id: a run has about rows_per_run
    rows, so no task sorts a shard.

    Null text: size 1, text_crc32 0, grouped with other null texts. Repeated rows are rows of one group
    with slots of their own. Empty tables give empty results. Columns named as the new ones are replaced.
    """
    docs = docs.drop("size", "text_crc32", "shard", "slot")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "*",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.col("text").isNull(), text).alias("__group"),
        n_words_of(F.col("text")).alias("__tokens"),
    )
    loads = (F.sum("size").alias("bytes"), F.sum("__tokens").alias("tokens"), F.count("*").alias("rows"))
    # A short row per distinct text; everything below but the final numbering is computed from it.
    groups = materialize(base.groupBy("__group").agg(*loads), "shard-groups")
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    all_bytes, all_rows = total["bytes"] or 0, total["rows"] or 0
    part = F.greatest(F.col("bytes") / F.lit(float(max(all_bytes, 1))), F.col("rows") / F.lit(float(max(all_rows, 1))))
    pieces_of = {r["__group"]: max(1, math.ceil(r["part"] * 4 * n_shards)) for r in groups.select("__group", part.alias("part")).filter(F.col("part") > 1.0 / heavy).collect()}
    key = F.col("__group")
    cut = [k for k, n in pieces_of.items() if n > 1]
    of = F.coalesce(F.element_at(_int_map(pieces_of), key), F.lit(0)) if pieces_of else F.lit(0)
    marks = {"__heavy": of > 0, "__cell": F.when(of > 0, key).otherwise(F.pmod(key, F.lit(cells)))}
    piece = F.pmod(F.xxhash64("doc_id"), F.greatest(of, F.lit(1))).cast("int")
    by = ("__heavy", "__cell", "__piece")
    items = groups.filter(~key.isin(cut)).withColumns(marks | {"__piece": F.lit(0)}).groupBy(*by).agg(*[F.sum(c).alias(c) for c in DIMS])
    if cut:
        items = items.unionByName(base.filter(key.isin(cut)).withColumns(marks | {"__piece": piece}).groupBy(*by).agg(*loads))
    items = items.orderBy(*by).collect()
    base = base.withColumns(marks | {"__piece": piece})
    chosen = pack([tuple(r[c] for c in DIMS) for r in items], n_shards)
    by_cell = [0] * cells
    by_heavy = {}
    for r, k in zip(items, chosen, strict=True):
        if r["__heavy"]:
            by_heavy[f"{r['__cell']}:{r['__piece']}"] = k
        else:
            by_cell[r["__cell"]] = k
    # At most cells + 2 * heavy entries, as constants of the plan.
    ring = F.split(F.lit(",".join(map(str, by_cell))), ",").cast("array<int>")
    where = F.get(ring, F.col("__cell").cast("int")) if not by_heavy else F.when(F.col("__heavy"), F.element_at(F.str_to_map(F.lit(",".join(f"{k}={v}" for k, v in by_heavy.items())), F.lit(","), F.lit("=")), F.concat_ws(":", F.col("__cell"), F.col("__piece"))).cast("int")).otherwise(F.get(ring, F.pmod(F.col("__cell"), F.lit(cells)).cast("int")))
    placed = base.withColumn("shard", where).drop("__group", "__tokens", "__heavy", "__cell", "__piece")
    return with_slots(placed, max(1, math.ceil(all_rows / rows_per_run / n_shards)))


def _int_map(d: dict[int, int]) -> Column:
    return F.str_to_map(F.lit(",".join(f"{k}={v}" for k, v in d.items())), F.lit(","), F.lit("=")).cast("map<bigint,int>")


def with_slots(placed: DataFrame, runs: int) -> DataFrame:
    """slot: a number from 0 without gaps in each shard, made of a run's offset and the place in the run."""
    runs = max(8, runs)
    placed = placed.withColumn("__run", F.pmod(F.xxhash64(F.lit("run"), F.col("doc_id"), F.col("text_crc32")), F.lit(runs)))
    before = Window.partitionBy("shard").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "__run").agg(F.count("*").alias("n")).select("shard", "__run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("shard", "__run").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("__n", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(offsets, ["shard", "__run"]).withColumn("slot", F.col("__offset") + F.col("__n")).drop("__run", "__n", "__offset")
