"""Mid-rank percentiles against member pools, with a hierarchy of ever wider pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import POOL_MIN_SIZE
from ..functions.storage import written


# Distinct values of a pool beyond which its values are cut into parts that are ranked apart.
LARGE_POOL = 200_000


def value_cuts(rows: DataFrame, value: str, buckets: int = 64) -> list[float]:
    """Values that cut the column into about equal parts. They decide how work is split, not any result."""
    cuts = rows.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1000)).first()[0]
    return sorted(set(cuts or []))


def counted_values(rows: DataFrame, keys: list[str], value: str, member: str = "is_member") -> DataFrame:
    """keys, value, equal: members of each pool at each value; repeated values of a hot pool are summed before the shuffle."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.col(member).cast("long")).alias("equal"))


def ranked_values(counts: DataFrame, keys: list[str], value: str, cuts: list[float] | None = None) -> DataFrame:
    """counts (of counted_values) with n, members of the pool, and below, those below the value.

    A window sees a row per distinct value and pool. cuts (see value_cuts) also split a pool's distinct values: each part
    is ranked on its own, from the sum of the parts before it, so that a pool of all rows is many tasks.
    """
    if not cuts:
        up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumns({"below": F.coalesce(F.sum("equal").over(up), F.lit(0)), "n": F.sum("equal").over(Window.partitionBy(*keys))})
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value)))
    counts = counts.withColumn("__part", part)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(*keys, "__part").agg(F.sum("equal").alias("__sum"))
    parts = parts.withColumns({"__before": F.coalesce(F.sum("__sum").over(before), F.lit(0)), "n": F.sum("__sum").over(Window.partitionBy(*keys))}).drop("__sum")
    up = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("__up", F.coalesce(F.sum("equal").over(up), F.lit(0))).join(parts, [*keys, "__part"])
    return ranked.withColumn("below", F.col("__before") + F.col("__up")).drop("__part", "__before", "__up")


def mid_rank(rows: DataFrame, keys: list[str], value: str, member: str = "is_member", cuts: list[float] | None = None) -> DataFrame:
    """Adds n, and below and equal: members of the pool (keys) below and at the value. cuts: see ranked_values."""
    return rows.join(ranked_values(counted_values(rows, keys, value, member), keys, value, cuts), [*keys, value])


def percentile(lower_better: Column | bool = False) -> Column:
    p = 100.0 * (F.col("below") + 0.5 * F.col("equal")) / F.col("n")
    flip = lower_better if isinstance(lower_better, Column) else F.lit(lower_better)
    return F.when(F.col("n") > 0, F.when(flip, 100.0 - p).otherwise(p))


def pool_percentiles(rows: DataFrame, *, group: list[str], year: str, band: str, value: str, member: str = "is_member", ids: list[str], min_size: int = POOL_MIN_SIZE, levels: tuple[int, ...] = (1, 2, 3, 4), lower_better: Column | bool = False, large: int = LARGE_POOL) -> DataFrame:
    """ids, level, pool_n, percentile: at the first level whose pool has min_size members; else no row.

    Level 1: group, year and band; 2: years from one before to one after, band; 3: group and year; 4: group.
    A member counts in its own pools and in three windows of years; a non-member is only ranked. The widest pools hold
    all rows of a group: where one has more than `large` distinct values, values are cut into parts that are ranked apart.
    """
    own = F.array(
        *[
            x
            for k, x in (
                (1, F.struct(F.lit(1).alias("level"), F.col(year).cast("int").alias("pool_year"), F.col(band).alias("pool_band"), F.lit(True).alias("asks"))),
                (2, F.struct(F.lit(2).alias("level"), F.col(year).cast("int").alias("pool_year"), F.col(band).alias("pool_band"), F.lit(True).alias("asks"))),
                (3, F.struct(F.lit(3).alias("level"), F.col(year).cast("int").alias("pool_year"), F.lit("ALL").alias("pool_band"), F.lit(True).alias("asks"))),
                (4, F.struct(F.lit(4).alias("level"), F.lit(0).alias("pool_year"), F.lit("ALL").alias("pool_band"), F.lit(True).alias("asks"))),
            )
            if k in levels
        ]
    )
    near = F.array(*[F.struct(F.lit(2).alias("level"), (F.col(year).cast("int") + d).alias("pool_year"), F.col(band).alias("pool_band"), F.lit(False).alias("asks")) for d in (-1, 1)])
    keyed = rows.filter(F.col(value).isNotNull()).withColumn("k", F.explode(F.when(F.col(member), F.concat(own, near)).otherwise(own) if 2 in levels else own)).select("*", "k.level", "k.pool_year", "k.pool_band", "k.asks").drop("k")
    keys = [*group, "level", "pool_year", "pool_band"]
    # Written once, as the rows come out of joins: they are counted, and those that ask are joined with the ranks.
    keyed = keyed.withColumn("__flip", lower_better if isinstance(lower_better, Column) else F.lit(lower_better))
    keyed = written(keyed.select(*keys, value, member, "asks", "__flip", *[c for c in ids if c not in (*keys, value, member)]), "pool-rows")
    counts = written(counted_values(keyed, keys, value, member), "pool-values")
    is_large = not counts.groupBy(*keys).agg(F.count("*").alias("c")).filter(F.col("c") > large).isEmpty()
    ranks = ranked_values(counts, keys, value, value_cuts(counts, value) if is_large else None).filter(F.col("n") >= min_size)
    ranked = keyed.filter("asks").join(ranks, [*keys, value])
    best = F.min_by(F.struct("level", F.col("n").alias("pool_n"), percentile(F.col("__flip")).alias("percentile")), "level")
    return ranked.groupBy(*ids).agg(best.alias("r")).select(*ids, "r.*")
