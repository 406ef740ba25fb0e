"""Rank-normal scores, profile vectors and quantile grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.stats import clipped, inverse_normal
from .percentiles import mid_rank

GRID = [i / 20 for i in range(21)]


def rank_normal(rows: DataFrame, keys: list[str], value: str, member: str = "is_member") -> DataFrame:
    """Adds z: the normal score of the mid-rank among the members of the pool. Null values, or pools without a
    member, give no row."""
    r = mid_rank(rows, keys, value, member).filter("n > 0")
    return r.withColumn("p", clipped((F.col("below") + 0.5 * F.col("equal")) / F.col("n"))).withColumn("z", inverse_normal("p"))


def quantile_grid(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(g) for g in GRID])).alias("grid")).withColumn("grid", F.transform("grid", lambda x: F.round(x, 5)))


def profile_vectors(scores: DataFrame, ids: list[str], layout: str = C.FEATURES, size: int = C.VECTOR_SIZE) -> DataFrame:
    """ids, vector (size numbers, missing ones 0), completeness (present weight over all, 3 digits).

    scores: ids, code, z. A pivot over the layout's fixed list, so one shuffle and no discovery of codes.
    """
    f = C.features(layout)
    wide = scores.groupBy(*ids).pivot("code", [c for _, c, _ in f]).agg(F.first("z"))
    padding = [F.lit(0.0)] * (size - len(f))
    present = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for _, c, w in f), F.lit(0.0))
    return wide.select(*ids, F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for _, c, _ in f], *padding).alias("vector"), F.round(present / sum(w for *_, w in f), 3).alias("completeness"))
