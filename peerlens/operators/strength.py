"""League strength: score, band, adjustment, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C


def strength_scores(leagues: DataFrame, coefficients: DataFrame) -> DataFrame:
    """leagues + score and basis (measured or prior); leagues without either have no row.

    leagues: gender, year, country, tier, prior (null if none). coefficients: gender, year, country, points.
    """
    best = coefficients.groupBy("gender", "year").agg(F.max("points").alias("top"))
    part = F.try_divide(F.col("points"), F.col("top"))
    x = leagues.join(coefficients, ["gender", "year", "country"], "left").join(best, ["gender", "year"], "left")
    tiers = F.create_map(*[v for k, m in C.TIER_MULTIPLIER.items() for v in (F.lit(k), F.lit(m))])
    tier = F.coalesce(F.element_at(tiers, F.coalesce(F.col("tier"), F.lit(1))), F.lit(1.0))
    raw = F.coalesce(part * tier, F.col("prior"))
    return x.filter(raw.isNotNull()).withColumns({"score": F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 4), "basis": F.when(part.isNotNull(), "measured").otherwise("prior")}).drop("points", "top")


def band(score: Column, tournament: Column | None = None) -> Column:
    b = F.when(score.isNull(), "NA")
    for name, cut in C.BAND_CUTS:
        b = b.when(score >= cut, name)
    b = b.otherwise("D")
    return b if tournament is None else F.when(tournament, "INTL").otherwise(b)


def adjusted(value: Column, score: Column, family: Column) -> Column:
    k = F.create_map(*[v for f, e in C.ADJUST_EXPONENT.items() for v in (F.lit(f), F.lit(e))])
    return value * F.pow(score, F.coalesce(F.element_at(k, family), F.lit(0.0)))


def ranking(scored: DataFrame, *, by: tuple[str, ...] = (), top: int = 3, near: float = 0.01) -> DataFrame:
    """The first `top` by score, of each value of `by`, with a flag where the next is nearer than `near`."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "country")
    x = scored.withColumns({"rank": F.row_number().over(w), "gap": F.col("score") - F.lead("score").over(w)}).filter(F.col("rank") <= top)
    return x.withColumn("near_tie", (F.col("rank") == top) & F.coalesce(F.col("gap") < near, F.lit(False))).drop("gap")
