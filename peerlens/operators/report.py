"""Scouting reports: sentences out of stored numbers, a row per player, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHOWN = 5
FEW_MINUTES = 900


def _number(value: Column, digits: int = 0) -> Column:
    """Halves go to the even digit, as the exact number says, and there are no signs between thousands."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def metric_line(name: Column, value: Column, per90: Column, is_rate: Column, percentile: Column, pool_n: Column) -> Column:
    """"Passes 41.20/90 (83th, pool n=120)"; rates are in percent."""
    size = F.when(is_rate, F.concat(_number(value, 1), F.lit("%"))).otherwise(F.concat(_number(per90, 2), F.lit("/90")))
    return F.concat(name, F.lit(" "), size, F.lit(" ("), _number(percentile), F.lit("th, pool n="), pool_n.cast("string"), F.lit(")"))


def metric_sections(metrics: DataFrame, shown: int = SHOWN) -> DataFrame:
    """player_id, n_metrics, n_ranked, pool, strengths, weaknesses, middle: of each player's metrics.

    metrics: player_id, place (their order), name, family, value, per90, is_rate, percentile, pool, pool_n. Metrics with a
    percentile, but for those of discipline, are ranked: the best and the worst `shown` as lines, equal ones in order.
    middle is the upper median of the percentiles. A player has at most as many rows as there are metrics.
    """
    ranked = F.col("percentile").isNotNull() & (F.col("family") != "discipline")
    line = metric_line(F.col("name"), F.col("value"), F.col("per90"), F.col("is_rate"), F.col("percentile"), F.col("pool_n"))
    per = metrics.groupBy("player_id").agg(
        F.count("*").alias("n_metrics"),
        F.array_sort(F.collect_list(F.when(ranked, F.struct("place", "percentile", line.alias("line"), "pool")))).alias("m"),
    )
    by = lambda sign: F.transform(F.slice(F.array_sort(F.transform("m", lambda x: F.struct((sign * x["percentile"]).alias("p"), x["place"].alias("i"), x["line"].alias("l")))), 1, shown), lambda x: x["l"])
    middle = F.get(F.array_sort(F.transform("m", lambda x: x["percentile"])), F.floor(F.size("m") / 2).cast("int"))
    return per.select("player_id", "n_metrics", F.size("m").alias("n_ranked"), F.get("m", F.lit(0))["pool"].alias("pool"), by(F.lit(-1.0)).alias("strengths"), by(F.lit(1.0)).alias("weaknesses"), middle.alias("middle"))


def reports(seasons: DataFrame, metrics: DataFrame, values: DataFrame) -> DataFrame:
    """player_id and the sections of a report, for each row of seasons.

    seasons: player_id, display_name, position, position_group, nationality, age, minutes, appearances, starts, teams (array),
    competition, season, strength, strength_confidence. values: player_id, value, low, high, confidence, of an active
    model's prediction. What is unknown is said to be unavailable. A player without metrics has a report without
    percentiles; no number is in a text that isn't in these tables.
    """
    none = F.array(F.lit("No percentile pool of sufficient size."))
    x = seasons.join(metric_sections(metrics), "player_id", "left").join(values.select("player_id", F.col("value").alias("__v"), F.col("low").alias("__l"), F.col("high").alias("__h"), F.col("confidence").alias("__c")), "player_id", "left")
    n = F.coalesce("n_ranked", F.lit(0))
    millions = lambda c: F.concat(F.lit("€"), _number(F.coalesce(F.col(c), F.lit(0.0)) / 1e6, 1), F.lit("M"))
    overview = F.concat(
        F.col("display_name"), F.lit(" ("), F.coalesce("position", F.lit("position unknown")), F.lit(", "), F.coalesce("nationality", F.lit("nationality unavailable")),
        F.coalesce(F.concat(F.lit(", age "), F.col("age").cast("string")), F.lit(", age unavailable")), F.lit(") played "), _number(F.col("minutes")), F.lit(" minutes in "),
        F.col("appearances").cast("string"), F.lit(" appearances ("), F.col("starts").cast("string"), F.lit(" starts) for "), F.array_join("teams", " / "), F.lit(" in "), F.col("competition"), F.lit(" "), F.col("season"), F.lit("."),
    )
    profile = F.concat(n.cast("string"), F.lit(" of "), F.coalesce("n_metrics", F.lit(0)).cast("string"), F.lit(" metrics have a percentile within the "), F.coalesce("position_group", F.lit("None")), F.lit(" pool (pool: "), F.coalesce("pool", F.lit("none of sufficient size")), F.lit(")."))
    strength = F.concat(F.lit("League strength "), _number(F.col("strength"), 2), F.lit(" ("), F.coalesce("strength_confidence", F.lit("None")), F.lit("); adjusted values use default exponents (unfitted)."))
    unknown_strength = F.lit("No league-strength score (national-team tournament or no measured input); raw percentiles are against the tournament pool.")
    few = F.concat(F.lit("Sample size "), _number(F.col("minutes")), F.lit(" minutes"), F.when(F.col("minutes") < FEW_MINUTES, " (< 900: treat with caution)").otherwise(""))
    value = F.concat(millions("__v"), F.lit(" (range "), millions("__l"), F.lit("–"), millions("__h"), F.lit(", confidence "), F.coalesce("__c", F.lit("insufficient")), F.lit(")"))
    return x.select(
        "player_id",
        overview.alias("overview"),
        profile.alias("statistical_profile"),
        F.when(n > 0, F.col("strengths")).otherwise(none).alias("key_strengths"),
        F.when(n > 0, F.col("weaknesses")).otherwise(none).alias("weaknesses"),
        F.when(F.col("strength").isNotNull(), strength).otherwise(unknown_strength).alias("league_context"),
        F.when(n > 0, F.concat(F.lit("Median percentile across available metrics: "), _number(F.col("middle")), F.lit("th."))).otherwise("Insufficient comparable players.").alias("performance_level"),
        F.when(F.col("__v").isNotNull(), value).otherwise("Data unavailable: no active model or no prediction").alias("estimated_transfer_value"),
        F.coalesce("__c", F.lit("insufficient")).alias("transfer_value_confidence"),
        F.array(few, F.lit("Percentiles missing where no pool reaches the minimum size"), F.lit("League-adjustment exponents are defaults, not fitted"), F.when(F.col("__v").isNull(), "Transfer value requires licensed historical fees").otherwise("Value intervals are conformal 80% intervals")).alias("model_limitations"),
    )


def with_target(report: DataFrame, found: DataFrame) -> DataFrame:
    """report with similarity_to_target out of a search's results (target, candidate, final): text for each report's player.

    found has the results of one target; a player that isn't among them is said not to be.
    """
    best = found.withColumn("__r", F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("final")))).filter("__r = 1")
    x = report.join(best.select(F.col("candidate").alias("player_id"), F.col("target").alias("__t"), F.col("final").alias("__f")), "player_id", "left")
    said = F.concat(_number(F.col("__f"), 2), F.lit(" to "), F.col("__t").cast("string"))
    return x.withColumn("similarity_to_target", F.coalesce(said, F.lit("Not in the target's candidate set at this minutes threshold."))).drop("__t", "__f")
