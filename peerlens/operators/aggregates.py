"""Roll-ups from matches to seasons, rates, positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.constants import NOT_PER_90, RATES, SAVE_PCT
from ..functions.stats import per_90, ratio_pct


def roll_up(rows: DataFrame, keys: list[str], subkey: str, sums: dict[str, Column], rates: dict[str, tuple[str, str]]) -> DataFrame:
    """Sums per keys + subkey and per keys (subkey null), rates recomputed at each level from the sums.

    One scan and one shuffle for both levels (grouping sets); rates are never averaged.
    """
    named = rows.select(*keys, subkey, *[c.alias(n) for n, c in sums.items()])
    out = named.groupingSets([[*keys, subkey], keys], *keys, subkey).agg(F.grouping(subkey).alias("is_total"), *[F.sum(n).alias(n) for n in sums])
    return out.withColumns({n: ratio_pct(F.col(a), F.col(b)) for n, (a, b) in rates.items()})


PLAYING = ("minutes", "minutes_elapsed", "appearances", "starts", "yellow_cards", "red_cards")


def season_base(appearances: DataFrame, stats: DataFrame) -> DataFrame:
    """player_id, season_id, team_id, code, value: sums of what was played and done.

    An appearance is shuffled as one row and becomes six codes behind the shuffle, which is by player and season: all sums
    of a season, its rates and its source then need no other.
    """
    keys = ["player_id", "season_id", "team_id"]
    played = {
        "minutes": F.col("minutes").cast("double"),
        "minutes_elapsed": F.col("minutes_elapsed").cast("double"),
        "appearances": (F.col("minutes") > 0).cast("double"),
        "starts": F.col("started").cast("double"),
        "yellow_cards": F.col("yellow_cards").cast("double"),
        "red_cards": F.col("red_card").cast("double"),
    }
    was_played = [F.coalesce(played[c], F.lit(0.0)).alias(c) for c in PLAYING]
    rows = appearances.select(*keys, F.lit(None).cast("string").alias("code"), F.lit(None).cast("double").alias("value"), F.struct(*was_played).alias("played"))
    rows = rows.unionByName(stats.select(*keys, F.struct("code", F.col("value").cast("double").alias("value")).alias("s")).select(*keys, "s.code", "s.value"), allowMissingColumns=True).repartition("player_id", "season_id")
    codes = F.array(*[F.struct(F.lit(c).alias("code"), F.col(f"played.{c}").alias("value")) for c in PLAYING])
    long = rows.select(*keys, F.explode(F.when(F.col("played").isNotNull(), codes).otherwise(F.array(F.struct("code", "value")))).alias("c")).select(*keys, "c.*")
    return long.groupBy(*keys, "code").agg(F.sum("value").alias("value"))


def _with_rates(base: DataFrame, ids: list[str], source: DataFrame) -> DataFrame:
    """ids, code, value, is_rate, minutes, appearances, source_id: sums of base and the rates out of them; no rate without a
    denominator. Nothing is shuffled but the base, by player and season."""
    needed = sorted({c for pair in RATES.values() for c in pair} | {*SAVE_PCT, "minutes", "appearances"})
    wide = base.groupBy(*ids).agg(*[F.coalesce(F.sum(F.when(F.col("code") == c, F.col("value"))), F.lit(0.0)).alias(c) for c in needed])
    saves, conceded = (F.col(c) for c in SAVE_PCT)
    rates = {n: ratio_pct(F.col(a), F.col(b)) for n, (a, b) in RATES.items()} | {"gk_save_pct": ratio_pct(saves, saves + conceded)}
    of = wide.select(*ids, F.col("minutes").alias("__m"), F.col("appearances").alias("__a"), *[c.alias(n) for n, c in rates.items()])
    long = of.unpivot([*ids, "__m", "__a"], list(rates), "code", "value").filter("value is not null").withColumn("is_rate", F.lit(True))
    total = Window.partitionBy(*ids)
    known = [F.col(c).isNotNull() for c in ids]
    sums = base.filter(reduce(lambda a, b: a & b, known)).groupBy(*ids, "code").agg(F.sum("value").alias("value")).withColumn("is_rate", F.lit(False))
    sums = sums.withColumns({n: F.coalesce(F.sum(F.when(F.col("code") == c, F.col("value"))).over(total), F.lit(0.0)) for n, c in (("__m", "minutes"), ("__a", "appearances"))})
    sourced = lambda df: df.join(source, ["player_id", "season_id"], "left")
    return sourced(sums).unionByName(sourced(long)).withColumnsRenamed({"__m": "minutes", "__a": "appearances"})


def season_tables(appearances: DataFrame, stats: DataFrame, *, run: str, timestamp: Column) -> dict[str, DataFrame]:
    """The four tables of a season: team_stats, season_stats, observations and positions.

    appearances: player_id, season_id, team_id, match_id, day, minutes, minutes_elapsed, started, yellow_cards, red_card,
    minutes_by_position (map of code to minutes), source_id. stats: player_id, season_id, team_id, code, value. Rates are
    made of sums, never averaged, at both levels; values have 4 decimals, minutes 2, per90 5. A player's source is that
    of the last appearance. run names the observations' run, timestamp is when their source was read. Empty inputs give
    empty tables; players with statistics but no appearance have no source and minutes of 0.
    """
    ids = ["player_id", "season_id"]
    base = season_base(appearances, stats)
    source = appearances.groupBy(*ids).agg(F.max(F.struct("day", "match_id", "source_id"))["source_id"].alias("source_id"))

    def rounded(df: DataFrame) -> DataFrame:
        return df.withColumns({"value": F.round("value", 4), "minutes": F.round("minutes", 2), "appearances": F.col("appearances").cast("int")})

    team = rounded(_with_rates(base, [*ids, "team_id"], source).drop("is_rate"))
    season = _with_rates(base, ids, source)
    counted = ~F.col("is_rate") & ~F.col("code").isin(*NOT_PER_90) & (F.col("minutes") > 0)
    season = rounded(season.withColumn("per90", F.when(counted, F.round(per_90(F.col("value"), F.col("minutes")), 5)))).drop("is_rate")
    season = season.withColumns({"resolution_rule": F.lit("single_source"), "has_conflict": F.lit(False)})
    observations = season.select(
        *ids, F.lit(None).cast(base.schema["team_id"].dataType).alias("team_id"), "code", "value", F.col("minutes").alias("minutes_basis"), "source_id",
        timestamp.alias("source_timestamp"), F.lit("event_derived").alias("data_quality"), F.concat(F.lit("events (season "), F.col("season_id").cast("string"), F.lit(")")).alias("raw_ref"), F.lit(run).alias("run"),
    )
    by_code = map_sum(appearances, ids, "minutes_by_position").filter(~F.col("code").startswith("unknown"))
    places = positions(by_code, C.POSITION_SECOND_SHARE, C.POSITION_SECOND_MINUTES).join(source, ids, "left")
    return {"team_stats": team, "season_stats": season, "observations": observations, "positions": places}


def map_sum(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, code, value: a map column summed per key of the map."""
    return rows.select(*keys, F.explode(column).alias("code", "value")).groupBy(*keys, "code").agg(F.sum("value").alias("value"))


def positions(by_code: DataFrame, min_share: float = C.POSITION_SECOND_SHARE, min_minutes: float = C.POSITION_SECOND_MINUTES) -> DataFrame:
    """player_id, season_id, code, minutes, share, rank, confidence: primary position, and a secondary one of enough share
    and minutes. Of equal shares the code last in order comes first. Confidence is high for 900 minutes and half of them
    in the primary position, else medium."""
    keys = ["player_id", "season_id"]
    everything = Window.partitionBy(*keys)
    shared = by_code.filter("value > 0").withColumn("total", F.sum("value").over(everything)).withColumn("share", F.col("value") / F.col("total"))
    sure = (F.col("total") >= C.POSITION_SURE_MINUTES) & (F.max("share").over(everything) >= C.POSITION_SURE_SHARE)
    ranked = shared.withColumns({"rank": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("share"), F.desc("code"))), "confidence": F.when(sure, "high").otherwise("medium")})
    kept = ranked.filter((F.col("rank") == 1) | ((F.col("rank") == 2) & (F.col("share") >= min_share) & (F.col("value") >= min_minutes)))
    return kept.drop("total").withColumnRenamed("value", "minutes")


def latest_with_ties(rows: DataFrame, key: str, order: str) -> DataFrame:
    """All rows of the highest order per key; ties stay."""
    return rows.join(rows.groupBy(key).agg(F.max(order).alias(order)), [key, order], "left_semi")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def coverage(matches: DataFrame, kinds: DataFrame) -> DataFrame:
    """season_id, coverage from matches (season_id, match_id, home_team, away_team) and kinds (season_id, kind)."""
    sides = matches.select("season_id", "match_id", F.explode(F.array("home_team", "away_team")).alias("team"))
    per_team = sides.groupBy("season_id", "team").agg(F.count("*").alias("c"))
    teams = per_team.groupBy("season_id").agg(F.count("*").alias("n_teams"), F.max("c").alias("most"))
    n = matches.groupBy("season_id").agg(F.count("*").alias("n_matches"))
    x = kinds.join(teams, "season_id").join(n, "season_id")
    full = F.col("n_matches") >= 0.8 * F.col("n_teams") * (F.col("n_teams") - 1)
    return x.withColumn(
        "coverage",
        F.when(F.col("kind").isin("international_national", "youth"), "tournament")
        .when((F.col("most") == F.col("n_matches")) & (F.col("n_teams") > 2), "single_team")
        .when((F.col("kind") == "domestic_league") & (F.col("n_teams") > 2), F.when(full, "full_league").otherwise("partial"))
        .when((F.col("kind") == "international_club") & (F.col("n_matches") < 10), "partial")
        .otherwise("tournament"),
    )
