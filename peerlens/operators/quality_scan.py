"""Rules that flag doubtful data, as one table of flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flags(rules: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """code, entity, detail of each row that a rule (code, table, entity, condition) finds."""
    return reduce(DataFrame.unionByName, [t.filter(cond).select(F.lit(code).alias("code"), entity.cast("string").alias("entity")) for code, t, entity, cond in rules])


def off_total(rows: DataFrame, keys: list[str], value: str, expected: Column, tolerance: float = 0.05) -> DataFrame:
    """Groups whose sum is off the expected total by more than the tolerance (HAVING)."""
    return rows.groupBy(*keys).agg(F.sum(value).alias("total"), expected.alias("expected")).filter(F.abs(F.col("total") - F.col("expected")) > tolerance * F.col("expected"))


def counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("code").agg(F.count("*").alias("n"))


CODES = ("missing_date_of_birth", "small_sample_season", "single_team_coverage", "pending_identity_review", "match_minutes_mismatch")
SMALL_SAMPLE = 270
FLAGS = ("entity_type", "entity_id", "season_id", "code", "severity", "details")


def scan(players: DataFrame, season_stats: DataFrame, seasons: DataFrame, reviews: DataFrame, appearances: DataFrame, matches: DataFrame, *, tolerance: float = 0.05) -> DataFrame:
    """entity_type, entity_id, season_id, code, severity, details (map of text) of all that five rules find.

    players (player_id, born, merged_into): no date of birth, unless merged into another. season_stats (player_id, season_id,
    minutes): under 270 minutes. seasons (season_id, coverage, note): coverage of a single team. reviews (candidate_id,
    player_id, source_player_id, score, status): pending ones. appearances (match_id, team_id, minutes) and matches
    (match_id, regulation): a team's minutes off 11 times the match's by more than 5 %. A reader replaces open flags by
    these. Rules read each table once; the appearances are summed by match and team in the task first.
    """
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")

    def flag(df: DataFrame, kind: str, entity: str, code: str, severity: str, details: dict[str, Column], season: str | None = None) -> DataFrame:
        of = F.create_map(*[x for k, v in details.items() for x in (F.lit(k), v.cast("string"))])
        at = F.col(season).cast("long") if season else F.lit(None).cast("long")
        return df.select(F.lit(kind).alias("entity_type"), F.col(entity).cast("long").alias("entity_id"), at.alias("season_id"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), of.alias("details"))

    sums = appearances.groupBy("match_id", "team_id").agg(F.sum("minutes").alias("total")).join(matches.select("match_id", (11 * F.col("regulation")).alias("expected")), "match_id")
    off = sums.filter(F.abs(F.col("total") - F.col("expected")) > tolerance * F.col("expected"))
    found = [
        flag(players.filter("born is null and merged_into is null"), "player", "player_id", "missing_date_of_birth", "info", {"effect": F.lit("age unavailable; excluded from age-filtered searches")}),
        flag(season_stats.filter(F.col("minutes") < SMALL_SAMPLE), "player", "player_id", "small_sample_season", "warning", {"minutes": text("minutes"), "threshold": F.lit(SMALL_SAMPLE)}, "season_id"),
        flag(seasons.filter("coverage = 'single_team'"), "season", "season_id", "single_team_coverage", "warning", {"note": text("note"), "effect": F.lit("excluded from percentile pools")}, "season_id"),
        flag(reviews.filter("status = 'pending'"), "player", "player_id", "pending_identity_review", "info", {"candidate_id": text("candidate_id"), "source_player_id": text("source_player_id"), "score": text("score")}),
        flag(off, "match", "match_id", "match_minutes_mismatch", "warning", {"team_id": text("team_id"), "team_minutes": text("total"), "expected": text("expected")}),
    ]
    return reduce(DataFrame.unionByName, found)


def replace_open(current: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """current (columns of flags, created_at, resolved_at) with the open flags of the scan's codes replaced by found; resolved
    ones and other codes stay."""
    kept = current.filter(F.col("resolved_at").isNotNull() | ~F.col("code").isin(*CODES))
    return kept.unionByName(found.select(*FLAGS).withColumns({"created_at": now, "resolved_at": F.lit(None).cast("timestamp")}))
