"""Scans of raw files: events, lineups, exchange rates, coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clock_minutes
from ..operators.match_metrics import EVENT_SCHEMA

LINEUP = "team_id long, team_name string, lineup array<struct<player_id: long, player_name: string, player_nickname: string, jersey_number: int, country: struct<id: long, name: string>, cards: array<struct<time: string, card_type: string, reason: string, period: int>>, positions: array<struct<position_id: int, position: string, `from`: string, `to`: string, from_period: int, to_period: int, start_reason: string, end_reason: string>>>>"


def _match_of(path) -> F.Column:
    return F.regexp_extract(path, r"(\d+)\.json$", 1).cast("long")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of events per match; the file's name is the match."""
    bare = EVENT_SCHEMA.replace("match_id long,", "", 1)
    return spark.read.schema(bare).json(path, multiLine=True).withColumn("match_id", _match_of(F.col("_metadata.file_name")))


def read_listed(spark: SparkSession, root: str, schema: str, listing: DataFrame, keys: tuple[str, ...] = ("competition_id", "season_id", "match_id"), *, file_format: str = "json", **options) -> DataFrame:
    """Rows of the files under root that a listing names: key columns, then those of schema.

    Files lie in folders of the keys (competition_id=9/season_id=27/match_id=1/...), which are part of each row. The listing
    (one row per key, filtered as one likes) is the small side of a join on them, so Spark reads it first and prunes
    the files by its keys (dynamic partition pruning): what the listing leaves out isn't opened. Keys of the listing
    without files give nothing; repeated ones give each row once.
    """
    found = spark.read.schema(", ".join([*(f"{k} long" for k in keys), schema])).format(file_format).options(**options).load(root)
    wanted = listing.select(*[F.col(k).cast("long").alias(k) for k in keys]).distinct()
    return found.join(F.broadcast(wanted), list(keys), "left_semi").select(*keys, *[c for c in found.columns if c not in keys])


def available_matches(listing: DataFrame, competition_id: int, season_id: int) -> DataFrame:
    """competition_id, season_id, match_id of the season's matches that have data."""
    return listing.filter((F.col("competition_id") == competition_id) & (F.col("season_id") == season_id) & (F.col("match_status") == "available")).select("competition_id", "season_id", "match_id")


def read_lineups(spark: SparkSession, path: str) -> DataFrame:
    """A row per player and position segment; players without one keep a row of nulls."""
    teams = spark.read.schema(LINEUP).json(path, multiLine=True).withColumn("match_id", _match_of(F.col("_metadata.file_name")))
    players = teams.select("match_id", "team_id", F.explode("lineup").alias("p"))
    s = players.select("match_id", "team_id", "p.player_id", "p.player_name", "p.cards", F.explode_outer("p.positions").alias("s"))
    return s.select("match_id", "team_id", "player_id", "player_name", "cards", "s.position_id", clock_minutes(F.col("s.from")).alias("from_min"), clock_minutes(F.col("s.to")).alias("to_min"), "s.from_period", "s.to_period", "s.start_reason")


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Wide exchange rates (Date and a column per currency) as date, currency, rate; what is no number goes."""
    wide = spark.read.csv(path, header=True)
    codes = [c for c in wide.columns if c != "Date" and c.strip() and not c.startswith(("_c", "Unnamed"))]
    long = wide.select(F.col("Date").try_cast("date").alias("date"), *[F.col(f"`{c}`").try_cast("double").alias(c.strip()) for c in codes]).unpivot("date", [c.strip() for c in codes], "currency", "rate")
    return long.filter("date is not null and rate is not null")


def validate_rates(rates: DataFrame, today: str, max_age_days: int = 7) -> DataFrame:
    """rates, or a ValueError if the newest is too old or one is not positive."""
    r = rates.agg(F.max("date").alias("newest"), F.min("rate").alias("least"), F.datediff(F.lit(today).cast("date"), F.max("date")).alias("age")).first()
    if r["newest"] is None or r["age"] > max_age_days or r["least"] <= 0:
        raise ValueError(f"rates: newest {r['newest']}, least {r['least']}")
    return rates


def read_coefficients(spark: SparkSession, path: str, aliases: dict[str, str]) -> DataFrame:
    """country, position, points of an association ranking; display names go through the alias map."""
    schema = "data struct<members: array<struct<member: struct<displayName: string, countryCode: string>, overallRanking: struct<position: int, totalPoints: double>>>>"
    m = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("data.members").alias("m"))
    name = F.trim(F.regexp_replace("m.member.displayName", " ", " "))
    alias = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else F.lit(None).cast("map<string,string>")
    return m.select(F.coalesce(F.try_element_at(alias, name), name).alias("country"), F.col("m.overallRanking.position").alias("position"), F.col("m.overallRanking.totalPoints").alias("points"))
