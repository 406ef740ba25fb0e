"""Read operators: what a client asks of the tables, one plan per question and for any number of subjects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNAVAILABLE = "Data unavailable"


def joined(values: Column, separator: str = "; ") -> Column:
    return F.array_join(values, separator)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n: counts come from file footers or partial sums, never from rows on the driver."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, t in tables.items()])


def competitions(seasons: DataFrame, matches: DataFrame, strength: DataFrame) -> DataFrame:
    """competition_id, matches, seasons: array of (end_year, season_id, coverage, strength), latest first.

    seasons: competition_id, season_id, end_year, coverage. matches: season_id. strength: season_id, strength, one row
    each at most. Matches are counted per season before the join, so no row is multiplied.
    """
    per = matches.groupBy("season_id").agg(F.count("*").alias("n"))
    x = seasons.join(per, "season_id", "left").join(strength, "season_id", "left")
    listed = F.sort_array(F.collect_list(F.struct("end_year", "season_id", "coverage", "strength")), asc=False)
    return x.groupBy("competition_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("matches"), listed.alias("seasons"))


def season_bounds(seasons: DataFrame, matches: DataFrame) -> DataFrame:
    """seasons with starts and ends as the dates of the first and last match; those without matches keep theirs."""
    dates = matches.groupBy("season_id").agg(F.min("date").alias("__from"), F.max("date").alias("__to"))
    return seasons.join(dates, "season_id", "left").withColumns({"starts": F.coalesce("__from", "starts"), "ends": F.coalesce("__to", "ends")}).drop("__from", "__to")


def player_summary(players: DataFrame, sources: DataFrame, seasons: DataFrame, today: Column) -> DataFrame:
    """player_id, display_name, sources, latest_season, age, age_note.

    players: player_id, full_name, known_as, born. sources: player_id, code. seasons: player_id, season_id, end_year,
    minutes. Without a date of birth the age is null and the note says so.
    """
    codes = sources.groupBy("player_id").agg(F.array_sort(F.collect_set("code")).alias("sources"))
    latest = seasons.groupBy("player_id").agg(F.max(F.struct("end_year", "minutes", "season_id"))["season_id"].alias("latest_season"))
    x = players.join(codes, "player_id", "left").join(latest, "player_id", "left")
    return x.select(
        "player_id",
        F.coalesce(F.when(F.trim("known_as") != "", F.col("known_as")), F.col("full_name")).alias("display_name"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        "latest_season",
        F.round(F.datediff(today, F.col("born")) / F.lit(365.25), 1).alias("age"),
        F.when(F.col("born").isNull(), f"{UNAVAILABLE}: no date of birth").alias("age_note"),
    )


def player_quality(players: DataFrame, seasons: DataFrame, sources: DataFrame, small: float = 900) -> DataFrame:
    """player_id, seasons_loaded, total_minutes, n_sources, flags: what is known of each player and what is doubtful."""
    per = seasons.groupBy("player_id").agg(F.count("*").alias("seasons_loaded"), F.sum("minutes").alias("total_minutes"), F.max("minutes").alias("__most"))
    known = sources.groupBy("player_id").agg(F.count_distinct("code").alias("n_sources"))
    x = players.join(per, "player_id", "left").join(known, "player_id", "left")
    flags = F.array_compact(F.array(F.when(F.col("born").isNull(), "missing_date_of_birth"), F.when(F.col("__most") < small, "small_sample")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return x.select("player_id", zero("seasons_loaded"), zero("total_minutes"), zero("n_sources"), flags.alias("flags"))


def player_stats(stats: DataFrame, percentiles: DataFrame, positions: DataFrame) -> DataFrame:
    """stats with percentile, pool_n and adjusted_percentile of the player's primary group in the season.

    stats: player_id, season_id, code. percentiles: player_id, season_id, code, group, family (raw or adjusted),
    percentile, pool_n. positions: player_id, season_id, group. Both families become columns in one aggregate.
    """
    keys = ["player_id", "season_id"]
    of = lambda family, c: F.max(F.when(F.col("family") == family, F.col(c)))
    mine = percentiles.join(positions, [*keys, "group"]).groupBy(*keys, "code").agg(of("raw", "percentile").alias("percentile"), of("raw", "pool_n").alias("pool_n"), of("adjusted", "percentile").alias("adjusted_percentile"))
    return stats.join(mine, [*keys, "code"], "left")


def latest_value(players: DataFrame, predictions: DataFrame, runs: DataFrame) -> DataFrame:
    """player_id, value, low, high, confidence, status: the latest prediction of the active run, or why there is none.

    predictions: run_id, player_id, as_of, value, low, high, confidence. runs: run_id, is_active; one is active at most.
    """
    active = predictions.join(runs.filter("is_active").select("run_id"), "run_id", "left_semi")
    last = active.groupBy("player_id").agg(F.max(F.struct("as_of", "run_id", "value", "low", "high", "confidence")).alias("p"))
    x = players.select("player_id").join(last, "player_id", "left")
    missing = F.col("p").isNull()
    status = F.when(missing, f"{UNAVAILABLE}: no active model or no prediction").otherwise("ok")
    return x.select("player_id", "p.value", "p.low", "p.high", F.when(missing, "insufficient").otherwise(F.col("p.confidence")).alias("confidence"), status.alias("status"))


def search(rows: DataFrame, text: Column, wanted: str, order: list[Column], limit: int | None = None) -> DataFrame:
    """Rows whose text holds `wanted`, whatever its case, in order."""
    found = rows.filter(text.ilike(f"%{wanted}%")).orderBy(*order)
    return found if limit is None else found.limit(limit)


def dashboard(tables: dict[str, DataFrame], jobs: DataFrame, reviews: DataFrame, flags: DataFrame) -> DataFrame:
    """name, value: row counts, the last job's state, pending reviews and open flags by severity.

    jobs: job_id, started, state. reviews: status. flags: severity, open.
    """
    counts = row_counts(tables).select(F.concat(F.lit("rows "), "table").alias("name"), F.col("n").cast("string").alias("value"))
    last = jobs.agg(F.max(F.struct("started", "job_id", "state"))["state"].alias("value")).select(F.lit("last job").alias("name"), "value")
    pending = reviews.agg(F.count_if(F.col("status") == "pending").cast("string").alias("value")).select(F.lit("pending reviews").alias("name"), "value")
    open_flags = flags.filter("open").groupBy("severity").agg(F.count("*").cast("string").alias("value")).select(F.concat(F.lit("flags "), "severity").alias("name"), "value")
    return counts.unionByName(last).unionByName(pending).unionByName(open_flags)


def shaped(rows: DataFrame, fields: dict[str, Column], noted: dict[str, str]) -> DataFrame:
    """One JSON text per row. A field named in `noted` is written as null where missing, with its note beside it."""
    notes = {f"{name}_note": F.when(fields[name].isNull(), f"{UNAVAILABLE}: {note}") for name, note in noted.items()}
    body = F.struct(*[c.alias(n) for n, c in (fields | notes).items()])
    return rows.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))
