"""Rules on columns and settings: eligibility, scope, ages, names of countries, configuration."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C

DAYS = 365.25


def age_on(born: Column, day: Column) -> Column:
    return F.datediff(day, born) / F.lit(DAYS)


def age_at_season_end(born: Column, end_year: Column) -> Column:
    """Age on 30 June of the year in which a season ends."""
    return age_on(born, F.make_date(end_year, F.lit(6), F.lit(30)))


def age_between(born: Column, end_year: Column, low: float | None = None, high: float | None = None) -> Column:
    """Without a bound all pass; with one, those without a date of birth don't."""
    if low is None and high is None:
        return F.lit(True)
    age = age_at_season_end(born, end_year)
    ok = F.lit(True) if low is None else age >= low
    return F.coalesce(ok if high is None else ok & (age <= high), F.lit(False))


def plausible_age(born: Column, first: Column, last: Column, low: float = 15, high: float = 45) -> Column:
    """Old enough at the first match, not too old at the last; unknown where a date is missing."""
    return (age_on(born, first) >= low) & (age_on(born, last) <= high)


def in_scope(scope: Column, group: Column) -> Column:
    """Whether a metric's scope holds for a position group: outfield metrics not for keepers, theirs for no one else."""
    return F.when(group == "GK", scope != "outfield").otherwise(scope != "goalkeeper")


def metric_eligible(family: Column, per90: Column, is_rate: Column) -> Column:
    """Metrics that get percentiles: rates and those counted per 90 minutes, but not playing time."""
    return (family != "playing_time") & (per90 | is_rate)


def starts_share(starts: Column, appearances: Column) -> Column:
    return F.try_divide(starts.cast("double"), appearances.cast("double"))


def country_name(name: Column, aliases: Mapping[str, str]) -> Column:
    """The name by which a country is known here; no-break spaces are blanks, those at the ends go."""
    plain = F.trim(F.translate(name, "\u00a0", " "))
    if not aliases:
        return plain
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), plain), plain)


def config_hash(config: Mapping) -> str:
    """Twelve hexadecimal digits that name a configuration, whatever the order of its keys."""
    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def with_defaults(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """key, value: stored values, and the defaults of keys that are not stored."""
    named = stored.select("key", F.col("value").alias("__stored"))
    return defaults.join(named, "key", "full_outer").select("key", F.coalesce("__stored", "value").alias("value"))


def exclusion(ranking: DataFrame, *, explicit: list[int] | None = None, exclude_top: bool = True, top: int = C.EXCLUDE_TOP) -> tuple[DataFrame, str]:
    """(ids, basis) of leagues that a search leaves out: the configured ones, else none, else the best of the ranking.

    ranking: id, score. At most `top` rows come out of the ranking, or the configured ones.
    """
    if explicit:
        return ranking.sparkSession.createDataFrame([(i,) for i in sorted(set(explicit))], "id long"), "manually configured"
    if not exclude_top:
        return ranking.select("id").limit(0), "none"
    return ranking.orderBy(F.desc("score"), "id").limit(top).select("id"), "model"
