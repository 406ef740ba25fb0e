"""Operators on ordered events of a match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CREATING_ACTIONS, PERIODS, PRESSURE_SECONDS


def pressure_success(events: DataFrame, *, seconds: float = PRESSURE_SECONDS) -> DataFrame:
    """match_id, idx of pressures that won the ball.

    events: match_id, idx, period, t (seconds), team, possession, possession_team, is_pressure. Of the events after
    the pressure the first in another period or more than `seconds` later ends the search; success is a possession
    of the presser's team, other than the pressure's, before that. A missing period is one of its own. Clocks may run
    backward, so the search follows the index. Matches are short: the join is within one match.
    """
    p = events.filter("is_pressure").select("match_id", F.col("idx").alias("i"), F.col("period").alias("p0"), F.col("t").alias("t0"), F.col("team").alias("team0"), F.col("possession").alias("poss0"))
    n = events.select(F.col("match_id").alias("m"), "idx", "period", "t", "possession", "possession_team")
    j = p.join(n, (F.col("match_id") == F.col("m")) & (F.col("idx") > F.col("i"))).drop("m")
    stop = ~F.col("period").eqNullSafe(F.col("p0")) | F.coalesce(F.col("t") - F.col("t0") > seconds, F.lit(False))
    hit = F.coalesce((F.col("possession_team") == F.col("team0")) & (F.col("possession") != F.col("poss0")), F.lit(False))
    first = j.groupBy("match_id", "i").agg(F.min(F.when(stop, F.col("idx"))).alias("s"), F.min(F.when(hit & ~stop, F.col("idx"))).alias("h"))
    return first.filter("h is not null and (s is null or h < s)").select("match_id", F.col("i").alias("idx"))


def creating_actions(events: DataFrame, *, last: int = CREATING_ACTIONS) -> DataFrame:
    """match_id, shot_idx, idx, is_goal: the last qualifying actions of the shot's team before it, in the unbroken
    run of the shot's possession. events: match_id, idx, possession, team, player, is_shot, is_goal, qualifies."""
    order = Window.partitionBy("match_id").orderBy("idx")
    run = events.withColumn("new", (~F.col("possession").eqNullSafe(F.lag("possession").over(order))).cast("int")).withColumn("run", F.sum("new").over(order))
    shots = run.filter("is_shot").select("match_id", "run", "team", F.col("idx").alias("shot_idx"), "is_goal")
    acts = run.filter("qualifies and player is not null").select("match_id", "run", "team", "idx", "player")
    j = shots.join(acts, ["match_id", "run", "team"]).filter("idx < shot_idx")
    rank = F.row_number().over(Window.partitionBy("match_id", "shot_idx").orderBy(F.desc("idx")))
    return j.withColumn("r", rank).filter(F.col("r") <= last).select("match_id", "shot_idx", "idx", "player", "is_goal")


def period_durations(events: DataFrame) -> DataFrame:
    """match_id, period, duration, start, length, offset: measured by the latest Half End, else nominal.

    events: match_id, period, type, t (seconds from the period's start). Matches without a period have 1 and 2.
    """
    seen = {f"seen{p}": F.max(F.col("period") == p) for p in PERIODS}
    ends = {f"end{p}": F.max(F.when((F.col("period") == p) & (F.col("type") == "Half End"), F.col("t") / 60.0)) for p in PERIODS}
    x = events.groupBy("match_id").agg(*[c.alias(n) for n, c in (seen | ends).items()])
    known = {p: F.coalesce(f"seen{p}", F.lit(False)) for p in PERIODS}
    bare = ~reduce(lambda a, c: a | c, known.values())
    each, offset = [], F.lit(0.0)
    for p, (start, length) in sorted(PERIODS.items()):
        here = known[p] | bare if p in (1, 2) else known[p]
        duration = F.when(F.col(f"end{p}") > 0, F.col(f"end{p}")).otherwise(F.lit(length))
        each.append(F.when(here, F.struct(F.lit(p).cast("int").alias("period"), F.lit(start).alias("start"), F.lit(length).alias("length"), duration.alias("duration"), offset.alias("offset"))))
        offset = offset + F.when(here, duration).otherwise(0.0)
    return x.select("match_id", F.explode(F.array_compact(F.array(*each))).alias("e")).select("match_id", "e.*")


# Segments whose appearances are one task's.
SEGMENTS_A_TASK = 250_000


def appearances(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """match_id, player_id, minutes_nominal, minutes_elapsed, started, minutes_by_position.

    segments: match_id, player_id, position_id, from_min, to_min, from_period, to_period, start_reason; a player
    without a segment has one row of nulls. Both clocks: nominal minutes stay in the period's nominal bounds,
    elapsed ones add the measured lengths of earlier periods. Open ends, and ends in the shoot-out, are the match's.

    Segments are counted first: tasks are as many as keep each to SEGMENTS_A_TASK of them, or a match, as rows compress so
    well in a shuffle that tasks cut by its bytes hold far too many.
    """
    tasks = max(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-segments.count() // SEGMENTS_A_TASK))
    of = lambda what: [F.max(F.when(F.col("period") == p, F.col(what))).alias(f"{what}{p}") for p in PERIODS]
    totals = durations.repartition(tasks, "match_id").groupBy("match_id").agg(F.sum("duration").alias("all_elapsed"), F.sum("length").alias("all_nominal"), *of("duration"), *of("offset"))
    nominal = F.create_map(*[x for p, (s, n) in PERIODS.items() for x in (F.lit(p), F.struct(F.lit(s).alias("start"), F.lit(n).alias("length")))])

    def at(clock: str, period: str):
        c, n = F.col(clock), F.element_at(nominal, F.col(period))
        duration, offset = (F.coalesce(*[F.when(F.col(period) == p, F.col(f"{what}{p}")) for p in PERIODS]) for what in ("duration", "offset"))
        nom = F.coalesce(F.least(F.greatest(c, n["start"]), n["start"] + n["length"]), F.col("all_nominal"))
        within = F.least(F.greatest(c - n["start"], F.lit(0.0)), duration)
        el = F.when(c.isNull() | n.isNull() | duration.isNull(), F.col("all_elapsed")).otherwise(offset + within)
        return F.when(c.isNull() | n.isNull(), F.col("all_nominal")).otherwise(nom), el

    s = segments.repartition(tasks, "match_id").join(totals, "match_id").withColumn("to_p", F.when(F.col("to_period") != 5, F.col("to_period")))
    (fn, fe), (tn, te) = at("from_min", "from_period"), at("to_min", "to_p")
    counts = F.col("position_id").isNotNull() & ~F.coalesce(F.col("from_period") == 5, F.lit(False))
    s = s.select("match_id", "player_id", "position_id", F.coalesce(F.col("start_reason") == "Starting XI", F.lit(False)).alias("first"), F.when(counts, F.greatest(tn - fn, F.lit(0.0))).otherwise(0.0).alias("nom"), F.when(counts, F.greatest(te - fe, F.lit(0.0))).otherwise(0.0).alias("el"))
    by_pos = s.groupBy("match_id", "player_id", "position_id").agg(F.sum("nom").alias("nom"), F.sum("el").alias("el"), F.max("first").alias("first"))
    return by_pos.groupBy("match_id", "player_id").agg(
        F.round(F.sum("nom"), 2).alias("minutes_nominal"),
        F.round(F.sum("el"), 2).alias("minutes_elapsed"),
        F.max("first").alias("started"),
        F.map_from_entries(F.filter(F.collect_list(F.struct("position_id", F.round("nom", 2).alias("m"))), lambda x: x["m"] > 0)).alias("minutes_by_position"),
    )
