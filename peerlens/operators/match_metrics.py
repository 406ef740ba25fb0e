"""Metrics per player and match out of raw match events: one pass of conditional increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import timestamp_seconds
from .sequence import creating_actions, pressure_success

_NAMED = "struct<name: string>"
EVENT_SCHEMA = f"""
match_id long, id string, index long, period int, timestamp string, type {_NAMED}, possession long,
possession_team struct<id: long>, team struct<id: long>, player struct<id: long>, position struct<id: int>,
location array<double>, counterpress boolean,
pass struct<end_location: array<double>, length: double, outcome: {_NAMED}, type: {_NAMED}, technique: {_NAMED}, shot_assist: boolean, goal_assist: boolean, assisted_shot_id: string, cross: boolean, switch: boolean, through_ball: boolean, aerial_won: boolean>,
carry struct<end_location: array<double>>,
shot struct<statsbomb_xg: double, outcome: {_NAMED}, type: {_NAMED}, aerial_won: boolean>,
dribble struct<outcome: {_NAMED}>, duel struct<type: {_NAMED}, outcome: {_NAMED}>,
interception struct<outcome: {_NAMED}>, clearance struct<aerial_won: boolean>, miscontrol struct<aerial_won: boolean>,
ball_recovery struct<recovery_failure: boolean>, ball_receipt struct<outcome: {_NAMED}>,
`50_50` struct<outcome: {_NAMED}>, goalkeeper struct<type: {_NAMED}, outcome: {_NAMED}>
"""


def _in_box(loc: Column) -> Column:
    x, y = F.get(loc, F.lit(0)), F.get(loc, F.lit(1))
    return (x >= C.BOX[0]) & y.between(C.BOX[1], C.BOX[2])


def _to_goal(loc: Column) -> Column:
    return F.hypot(F.lit(C.GOAL[0]) - F.get(loc, F.lit(0)), F.lit(C.GOAL[1]) - F.get(loc, F.lit(1)))


def increments(xg_of_assisted: Column) -> list[tuple[str, Column, Column | float]]:
    """(code, condition, amount) of everything that one event adds. A null condition adds nothing."""
    kind = F.col("type.name")
    on = lambda name, cond=None: (kind == name) if cond is None else (kind == name) & cond
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    start, gk = F.col("location"), F.coalesce(F.col("position.id") == 1, F.lit(False))
    done = F.col("pass.outcome").isNull()
    p_end, c_end = F.col("pass.end_location"), F.col("carry.end_location")
    p_gain, c_gain = _to_goal(start) - _to_goal(p_end), _to_goal(start) - _to_goal(c_end)
    moved = done & start.isNotNull() & p_end.isNotNull()
    carried = start.isNotNull() & c_end.isNotNull()
    x0 = F.get(start, F.lit(0))
    entry = lambda end: _in_box(end) & ~_in_box(start)
    third = lambda end: (x0 < C.FINAL_THIRD) & (F.get(end, F.lit(0)) >= C.FINAL_THIRD)
    forward = lambda gain, end: ((gain >= C.PROGRESSIVE) & (x0 >= C.OWN_40)) | entry(end)
    open_play = ~F.coalesce(F.col("pass.type.name").isin(*C.SET_PIECES), F.lit(False))
    long = F.coalesce(F.col("pass.length"), F.lit(0.0)) >= C.LONG_PASS
    xg = F.coalesce(F.col("shot.statsbomb_xg"), F.lit(0.0))
    penalty = F.coalesce(F.col("shot.type.name") == "Penalty", F.lit(False))
    goal = F.col("shot.outcome.name") == "Goal"
    duel, g, g_out = F.col("duel.type.name"), F.col("goalkeeper.type.name"), F.col("goalkeeper.outcome.name")
    touched = kind.isin(*C.TOUCHES) & ~((kind == "Ball Receipt*") & F.coalesce(F.col("ball_receipt.outcome.name") == "Incomplete", F.lit(False)))
    aerial = on("Pass", yes("pass.aerial_won")) | on("Shot", yes("shot.aerial_won")) | on("Clearance", yes("clearance.aerial_won")) | on("Miscontrol", yes("miscontrol.aerial_won"))
    return [
        ("touches", touched, 1),
        ("touches_att_box", touched & kind.isin(*C.BOX_TOUCHES) & _in_box(start), 1),
        ("passes", on("Pass"), 1),
        ("gk_passes", on("Pass", gk), 1),
        ("passes_completed", on("Pass", done), 1),
        ("gk_passes_completed", on("Pass", done & gk), 1),
        ("long_passes", on("Pass", long), 1),
        ("gk_long_passes", on("Pass", long & gk), 1),
        ("long_passes_completed", on("Pass", long & done), 1),
        ("key_passes", on("Pass", yes("pass.shot_assist") | yes("pass.goal_assist")), 1),
        ("assists", on("Pass", yes("pass.goal_assist")), 1),
        ("xa", on("Pass", F.col("pass.assisted_shot_id").isNotNull()), xg_of_assisted),
        ("crosses", on("Pass", yes("pass.cross")), 1),
        ("switches", on("Pass", yes("pass.switch")), 1),
        ("through_balls", on("Pass", yes("pass.through_ball") | F.coalesce(F.col("pass.technique.name") == "Through Ball", F.lit(False))), 1),
        ("aerial_duels", aerial | on("Duel", duel == "Aerial Lost"), 1),
        ("aerial_duels_won", aerial, 1),
        ("progressive_pass_distance", on("Pass", moved), F.greatest(p_gain, F.lit(0.0))),
        ("progressive_passes", on("Pass", moved & open_play & forward(p_gain, p_end)), 1),
        ("passes_final_third", on("Pass", moved & third(p_end)), 1),
        ("passes_into_box", on("Pass", moved & entry(p_end)), 1),
        ("carries", on("Carry"), 1),
        ("carry_distance", on("Carry", carried), F.hypot(F.get(c_end, F.lit(0)) - x0, F.get(c_end, F.lit(1)) - F.get(start, F.lit(1)))),
        ("progressive_carry_distance", on("Carry", carried), F.greatest(c_gain, F.lit(0.0))),
        ("progressive_carries", on("Carry", carried & forward(c_gain, c_end)), 1),
        ("carries_final_third", on("Carry", carried & third(c_end)), 1),
        ("carries_into_box", on("Carry", carried & entry(c_end)), 1),
        ("shots", on("Shot"), 1),
        ("xg", on("Shot"), xg),
        ("goals", on("Shot", goal), 1),
        ("shots_on_target", on("Shot", F.col("shot.outcome.name").isin(*C.ON_TARGET)), 1),
        ("penalties_taken", on("Shot", penalty), 1),
        ("penalties_scored", on("Shot", penalty & goal), 1),
        ("np_shots", on("Shot", ~penalty), 1),
        ("npxg", on("Shot", ~penalty), xg),
        ("np_goals", on("Shot", ~penalty & goal), 1),
        ("take_ons", on("Dribble"), 1),
        ("take_ons_won", on("Dribble", F.col("dribble.outcome.name") == "Complete"), 1),
        ("tackles", on("Duel", duel == "Tackle"), 1),
        ("tackles_won", on("Duel", (duel == "Tackle") & F.col("duel.outcome.name").isin(*C.DUEL_WON)), 1),
        ("interceptions", on("Interception"), 1),
        ("interceptions_won", on("Interception", F.col("interception.outcome.name").isin(*C.DUEL_WON)), 1),
        ("blocks", on("Block"), 1),
        ("clearances", on("Clearance"), 1),
        ("ball_recoveries", on("Ball Recovery", ~yes("ball_recovery.recovery_failure")), 1),
        ("pressures", on("Pressure"), 1),
        ("counterpressures", on("Pressure", yes("counterpress")), 1),
        ("fouls_committed", on("Foul Committed"), 1),
        ("fouls_won", on("Foul Won"), 1),
        ("miscontrols", on("Miscontrol"), 1),
        ("dispossessed", on("Dispossessed"), 1),
        ("dribbled_past", on("Dribbled Past"), 1),
        ("errors", on("Error"), 1),
        ("fifty_fifties", on("50/50"), 1),
        ("fifty_fifties_won", on("50/50", F.col("50_50.outcome.name").isin(*C.FIFTY_WON)), 1),
        ("gk_shots_faced", on("Goal Keeper", g.isin(*C.GK_SHOTS)), 1),
        ("gk_saves", on("Goal Keeper", g.isin(*C.GK_SAVES)), 1),
        ("gk_goals_conceded", on("Goal Keeper", (g == "Goal Conceded") | ((g == "Penalty Conceded") & ~F.coalesce(g_out.isin("Saved", "Success"), F.lit(False)))), 1),
        ("gk_penalties_faced", on("Goal Keeper", g.isin("Penalty Saved", "Penalty Conceded")), 1),
        ("gk_penalties_saved", on("Goal Keeper", g == "Penalty Saved"), 1),
        ("gk_sweeper_actions", on("Goal Keeper", g == "Keeper Sweeper"), 1),
        ("gk_claims", on("Goal Keeper", g.isin(*C.GK_CLAIMS)), 1),
    ]


def match_metrics(events: DataFrame) -> DataFrame:
    """match_id, player_id, code, value of events in EVENT_SCHEMA; zero values have no row. Period 5 is left out."""
    e = events.filter(F.coalesce(F.col("period"), F.lit(1)) != 5)
    shots = e.filter(F.col("type.name") == "Shot").select(F.col("match_id").alias("assisted_match"), F.col("id").alias("assisted"), F.col("shot.statsbomb_xg").alias("assisted_xg"))
    x = e.join(shots, (F.col("match_id") == F.col("assisted_match")) & (F.col("pass.assisted_shot_id") == F.col("assisted")), "left").drop("assisted_match")
    adds = increments(F.coalesce(F.col("assisted_xg"), F.lit(0.0)))
    each = F.filter(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), (F.lit(float(v)) if isinstance(v, int) else v).alias("value"))) for code, c, v in adds]), lambda s: s.isNotNull())
    long = x.filter("player.id is not null").select("match_id", F.col("player.id").alias("player_id"), F.explode(each).alias("m")).select("match_id", "player_id", "m.*")
    flat = e.select("match_id", F.col("index").alias("idx"), "period", timestamp_seconds(F.col("timestamp")).alias("t"), F.col("team.id").alias("team"), "possession", F.col("possession_team.id").alias("possession_team"), F.col("player.id").alias("player"), F.col("type.name").alias("kind"), F.coalesce(F.col("shot.outcome.name") == "Goal", F.lit(False)).alias("is_goal"), (F.col("type.name").isin("Shot", "Foul Won") | ((F.col("type.name") == "Pass") & F.col("pass.outcome").isNull()) | ((F.col("type.name") == "Dribble") & F.coalesce(F.col("dribble.outcome.name") == "Complete", F.lit(False)))).alias("qualifies"))
    flat = flat.withColumns({"is_pressure": (F.col("kind") == "Pressure") & F.col("player").isNotNull(), "is_shot": F.col("kind") == "Shot"})
    won = pressure_success(flat).join(flat.select("match_id", "idx", "player"), ["match_id", "idx"]).select("match_id", F.col("player").alias("player_id"), F.lit("successful_pressures").alias("code"), F.lit(1.0).alias("value"))
    acts = creating_actions(flat)
    sca = acts.select("match_id", F.col("player").alias("player_id"), F.explode(F.when(F.col("is_goal"), F.array(F.lit("sca"), F.lit("gca"))).otherwise(F.array(F.lit("sca")))).alias("code"), F.lit(1.0).alias("value"))
    total = long.unionByName(won).unionByName(sca).groupBy("match_id", "player_id", "code").agg(F.sum("value").alias("value"))
    sums = {"defensive_actions": ("tackles", "interceptions", "blocks", "clearances"), "ground_duels": ("tackles", "take_ons", "dribbled_past", "fifty_fifties"), "ground_duels_won": ("tackles_won", "take_ons_won", "fifty_fifties_won")}
    into = F.array(*[F.when(F.col("code").isin(*parts), F.lit(code)) for code, parts in sums.items()])
    more = total.select("match_id", "player_id", F.explode(F.array_compact(F.array_append(into, F.when(~F.col("code").isin("fifty_fifties", "fifty_fifties_won"), F.col("code"))))).alias("code"), "value")
    return more.groupBy("match_id", "player_id", "code").agg(F.sum("value").alias("value")).filter("value <> 0")
