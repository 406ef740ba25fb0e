"""Match metrics, appearances and observations over events made from the events table, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import match_metrics as M
from .queries import query, table

KINDS = ("Pass", "Carry", "Shot", "Dribble", "Duel", "Interception", "Goal Keeper", "Pressure", "Ball Receipt*", "Pass", "Clearance", "Miscontrol", "Ball Recovery", "Block", "Foul Committed", "Foul Won", "Dispossessed", "Dribbled Past", "Error", "50/50", "Shot")
PASS_TYPES = ("Corner", None, "Free Kick", None, "Recovery", None, "Throw-in")
SHOT_OUTCOMES = ("Goal", "Saved", "Off T", "Saved To Post", "Blocked")
DUEL_OUTCOMES = ("Won", "Lost In Play", "Success", "Success Out", None)
KEEPER = ("Shot Faced", "Shot Saved", "Goal Conceded", "Penalty Saved", "Penalty Conceded", "Keeper Sweeper", "Collected", "Punch")


def _list(values) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def metric_events(spark, d):
    """Match events out of user events: a user is a match, the id is the order and gives kind and details."""
    i = F.col("event_id").cast("long")
    at = lambda v, n: F.get(F.array(*[F.lit(x).cast("string") for x in v]), (n % len(v)).cast("int"))
    named = lambda c: F.when(c.isNotNull(), F.struct(c.alias("name")))
    kind = at(KINDS, i)
    on = lambda *k: kind.isin(*k)
    spot = F.when(i % 17 != 3, F.array((i * 7 % 121).cast("double"), (i * 11 % 81).cast("double")))
    end = F.when(i % 19 != 4, F.array((i * 13 % 121).cast("double"), (i * 5 % 81).cast("double")))
    yes = lambda n: F.when(i % n == 0, F.lit(True))
    text = lambda v: F.lit(v).cast("string")
    return table(spark, d, "events").select(
        F.col("user_id").cast("long").alias("match_id"), i.cast("string").alias("id"), i.alias("index"), F.when(i % 23 != 0, (1 + F.floor(i / 29) % 5)).cast("int").alias("period"),
        F.format_string("00:%02d:%02d.000", (F.floor(i / 60) % 60).cast("int"), (i % 60).cast("int")).alias("timestamp"), F.struct(kind.alias("name")).alias("type"), F.floor(i / 400).alias("possession"),
        F.struct((F.floor(i / 400) % 2).alias("id")).alias("possession_team"), F.struct((F.floor(i / 200) % 2).alias("id")).alias("team"), F.when(i % 31 != 5, F.struct((i % 6).alias("id"))).alias("player"), F.struct((1 + i % 4).cast("int").alias("id")).alias("position"),
        spot.alias("location"), yes(2).alias("counterpress"),
        F.when(on("Pass"), F.struct(end.alias("end_location"), (i % 50).cast("double").alias("length"), named(F.when(i % 4 == 0, "Incomplete")).alias("outcome"), named(at(PASS_TYPES, i)).alias("type"), named(F.when(i % 13 == 0, "Through Ball")).alias("technique"), yes(5).alias("shot_assist"), yes(8).alias("goal_assist"), F.when(i % 6 == 0, (i + 2).cast("string")).alias("assisted_shot_id"), yes(3).alias("cross"), yes(10).alias("switch"), yes(11).alias("through_ball"), yes(9).alias("aerial_won"))).alias("pass"),
        F.when(on("Carry"), F.struct(end.alias("end_location"))).alias("carry"),
        F.when(on("Shot"), F.struct(((i % 64) / 64.0).alias("statsbomb_xg"), named(at(SHOT_OUTCOMES, i)).alias("outcome"), named(F.when(i % 8 == 1, "Penalty").otherwise("Open Play")).alias("type"), yes(4).alias("aerial_won"))).alias("shot"),
        F.when(on("Dribble"), F.struct(named(F.when(i % 2 == 0, "Complete").otherwise("Incomplete")).alias("outcome"))).alias("dribble"),
        F.when(on("Duel"), F.struct(named(F.when(i % 4 == 1, "Aerial Lost").otherwise("Tackle")).alias("type"), named(at(DUEL_OUTCOMES, i)).alias("outcome"))).alias("duel"),
        F.when(on("Interception"), F.struct(named(at(DUEL_OUTCOMES, i)).alias("outcome"))).alias("interception"),
        F.when(on("Clearance"), F.struct(yes(3).alias("aerial_won"))).alias("clearance"), F.when(on("Miscontrol"), F.struct(yes(4).alias("aerial_won"))).alias("miscontrol"),
        F.when(on("Ball Recovery"), F.struct(yes(3).alias("recovery_failure"))).alias("ball_recovery"), F.when(on("Ball Receipt*"), F.struct(named(F.when(i % 2 == 0, "Incomplete")).alias("outcome"))).alias("ball_receipt"),
        F.when(on("50/50"), F.struct(named(F.when(i % 2 == 0, "Won").otherwise(text("Lost"))).alias("outcome"))).alias("50_50"),
        F.when(on("Goal Keeper"), F.struct(named(at(KEEPER, i)).alias("type"), named(F.when(i % 3 == 0, "Saved")).alias("outcome"))).alias("goalkeeper"),
    )


def _conditions() -> dict[str, tuple[str, str]]:
    """code: condition and amount, in SQL over the flat events below."""
    box = lambda p: f"({p}x >= {C.BOX[0]} and {p}y between {C.BOX[1]} and {C.BOX[2]})"
    entry, third = f"({box('e')} and not {box('')})", f"(x < {C.FINAL_THIRD} and ex >= {C.FINAL_THIRD})"
    ahead = f"((gain >= {C.PROGRESSIVE} and x >= {C.OWN_40}) or {entry})"
    moved, done = "(x is not null and ex is not null)", "i % 4 <> 0"
    aerial = "((kind = 'Pass' and i % 9 = 0) or (kind = 'Shot' and i % 4 = 0) or (kind = 'Clearance' and i % 3 = 0) or (kind = 'Miscontrol' and i % 4 = 0))"
    open_play, gk, penalty, goal = f"coalesce(ptype not in {_in(C.SET_PIECES)}, true)", "i % 4 = 0", "i % 8 = 1", "shot = 'Goal'"
    kinds = {
        "Pass": {
            "passes": "true", "gk_passes": gk, "passes_completed": done, "gk_passes_completed": f"{done} and {gk}", "long_passes": "length >= 30", "gk_long_passes": f"length >= 30 and {gk}", "long_passes_completed": f"length >= 30 and {done}",
            "key_passes": "i % 5 = 0 or i % 8 = 0", "assists": "i % 8 = 0", "xa": ("i % 6 = 0", "axg"), "crosses": "i % 3 = 0", "switches": "i % 10 = 0", "through_balls": "i % 11 = 0 or i % 13 = 0", "progressive_pass_distance": (f"{done} and {moved}", "greatest(gain, 0)"),
            "progressive_passes": f"{done} and {moved} and {open_play} and {ahead}", "passes_final_third": f"{done} and {moved} and {third}", "passes_into_box": f"{done} and {moved} and {entry}",
        },
        "Carry": {"carries": "true", "carry_distance": (moved, "sqrt((ex - x) * (ex - x) + (ey - y) * (ey - y))"), "progressive_carry_distance": (moved, "greatest(gain, 0)"), "progressive_carries": f"{moved} and {ahead}", "carries_final_third": f"{moved} and {third}", "carries_into_box": f"{moved} and {entry}"},
        "Shot": {"shots": "true", "xg": ("true", "xg"), "goals": goal, "shots_on_target": f"shot in {_in(C.ON_TARGET)}", "penalties_taken": penalty, "penalties_scored": f"{penalty} and {goal}", "np_shots": f"not {penalty}", "npxg": (f"not {penalty}", "xg"), "np_goals": f"not {penalty} and {goal}"},
        "Dribble": {"take_ons": "true", "take_ons_won": "i % 2 = 0"},
        "Duel": {"tackles": "i % 4 <> 1", "tackles_won": f"i % 4 <> 1 and duel in {_in(C.DUEL_WON)}"},
        "Interception": {"interceptions": "true", "interceptions_won": f"duel in {_in(C.DUEL_WON)}"},
        "Block": {"blocks": "true"}, "Clearance": {"clearances": "true"}, "Ball Recovery": {"ball_recoveries": "i % 3 <> 0"}, "Pressure": {"pressures": "true", "counterpressures": "i % 2 = 0"}, "Foul Committed": {"fouls_committed": "true"}, "Foul Won": {"fouls_won": "true"},
        "Miscontrol": {"miscontrols": "true"}, "Dispossessed": {"dispossessed": "true"}, "Dribbled Past": {"dribbled_past": "true"}, "Error": {"errors": "true"},
        "50/50": {"fifty_fifties": "true", "fifty_fifties_won": "i % 2 = 0"},
        "Goal Keeper": {
            "gk_shots_faced": f"keeper in {_in(C.GK_SHOTS)}", "gk_saves": f"keeper in {_in(C.GK_SAVES)}", "gk_goals_conceded": "keeper = 'Goal Conceded' or (keeper = 'Penalty Conceded' and i % 3 <> 0)", "gk_penalties_faced": "keeper in ('Penalty Saved', 'Penalty Conceded')",
            "gk_penalties_saved": "keeper = 'Penalty Saved'", "gk_sweeper_actions": "keeper = 'Keeper Sweeper'", "gk_claims": f"keeper in {_in(C.GK_CLAIMS)}",
        },
    }
    out = {code: (f"kind = '{k}' and ({c if isinstance(c, str) else c[0]})", "1" if isinstance(c, str) else c[1]) for k, m in kinds.items() for code, c in m.items()}
    touch = "not (kind = 'Ball Receipt*' and i % 2 = 0)"
    return out | {
        "touches": (f"kind in {_in(C.TOUCHES)} and {touch}", "1"), "touches_att_box": (f"kind in {_in(C.BOX_TOUCHES)} and {touch} and {box('')}", "1"),
        "aerial_duels": (f"{aerial} or (kind = 'Duel' and i % 4 = 1)", "1"), "aerial_duels_won": (aerial, "1"),
    }


METRICS_SQL = f"""with b as (select *, event_id::bigint as i, {_list(KINDS)}[1 + event_id % {len(KINDS)}] as kind from events),
 f0 as (select user_id as match_id, i, kind, case when i % 23 <> 0 then 1 + i // 29 % 5 end as period, ((i // 60 % 60) * 60 + i % 60)::double as t, i // 400 as possession, i // 400 % 2 as pteam, i // 200 % 2 as team, case when i % 31 <> 5 then i % 6 end as player,
  case when i % 17 <> 3 then (i * 7 % 121)::double end as x, case when i % 17 <> 3 then (i * 11 % 81)::double end as y, case when i % 19 <> 4 then (i * 13 % 121)::double end as ex, case when i % 19 <> 4 then (i * 5 % 81)::double end as ey, i % 50 as length, (i % 64) / 64.0::double as xg,
  {_list(PASS_TYPES)}[1 + i % {len(PASS_TYPES)}] as ptype, {_list(SHOT_OUTCOMES)}[1 + i % {len(SHOT_OUTCOMES)}] as shot, {_list(DUEL_OUTCOMES)}[1 + i % {len(DUEL_OUTCOMES)}] as duel, {_list(KEEPER)}[1 + i % {len(KEEPER)}] as keeper from b),
 f1 as (select *, sqrt((120 - x) * (120 - x) + (40 - y) * (40 - y)) - sqrt((120 - ex) * (120 - ex) + (40 - ey) * (40 - ey)) as gain from f0 where coalesce(period, 1) <> 5),
 f as (select f1.*, coalesce(s.xg, 0) as axg from f1 left join f1 s on s.match_id = f1.match_id and s.i = f1.i + 2 and s.kind = 'Shot'),
 adds as ({" union all ".join(f"select match_id, player, '{code}' as code, ({v})::double as value from f where player is not null and ({c})" for code, (c, v) in _conditions().items())}),
 pj as (select p.match_id, p.i, p.player, n.i as k, n.period is distinct from p.period or n.t - p.t > 5 as stop, n.pteam = p.team and n.possession <> p.possession as hit from f p join f n on p.match_id = n.match_id and n.i > p.i where p.kind = 'Pressure' and p.player is not null),
 ph as (select match_id, player, min(k) filter (stop) as s, min(k) filter (hit and not coalesce(stop, false)) as h from pj group by match_id, i, player),
 aj as (select s.match_id, s.shot = 'Goal' as goal, a.player from f s join f a on a.match_id = s.match_id and a.possession = s.possession and a.team = s.team and a.i < s.i
  where s.kind = 'Shot' and a.player is not null and (a.kind in ('Shot', 'Foul Won') or (a.kind = 'Pass' and a.i % 4 <> 0) or (a.kind = 'Dribble' and a.i % 2 = 0)) qualify row_number() over (partition by s.match_id, s.i order by a.i desc) <= 2),
 every as (select * from adds union all select match_id, player, 'successful_pressures', 1 from ph where h is not null and (s is null or h < s) union all select match_id, player, 'sca', 1 from aj union all select match_id, player, 'gca', 1 from aj where goal),
 more as (select * from every where code not in ('fifty_fifties', 'fifty_fifties_won') union all select match_id, player, 'defensive_actions', value from every where code in ('tackles', 'interceptions', 'blocks', 'clearances')
  union all select match_id, player, 'ground_duels', value from every where code in ('tackles', 'take_ons', 'dribbled_past', 'fifty_fifties') union all select match_id, player, 'ground_duels_won', value from every where code in ('tackles_won', 'take_ons_won', 'fifty_fifties_won')),
 metrics as (select match_id, player as player_id, code, round(sum(value), 6) as value from more group by all having sum(value) <> 0)"""


@query(METRICS_SQL + " select match_id, player_id, code, value from metrics")
def match_metric_values(spark, d):
    return M.match_metrics(metric_events(spark, d)).withColumn("value", F.round("value", 6))
