"""Fixed values of the domain, as text in natural order."""

from __future__ import annotations

# Pools and thresholds.
MIN_MINUTES_FLOOR = 90
POOL_MIN_MINUTES_LEAGUE = 900
POOL_MIN_MINUTES_TOURNAMENT = 270
POOL_MIN_SIZE = 30
BAND_CUTS = (("A", 0.8), ("B", 0.6), ("C", 0.4))
TIER_MULTIPLIER = {1: 1.0, 2: 0.6, 3: 0.4, 4: 0.3}
STRENGTH_WEIGHTS = {"elo": 0.6, "confed_coeff": 0.15, "xleague_perf": 0.25, "transfer_flow": 0.0}
ADJUST_EXPONENT = {"attacking": 0.5, "passing": 0.35, "possession": 0.35, "defending": 0.2, "duels": 0.2, "goalkeeping": 0.3, "discipline": 0.0, "playing_time": 0.0}

# Similarity.
SIM_DELTA = 1.35
SIM_MIN_USABLE = 0.6
SIM_CANDIDATES = 300
SECONDARY_FACTOR = 0.9
CONFIDENCE_WEIGHTS = {"minutes": 0.35, "completeness": 0.25, "pool": 0.2, "league": 0.2}
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM = 0.75, 0.5
CATEGORY_WEIGHTS = {
    "GK": {"goalkeeping": 0.55, "passing": 0.3, "usage": 0.15},
    "CB": {"defending": 0.35, "duels": 0.2, "passing": 0.25, "possession": 0.1, "attacking": 0.05, "usage": 0.05},
    "FB": {"defending": 0.25, "duels": 0.1, "passing": 0.25, "possession": 0.2, "attacking": 0.15, "usage": 0.05},
    "CM": {"passing": 0.3, "possession": 0.2, "defending": 0.2, "duels": 0.1, "attacking": 0.15, "usage": 0.05},
    "AMW": {"attacking": 0.35, "possession": 0.25, "passing": 0.2, "defending": 0.1, "duels": 0.05, "usage": 0.05},
    "ST": {"attacking": 0.45, "possession": 0.15, "passing": 0.1, "defending": 0.1, "duels": 0.15, "usage": 0.05},
}

# Positional compatibility: symmetric; 1 for the same, 0 between GK and outfield, 0.1 for pairs not listed.
COMPATIBILITY = """
LB-RB 0.85, LB-LWB 0.9, RB-RWB 0.9, LWB-RWB 0.85, LB-RWB 0.75, RB-LWB 0.75, LB-CB 0.45, RB-CB 0.45, LWB-CB 0.3,
RWB-CB 0.3, LWB-LW 0.55, RWB-RW 0.55, LWB-RW 0.45, RWB-LW 0.45, LB-LW 0.35, RB-RW 0.35, LWB-CM 0.35, RWB-CM 0.35,
CB-DM 0.5, CB-CM 0.2, DM-CM 0.8, DM-AM 0.4, CM-AM 0.7, LB-DM 0.3, RB-DM 0.3, LB-CM 0.3, RB-CM 0.3, AM-LW 0.7,
AM-RW 0.7, AM-SS 0.85, AM-ST 0.45, LW-RW 0.9, LW-SS 0.65, RW-SS 0.65, LW-ST 0.5, RW-ST 0.5, SS-ST 0.8, CM-LW 0.3,
CM-RW 0.3, CM-SS 0.35, CM-ST 0.15, DM-LW 0.15, DM-RW 0.15, DM-SS 0.15, DM-ST 0.1, CB-ST 0.05, CB-AM 0.1,
CB-LW 0.05, CB-RW 0.05, CB-SS 0.05
"""
POSITIONS = ("GK", "RB", "CB", "LB", "RWB", "LWB", "DM", "CM", "RW", "LW", "AM", "ST", "SS")
POSITION_OF_ID = {1: ("GK", "GK"), 2: ("RB", "FB"), 3: ("CB", "CB"), 4: ("CB", "CB"), 5: ("CB", "CB"), 6: ("LB", "FB"), 7: ("RWB", "FB"), 8: ("LWB", "FB"), 9: ("DM", "CM"), 10: ("DM", "CM"), 11: ("DM", "CM"), 12: ("RW", "AMW"), 13: ("CM", "CM"), 14: ("CM", "CM"), 15: ("CM", "CM"), 16: ("LW", "AMW"), 17: ("RW", "AMW"), 18: ("AM", "AMW"), 19: ("AM", "AMW"), 20: ("AM", "AMW"), 21: ("LW", "AMW"), 22: ("ST", "ST"), 23: ("ST", "ST"), 24: ("ST", "ST"), 25: ("SS", "AMW")}

# Profile layout: order is the vector's index.
FEATURES = """
attacking npxg:1.5 np_goals:1.0 np_shots:1.0 shots_on_target:0.7 xa:1.2 key_passes:1.0 sca:1.2 touches_att_box:1.2
passing passes:1.0 pass_completion_pct:1.0 progressive_passes:1.4 progressive_pass_distance:0.8 passes_final_third:1.0 passes_into_box:1.0 long_passes:0.8 switches:0.6 crosses:0.8 through_balls:0.6
possession touches:1.0 carries:0.8 progressive_carries:1.4 progressive_carry_distance:0.8 carries_into_box:1.0 take_ons:1.0 take_ons_won:1.0 take_on_success_pct:0.6 miscontrols:0.5 dispossessed:0.5
defending tackles:1.0 tackles_won:0.8 interceptions:1.0 blocks:0.8 clearances:1.0 ball_recoveries:1.0 pressures:1.2 successful_pressures:0.8 counterpressures:0.6 dribbled_past:0.6 fouls_committed:0.5
duels aerial_duels:1.0 aerial_duels_won:1.0 aerial_duel_win_pct:0.8 ground_duels:0.8 ground_duels_won:0.8 fouls_won:0.6
usage starts_share:1.0
"""
GK_FEATURES = """
goalkeeping gk_shots_faced:0.8 gk_saves:1.2 gk_save_pct:1.4 gk_goals_conceded:0.8 gk_sweeper_actions:1.2 gk_claims:1.0 gk_penalties_saved:0.4
passing gk_passes:1.0 gk_pass_completion_pct:1.2 gk_long_passes:1.2 progressive_passes:0.8
usage starts_share:1.0
"""
VECTOR_SIZE = 64

# Ratio metrics: percent of numerator in denominator.
RATES = {
    "pass_completion_pct": ("passes_completed", "passes"),
    "take_on_success_pct": ("take_ons_won", "take_ons"),
    "pressure_success_pct": ("successful_pressures", "pressures"),
    "aerial_duel_win_pct": ("aerial_duels_won", "aerial_duels"),
    "gk_pass_completion_pct": ("gk_passes_completed", "gk_passes"),
}

# Saves in percent of saves and goals conceded.
SAVE_PCT = ("gk_saves", "gk_goals_conceded")
NOT_PER_90 = ("minutes", "minutes_elapsed", "appearances", "starts")
POSITION_SECOND_SHARE, POSITION_SECOND_MINUTES, POSITION_SURE_MINUTES, POSITION_SURE_SHARE = 0.2, 270.0, 900.0, 0.5

# Match events.
GOAL = (120.0, 40.0)
BOX = (102.0, 18.0, 62.0)
FINAL_THIRD, OWN_40, PROGRESSIVE, LONG_PASS = 80.0, 48.0, 10.0, 30.0
PRESSURE_SECONDS = 5.0
CREATING_ACTIONS = 2
SET_PIECES = ("Corner", "Free Kick", "Throw-in", "Goal Kick", "Kick Off")
ON_TARGET = ("Goal", "Saved", "Saved To Post", "Saved Off Target")
DUEL_WON = ("Won", "Success", "Success In Play", "Success Out")
FIFTY_WON = ("Won", "Success To Team")
TOUCHES = ("Pass", "Carry", "Shot", "Dribble", "Ball Receipt*", "Miscontrol", "Ball Recovery", "Clearance", "Interception", "Block", "Foul Won")
BOX_TOUCHES = ("Pass", "Carry", "Shot", "Dribble", "Ball Receipt*", "Miscontrol")
GK_SHOTS = ("Shot Faced", "Shot Saved", "Goal Conceded", "Penalty Saved", "Penalty Conceded")
GK_SAVES = ("Shot Saved", "Penalty Saved")
GK_CLAIMS = ("Collected", "Punch")
RED_CARDS = ("Red Card", "Second Yellow")
YELLOW_CARDS = ("Yellow Card", "Second Yellow")
PERIODS = {1: (0.0, 45.0), 2: (45.0, 45.0), 3: (90.0, 15.0), 4: (105.0, 15.0)}

NAME_SUFFIXES = ("jr", "junior", "sr", "senior", "filho", "neto")
CUP_WORDS = ("cup", "copa", "pokal", "coupe", "coppa")

# Value model.
WINDOW_DAYS, MIN_PRIOR_MINUTES, MIN_COMPLETENESS, REFERENCE_YEAR = 365, 450, 0.6, 2025
# Sums per 90 minutes that are features.
VALUE_CODES = (
    "np_goals", "npxg", "assists", "xa", "np_shots", "key_passes", "sca", "progressive_passes", "progressive_carries", "take_ons_won",
    "touches_att_box", "tackles_won", "interceptions", "pressures", "aerial_duels_won", "aerial_duels",
)
# Competitions that a search leaves out by default: the strongest ones.
EXCLUDE_TOP = 3
AGE_EDGES = (-2, 0, 21, 25, 29, 33, 99)
STRENGTH_EDGES = (-2, 0, 0.4, 0.6, 0.8, 1.01)


def features(layout: str = FEATURES) -> list[tuple[str, str, float]]:
    """(category, code, weight) in vector order."""
    return [(line.split()[0], f.split(":")[0], float(f.split(":")[1])) for line in layout.strip().splitlines() for f in line.split()[1:]]


def compatibility_pairs() -> list[tuple[str, str, float]]:
    """Both directions of the listed pairs, and identity."""
    listed = [(*x.split()[0].split("-"), float(x.split()[1])) for x in COMPATIBILITY.replace("\n", " ").split(",") if x.strip()]
    return listed + [(b, a, v) for a, b, v in listed] + [(p, p, 1.0) for p in POSITIONS]

# Words that club names share, and what marks reserve, youth and women's sides.
CLUB_STOP_WORDS = (
    "fc", "cf", "ud", "rc", "rcd", "sd", "cd", "as", "ac", "us", "ogc", "sc", "ss", "ssc", "afc", "rb", "vfb", "vfl", "sv", "tsg", "fsv", "bsc", "1",
    "real", "club", "de", "la", "deportivo", "olympique", "stade", "athletic", "atletico", "sporting", "racing", "united", "city", "hotspur", "town",
    "wanderers", "albion", "rovers", "calcio", "milan",
)
RESERVE_SIDES = r"\b(w|b|ii|iii|u1[6-9]|u2[0-3]|youth|reserves?|women|ladies|lfc|wfc|femenino|feminino)$"
