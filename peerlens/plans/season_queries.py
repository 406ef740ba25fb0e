"""Queries of the season tables: appearances are orders, statistics their line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import aggregates
from .queries import query, table

CODES = ("passes", "passes_completed", "take_ons", "take_ons_won", "gk_saves", "gk_goals_conceded", "npxg")
PLACES = ("CB", "CM", "ST", "LW", "unknown_1")

_HALVES = sorted({c for pair in C.RATES.values() for c in pair} | {*C.SAVE_PCT})
_RATES = ", ".join([f"case when {b} > 0 then 100.0 * {a} / {b} end as {n}" for n, (a, b) in C.RATES.items()] + ["case when gk_saves + gk_goals_conceded > 0 then 100.0 * gk_saves / (gk_saves + gk_goals_conceded) end as gk_save_pct"])
_WIDE = ", ".join(f"coalesce(sum(value) filter (code = '{c}'), 0.0)::double as {c}" for c in [*_HALVES, "minutes", "appearances"])


def _level(name: str, ids: str) -> str:
    return f"""{name}_w as (select {ids}, {_WIDE} from base group by all),
 {name}_r as (unpivot (select {ids}, minutes, appearances, {_RATES} from {name}_w) on {", ".join([*C.RATES, "gk_save_pct"])} into name code value value),
 {name} as (select {ids}, code, value, true as is_rate, minutes, appearances from {name}_r union all select {ids}, b.code, b.value, false, w.minutes, w.appearances from (select {ids}, code, sum(value) as value from base group by all) b join {name}_w w using ({ids}))"""


SEASON_SQL = f"""with a as (select o_custkey as player_id, year(o_orderdate)::bigint as season_id, o_orderkey % 3 as team_id, o_orderkey as match_id, o_orderdate::date as day, (o_orderkey % 91)::double as minutes, (o_orderkey % 97)::double as elapsed,
  (o_orderkey % 2)::double as started, (o_orderkey % 11 = 0)::int::double as yellow, (o_orderkey % 31 = 0)::int::double as red, 1 + o_orderkey % 2 as source_id,
  ['CB', 'CM', 'ST', 'LW', 'unknown_1'][1 + o_custkey % 5] as p1, ['CB', 'CM', 'ST', 'LW', 'unknown_1'][1 + (o_orderkey + o_custkey) % 5] as p2 from orders),
 st as (select player_id, season_id, team_id, ['passes', 'passes_completed', 'take_ons', 'take_ons_won', 'gk_saves', 'gk_goals_conceded', 'npxg'][1 + l_linenumber % 7] as code, round(l_quantity)::double / 4.0::double as value from lineitem join a on l_orderkey = match_id),
 long as (select player_id, season_id, team_id, unnest(['minutes', 'minutes_elapsed', 'appearances', 'starts', 'yellow_cards', 'red_cards']) as code, unnest([minutes, elapsed, (minutes > 0)::int::double, started, yellow, red]) as value from a union all select * from st),
 base as (select player_id, season_id, team_id, code, sum(value)::double as value from long group by all),
 src as (select player_id, season_id, (1 + max(date_diff('day', date '1970-01-01', day)::bigint * 100000000 + match_id) % 100000000 % 2)::bigint as source_id from a group by all),
 {_level("team", "player_id, season_id, team_id")},
 {_level("season", "player_id, season_id")},
 sp as (select *, case when not is_rate and code not in ('minutes', 'minutes_elapsed', 'appearances', 'starts') and minutes > 0 then round(value / (minutes / 90.0::double), 5) end as per90 from season),
 mp as (select player_id, season_id, p1 as code, minutes as m from a union all select player_id, season_id, p2, elapsed from a where p1 <> p2),
 ps as (select player_id, season_id, code, sum(m)::double as m from mp where code not like 'unknown%' group by all having sum(m) > 0),
 pt as (select *, sum(m) over (partition by player_id, season_id) as total, row_number() over (partition by player_id, season_id order by m desc, code desc) as rank from ps),
 pf as (select *, m / total as share, max(m / total) over (partition by player_id, season_id) as top from pt)"""


def _tables(spark, d) -> dict[str, DataFrame]:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    place = lambda n: F.get(F.array(*map(F.lit, PLACES)), (n % 5).cast("int"))
    first, second = place(F.col("o_custkey")), place(k + F.col("o_custkey"))
    minutes, elapsed = (k % 91).cast("double"), (k % 97).cast("double")
    a = o.select(
        F.col("o_custkey").alias("player_id"), F.year("o_orderdate").cast("long").alias("season_id"), (k % 3).alias("team_id"), k.alias("match_id"), F.to_date("o_orderdate").alias("day"), minutes.alias("minutes"), elapsed.alias("minutes_elapsed"),
        (k % 2 == 1).alias("started"), (k % 11 == 0).cast("int").alias("yellow_cards"), (k % 31 == 0).alias("red_card"), (1 + k % 2).alias("source_id"),
        F.map_from_entries(F.filter(F.array(F.struct(first.alias("k"), minutes.alias("v")), F.struct(F.when(first != second, second).alias("k"), elapsed.alias("v"))), lambda e: e["k"].isNotNull())).alias("minutes_by_position"),
    )
    code = F.get(F.array(*map(F.lit, CODES)), (F.col("l_linenumber") % 7).cast("int"))
    s = table(spark, d, "lineitem").join(a.select("match_id", "player_id", "season_id", "team_id"), F.col("l_orderkey") == F.col("match_id"))
    s = s.select("player_id", "season_id", "team_id", code.alias("code"), (F.round("l_quantity") / 4.0).alias("value"))
    return aggregates.season_tables(a, s, run="r1", timestamp=F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query(SEASON_SQL + " select player_id, season_id, team_id, code, round(value, 4) as value, round(minutes, 2) as minutes, appearances::int as appearances, source_id from team join src using (player_id, season_id)")
def season_team_stats(spark, d):
    return _tables(spark, d)["team_stats"]


@query(SEASON_SQL + " select player_id, season_id, code, round(value, 4) as value, round(minutes, 2) as minutes, per90, appearances::int as appearances, source_id, 'single_source' as resolution_rule, false as has_conflict from sp join src using (player_id, season_id)")
def season_player_stats(spark, d):
    return _tables(spark, d)["season_stats"]


@query(SEASON_SQL + " select player_id, season_id, null::bigint as team_id, code, round(value, 4) as value, round(minutes, 2) as minutes_basis, source_id, '2024-01-01 00:00:00' as source_timestamp, 'event_derived' as data_quality, 'events (season ' || season_id || ')' as raw_ref, 'r1' as run from sp join src using (player_id, season_id)")
def season_observations(spark, d):
    return _tables(spark, d)["observations"].withColumn("source_timestamp", F.date_format("source_timestamp", "yyyy-MM-dd HH:mm:ss"))


@query(SEASON_SQL + " select player_id, season_id, code, m as minutes, round(share, 9) as share, rank::int as rank, case when total >= 900 and top >= 0.5 then 'high' else 'medium' end as confidence, source_id from pf join src using (player_id, season_id) where rank = 1 or (rank = 2 and share >= 0.2 and m >= 270)")
def season_positions(spark, d):
    return _tables(spark, d)["positions"].withColumn("share", F.round("share", 9))
