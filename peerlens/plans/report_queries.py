"""Queries of reports, of the quality scan, of appearances from lineups, and of keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality_scan, report, sequence
from ..sources import sinks
from .queries import query, table

REPORT_SQL = """with o as (select o_custkey as player_id, count(*) as appearances, sum(o_orderkey % 2) as starts, sum(o_orderkey % 91)::double as minutes from orders group by 1),
 s as (select c_custkey as player_id, c_name as display_name, case when c_custkey % 4 <> 0 then ['CB', 'CM', 'ST'][1 + c_custkey % 3] end as position, case when c_custkey % 4 <> 0 then ['CB', 'CM', 'ST'][1 + c_custkey % 3] end as position_group, case when c_nationkey % 5 <> 0 then n_name end as nationality,
  case when c_custkey % 6 <> 0 then (18 + c_custkey % 20)::bigint end as age, minutes, appearances, starts, case when c_custkey % 3 = 0 then [c_mktsegment, 'Second'] else [c_mktsegment] end as teams, case when c_custkey % 7 <> 0 then (c_custkey % 10 / 10.0)::double end as strength from customer join o on o.player_id = c_custkey join nation on n_nationkey = c_nationkey),
 m as (select o_custkey as player_id, o_orderkey as place, 'M' || (o_orderkey % 50) as name, case when o_orderkey % 6 = 0 then 'discipline' else 'passing' end as family, (o_orderkey % 1000 / 10.0)::double as value, (o_orderkey % 900 / 100.0)::double as per90, o_orderkey % 3 = 0 as is_rate,
  case when o_orderkey % 5 <> 0 then (o_orderkey * 7 % 101)::double end as percentile, 'P' || (o_custkey % 3) as pool, 30 + o_orderkey % 100 as pool_n from orders),
 ml as (select *, name || ' ' || case when is_rate then printf('%.1f', value) || '%' else printf('%.2f', per90) || '/90' end || ' (' || printf('%.0f', percentile) || 'th, pool n=' || pool_n || ')' as line from m where percentile is not null and family <> 'discipline'),
 mr as (select *, row_number() over (partition by player_id order by percentile desc, place) as up, row_number() over (partition by player_id order by percentile, place) as down, row_number() over (partition by player_id order by percentile) as nth, count(*) over (partition by player_id) as n from ml),
 mm as (select player_id, max(n) as n, string_agg(case when up <= 5 then line end, '; ' order by up) as strengths, string_agg(case when down <= 5 then line end, '; ' order by down) as weaknesses, max(case when nth = 1 + n // 2 then percentile end) as middle, min(pool) as pool from mr group by 1),
 a as (select player_id, count(*) as total from m group by 1),
 v as (select c_custkey as player_id, c_custkey * 10000.0 as value, c_custkey * 5000.0 as low, c_custkey * 20000.0 as high from customer where c_custkey % 2 = 0)"""


@query(REPORT_SQL + """ select s.player_id, display_name || ' (' || coalesce(position, 'position unknown') || ', ' || coalesce(nationality, 'nationality unavailable') || coalesce(', age ' || age, ', age unavailable') || ') played ' || printf('%.0f', minutes) || ' minutes in ' || appearances || ' appearances (' || starts || ' starts) for ' || array_to_string(teams, ' / ') || ' in League 2001.' as overview,
 coalesce(n, 0) || ' of ' || coalesce(total, 0) || ' metrics have a percentile within the ' || coalesce(position_group, 'None') || ' pool (pool: ' || coalesce(pool, 'none of sufficient size') || ').' as statistical_profile,
 coalesce(strengths, 'No percentile pool of sufficient size.') as key_strengths, coalesce(weaknesses, 'No percentile pool of sufficient size.') as weaknesses,
 coalesce('League strength ' || printf('%.2f', strength) || ' (medium); adjusted values use default exponents (unfitted).', 'No league-strength score (national-team tournament or no measured input); raw percentiles are against the tournament pool.') as league_context,
 coalesce('Median percentile across available metrics: ' || printf('%.0f', middle) || 'th.', 'Insufficient comparable players.') as performance_level,
 coalesce('€' || printf('%.1f', value / 1e6) || 'M (range €' || printf('%.1f', low / 1e6) || 'M–€' || printf('%.1f', high / 1e6) || 'M, confidence high)', 'Data unavailable: no active model or no prediction') as estimated_transfer_value,
 'Sample size ' || printf('%.0f', minutes) || ' minutes' || case when minutes < 900 then ' (< 900: treat with caution)' else '' end as first_limitation
 from s left join mm using (player_id) left join a using (player_id) left join v using (player_id)""")
def scouting_reports(spark, d):
    """A report for every player."""
    c, o, n = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "nation")
    k, ck = F.col("o_orderkey"), F.col("c_custkey")
    played = o.groupBy(F.col("o_custkey").alias("player_id")).agg(F.count("*").alias("appearances"), F.sum(k % 2).alias("starts"), F.sum((k % 91).cast("double")).alias("minutes"))
    place = F.when(ck % 4 != 0, F.get(F.array(F.lit("CB"), F.lit("CM"), F.lit("ST")), (ck % 3).cast("int")))
    s = c.join(n, c.c_nationkey == n.n_nationkey).select(
        ck.alias("player_id"), F.col("c_name").alias("display_name"), place.alias("position"), place.alias("position_group"), F.when(F.col("c_nationkey") % 5 != 0, F.col("n_name")).alias("nationality"), F.when(ck % 6 != 0, 18 + ck % 20).alias("age"),
        F.when(ck % 3 == 0, F.array("c_mktsegment", F.lit("Second"))).otherwise(F.array("c_mktsegment")).alias("teams"), F.lit("League").alias("competition"), F.lit("2001").alias("season"), F.when(ck % 7 != 0, ck % 10 / 10.0).alias("strength"), F.lit("medium").alias("strength_confidence"),
    ).join(played, "player_id")
    m = o.select(
        F.col("o_custkey").alias("player_id"), k.alias("place"), F.concat(F.lit("M"), (k % 50).cast("string")).alias("name"), F.when(k % 6 == 0, "discipline").otherwise("passing").alias("family"), (k % 1000 / 10.0).alias("value"), (k % 900 / 100.0).alias("per90"), (k % 3 == 0).alias("is_rate"),
        F.when(k % 5 != 0, (k * 7 % 101).cast("double")).alias("percentile"), F.concat(F.lit("P"), (F.col("o_custkey") % 3).cast("string")).alias("pool"), (30 + k % 100).alias("pool_n"),
    )
    v = c.filter(ck % 2 == 0).select(ck.alias("player_id"), (ck * 10000.0).alias("value"), (ck * 5000.0).alias("low"), (ck * 20000.0).alias("high"), F.lit("high").alias("confidence"))
    x = report.reports(s, m, v)
    return x.select("player_id", "overview", "statistical_profile", F.array_join("key_strengths", "; ").alias("key_strengths"), F.array_join("weaknesses", "; ").alias("weaknesses"), "league_context", "performance_level", "estimated_transfer_value", F.col("model_limitations")[0].alias("first_limitation"))


@query("""with a as (select o_orderkey % 2000 as match_id, o_custkey % 3 as team_id, sum(o_orderkey % 200)::bigint as total from orders group by 1, 2)
 select 'player' as entity_type, c_custkey as entity_id, null::bigint as season_id, 'missing_date_of_birth' as code, 'info' as severity, 'age unavailable; excluded from age-filtered searches' as detail from customer where c_custkey % 9 = 0 and c_custkey % 2 = 0
 union all select 'player', o_custkey, year(o_orderdate), 'small_sample_season', 'warning', sum(o_orderkey % 91)::bigint || ' 270' from orders group by o_custkey, year(o_orderdate) having sum(o_orderkey % 91) < 270
 union all select 'season', n_nationkey, n_nationkey, 'single_team_coverage', 'warning', n_name || ' excluded from percentile pools' from nation where n_regionkey = 2
 union all select 'player', l_suppkey, null, 'pending_identity_review', 'info', l_orderkey || ' ' || l_partkey || ' ' || l_linenumber from lineitem where l_returnflag = 'R'
 union all select 'match', match_id, null, 'match_minutes_mismatch', 'warning', team_id || ' ' || total || ' 990' from a where abs(total - 990) > 0.05 * 990""")
def quality_flags(spark, d):
    """All five rules over whole tables."""
    c, o, k = table(spark, d, "customer"), table(spark, d, "orders"), F.col("o_orderkey")
    ck = F.col("c_custkey")
    players = c.select(ck.alias("player_id"), F.when(ck % 9 != 0, F.lit("1990-01-01").cast("date")).alias("born"), F.when(ck % 2 == 1, ck).alias("merged_into"))
    stats = o.groupBy(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season_id")).agg(F.sum(k % 91).alias("minutes"))
    seasons = table(spark, d, "nation").select(F.col("n_nationkey").alias("season_id"), F.when(F.col("n_regionkey") == 2, "single_team").otherwise("full_league").alias("coverage"), F.col("n_name").alias("note"))
    reviews = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), F.col("l_suppkey").alias("player_id"), F.col("l_partkey").alias("source_player_id"), F.col("l_linenumber").alias("score"), F.when(F.col("l_returnflag") == "R", "pending").otherwise("approved").alias("status"))
    apps = o.select((k % 2000).alias("match_id"), (F.col("o_custkey") % 3).alias("team_id"), (k % 200).alias("minutes"))
    matches = apps.select("match_id").distinct().withColumn("regulation", F.lit(90))
    x = quality_scan.scan(players, stats, seasons, reviews, apps, matches)
    return x.withColumn("detail", F.array_join(F.map_values("details"), " ")).drop("details")


@query("""with l as (select l_orderkey as match_id, l_partkey as player_id, 1 + l_linenumber % 4 as pos, 1 + l_linenumber % 2 as fp, 45.0 * (l_linenumber % 2) + l_quantity::bigint % 50 as f, case when l_linenumber % 3 <> 0 then 45.0 + l_quantity::bigint % 60 end as t, l_linenumber % 5 = 0 as first,
  (2700 + l_orderkey % 300) / 60.0::double as d1, (2700 + l_orderkey % 400) / 60.0::double as d2 from lineitem),
 n as (select *, least(greatest(f, 45.0 * (fp - 1)), 45.0 * fp) as fn, case when t is null then 90.0 else least(greatest(t, 45.0), 90.0) end as tn, case fp when 1 then 0 else d1 end + least(greatest(f - 45.0 * (fp - 1), 0), case fp when 1 then d1 else d2 end) as fe, case when t is null then d1 + d2 else d1 + least(greatest(t - 45.0, 0), d2) end as te from l),
 p as (select match_id, player_id, pos, sum(greatest(tn - fn, 0))::double as nom, sum(greatest(te - fe, 0))::double as el, bool_or(first) as first from n group by all)
 select match_id, player_id, round(sum(nom), 2) as minutes_nominal, round(sum(el), 2) as minutes_elapsed, bool_or(first) as started, count(*) filter (nom > 0) as n_positions from p group by 1, 2""")
def lineup_appearances(spark, d):
    """Minutes on both clocks out of lineup segments; the halves' lengths come from their end events."""
    li, q, i = table(spark, d, "lineitem"), F.col("l_quantity").cast("long"), F.col("l_linenumber")
    ends = table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), F.explode(F.array(F.struct(F.lit(1).alias("period"), (2700 + F.col("o_orderkey") % 300).cast("double").alias("t")), F.struct(F.lit(2).alias("period"), (2700 + F.col("o_orderkey") % 400).cast("double").alias("t")))).alias("e"))
    durations = sequence.period_durations(ends.select("match_id", "e.period", F.lit("Half End").alias("type"), "e.t"))
    segments = li.select(
        F.col("l_orderkey").alias("match_id"), F.col("l_partkey").alias("player_id"), (1 + i % 4).alias("position_id"), (45.0 * (i % 2) + q % 50).alias("from_min"), F.when(i % 3 != 0, 45.0 + q % 60).alias("to_min"),
        (1 + i % 2).alias("from_period"), F.when(i % 3 != 0, F.lit(2)).alias("to_period"), F.when(i % 5 == 0, "Starting XI").otherwise("Substitution").alias("start_reason"),
    )
    return sequence.appearances(segments, durations).withColumn("n_positions", F.size("minutes_by_position").cast("long")).drop("minutes_by_position")


@query("""select c_custkey as id, c_nationkey as place from customer where c_custkey % 3 = 0 union all select distinct o_custkey, 99 from orders where o_custkey not in (select c_custkey from customer where c_custkey % 3 = 0)""")
def insert_if_absent(spark, d):
    """Keys that a table lacks are inserted, once each; those it has stay as they are."""
    current = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("place"))
    incoming = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lit(99).alias("place"))
    return current.unionByName(sinks.new_rows(current, incoming, ["id"]))
