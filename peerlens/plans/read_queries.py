"""Queries of the read operators, rules, value features and club names, each with its SQL oracle beside it."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import rules
from ..operators import identity, reads, similar_players, similarity, value_features
from .queries import ORACLE_SQL, cents, query, table, year

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
COUNTS_SQL = " union all ".join(f"""select '{t}' as "table", count(*)::bigint as n from {t}""" for t in TABLES)


def _tables(spark, d):
    return {t: table(spark, d, t) for t in TABLES}


@query(COUNTS_SQL)
def row_counts(spark, d):
    return reads.row_counts(_tables(spark, d))


SEASONS_SQL = """with m as (select c_nationkey * 10000 + year(o_orderdate) as season_id, o_orderdate::date as date from orders join customer on o_custkey = c_custkey),
 s as (select n_nationkey as competition_id, n_nationkey * 10000 + y as season_id, y::bigint as end_year, 'C' || (y % 3) as coverage, make_date(y, 1, 1) as starts, make_date(y, 12, 31) as ends from nation, (select unnest(range(1994, 2003)) as y)),
 p as (select season_id, count(*) as n, min(date) as lo, max(date) as hi from m group by 1)"""


def _seasons(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    matches = o.join(c, o.o_custkey == c.c_custkey).select((F.col("c_nationkey") * 10000 + F.year("o_orderdate")).alias("season_id"), F.to_date("o_orderdate").alias("date"))
    y = F.col("end_year")
    s = n.select(F.col("n_nationkey").alias("competition_id"), F.explode(F.sequence(F.lit(1994).cast("long"), F.lit(2002).cast("long"))).alias("end_year"))
    s = s.withColumns({"season_id": F.col("competition_id") * 10000 + y, "coverage": F.concat(F.lit("C"), (y % 3).cast("string")), "starts": F.make_date(y.cast("int"), F.lit(1), F.lit(1)), "ends": F.make_date(y.cast("int"), F.lit(12), F.lit(31))})
    return s, matches


@query(SEASONS_SQL + """ select competition_id, coalesce(sum(n), 0)::bigint as matches, string_agg(end_year || ' ' || coverage || ' ' || case when end_year % 2 = 0 then (end_year - 1990)::varchar else 'none' end, '; ' order by end_year desc) as seasons from s left join p using (season_id) group by 1""")
def competition_listing(spark, d):
    s, matches = _seasons(spark, d)
    strength = s.filter("end_year % 2 = 0").select("season_id", (F.col("end_year") - 1990).alias("strength"))
    x = reads.competitions(s, matches, strength)
    line = lambda r: F.concat_ws(" ", r["end_year"], r["coverage"], F.coalesce(r["strength"].cast("string"), F.lit("none")))
    return x.select("competition_id", "matches", reads.joined(F.transform("seasons", line)).alias("seasons"))


@query(SEASONS_SQL + """ select season_id, coverage, coalesce(lo, starts)::varchar as starts, coalesce(hi, ends)::varchar as ends from s left join p using (season_id)""")
def season_bounds(spark, d):
    x = reads.season_bounds(*_seasons(spark, d))
    return x.select("season_id", "coverage", F.col("starts").cast("string").alias("starts"), F.col("ends").cast("string").alias("ends"))


PLAYERS_SQL = """with p as (select c_custkey as player_id, c_name as full_name, case c_custkey % 3 when 1 then ' ' when 2 then c_mktsegment end as known_as, case when c_custkey % 7 <> 0 then date '1975-01-01' + (c_custkey % 9000)::int end as born from customer),
 so as (select o_custkey as player_id, list_sort(list_distinct(list(o_orderstatus))) as codes from orders group by 1),
 se as (select o_custkey as player_id, year(o_orderdate)::bigint as end_year, sum(o_orderkey % 900)::bigint as minutes, o_custkey * 10000 + year(o_orderdate) as season_id from orders group by all)"""


def _players(spark, d):
    c, o, k = table(spark, d, "customer"), table(spark, d, "orders"), F.col("c_custkey")
    born = F.when(k % 7 != 0, F.date_add(F.lit("1975-01-01").cast("date"), (k % 9000).cast("int")))
    players = c.select(k.alias("player_id"), F.col("c_name").alias("full_name"), F.when(k % 3 == 1, " ").when(k % 3 == 2, F.col("c_mktsegment")).alias("known_as"), born.alias("born"))
    sources = o.select(F.col("o_custkey").alias("player_id"), F.col("o_orderstatus").alias("code"))
    seasons = o.groupBy(F.col("o_custkey").alias("player_id"), year("o_orderdate").alias("end_year")).agg(F.sum(F.col("o_orderkey") % 900).alias("minutes")).withColumn("season_id", F.col("player_id") * 10000 + F.col("end_year"))
    return players, sources, seasons


@query(PLAYERS_SQL + """ select player_id, case when trim(known_as) <> '' then known_as else full_name end as display_name, coalesce(array_to_string(codes, ','), '') as sources, latest_season, round((date '2024-06-30' - born) / 365.25::double, 1) as age,
 case when born is null then 'Data unavailable: no date of birth' end as age_note from p left join so using (player_id) left join (select player_id, max(season_id)::bigint as latest_season from se group by 1) using (player_id)""")
def player_summary(spark, d):
    players, sources, seasons = _players(spark, d)
    x = reads.player_summary(players, sources, seasons, F.lit("2024-06-30").cast("date"))
    return x.select("player_id", "display_name", reads.joined(F.col("sources"), ",").alias("sources"), F.col("latest_season").cast("long").alias("latest_season"), "age", "age_note")


@query(PLAYERS_SQL + """, a as (select player_id, count(*) as n, sum(minutes) as t, max(minutes) as most from se group by 1) select player_id, coalesce(n, 0)::bigint as seasons_loaded, coalesce(t, 0)::bigint as total_minutes, coalesce(len(codes), 0)::bigint as n_sources,
 concat_ws(',', case when born is null then 'missing_date_of_birth' end, case when most < 900 then 'small_sample' end) as flags from p left join so using (player_id) left join a using (player_id)""")
def player_quality(spark, d):
    players, sources, seasons = _players(spark, d)
    x = reads.player_quality(players, seasons, sources)
    return x.select("player_id", "seasons_loaded", F.col("total_minutes").cast("long").alias("total_minutes"), "n_sources", reads.joined(F.col("flags"), ",").alias("flags"))


@query("""with l as (select l_suppkey as player_id, year(l_shipdate)::bigint as season_id, l_returnflag as code, round(l_quantity)::bigint as q, case l_linestatus when 'F' then 'raw' else 'adjusted' end as family, l_linenumber % 3 as g from lineitem),
 s as (select player_id, season_id, code, sum(q)::bigint as value from l group by all), t as (select player_id, season_id, code, family, g, (sum(q) % 100)::bigint as percentile, count(*)::bigint as pool_n from l group by all),
 m as (select player_id, season_id, code, max(percentile) filter (family = 'raw') as percentile, max(pool_n) filter (family = 'raw') as pool_n, max(percentile) filter (family = 'adjusted') as adjusted_percentile from t where g = player_id % 3 and player_id % 5 <> 0 group by all)
 select s.*, m.percentile, m.pool_n, m.adjusted_percentile from s left join m using (player_id, season_id, code)""")
def player_stats(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("player_id"), year("l_shipdate").alias("season_id"), F.col("l_returnflag").alias("code"), F.round("l_quantity").cast("long").alias("q"), F.when(F.col("l_linestatus") == "F", "raw").otherwise("adjusted").alias("family"), (F.col("l_linenumber") % 3).cast("long").alias("group"))
    keys = ["player_id", "season_id", "code"]
    stats = l.groupBy(*keys).agg(F.sum("q").alias("value"))
    pct = l.groupBy(*keys, "family", "group").agg((F.sum("q") % 100).alias("percentile"), F.count("*").alias("pool_n"))
    positions = stats.filter("player_id % 5 <> 0").select("player_id", "season_id", (F.col("player_id") % 3).alias("group")).distinct()
    return reads.player_stats(stats, pct, positions)


@query("""with p as (select o_custkey as player_id, o_orderdate as as_of, round(o_totalprice * 100)::bigint as value, o_orderpriority as confidence from orders where o_orderkey % 3 = 1), l as (select * from p qualify row_number() over (partition by player_id order by as_of desc, value desc, confidence desc) = 1)
 select c_custkey as player_id, value, value - 100 as low, value + 100 as high, coalesce(confidence, 'insufficient') as confidence, case when value is null then 'Data unavailable: no active model or no prediction' else 'ok' end as status from customer left join l on player_id = c_custkey""")
def latest_value(spark, d):
    v = cents("o_totalprice")
    predictions = table(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("run_id"), F.col("o_custkey").alias("player_id"), F.col("o_orderdate").alias("as_of"), v.alias("value"), (v - 100).alias("low"), (v + 100).alias("high"), F.col("o_orderpriority").alias("confidence"))
    runs = value_features.activate(spark.range(3).withColumnRenamed("id", "run_id"), 1)
    return reads.latest_value(table(spark, d, "customer").select(F.col("c_custkey").alias("player_id")), predictions, runs)


@query("""with t as (select c_custkey, embedding as e from customer join embeddings on vec_id = c_custkey left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey where c_name ilike '%#%7%' order by coalesce(n, 0) desc, c_custkey limit 1)
 select vec_id as candidate, round(sqrt(list_sum(list_transform(list_zip(embedding, t.e), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))), 9) as distance from embeddings, t where vec_id <> c_custkey order by distance, vec_id limit 20""")
def scouting_nearest(spark, d):
    """The player that a name stands for, of several the one who played most, and who is most like them."""
    c, e = table(spark, d, "customer"), table(spark, d, "embeddings")
    played = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    known = c.join(played, "c_custkey", "left").join(e.select(F.col("vec_id").alias("c_custkey"), "embedding"), "c_custkey")
    who = reads.search(known, F.col("c_name"), "#%7", [F.coalesce("n", F.lit(0)).desc(), F.col("c_custkey")], 1).first()
    near = similarity.nearest(e.filter(F.col("vec_id") != who["c_custkey"]).select("vec_id", F.col("embedding").alias("vector")), who["embedding"], key="vec_id", k=20)
    return near.select(F.col("vec_id").alias("candidate"), F.round("distance", 9).alias("distance"))


@query("""select s_suppkey as team_id, s_name as name, n_name as country from supplier join nation on s_nationkey = n_nationkey where s_name ilike '%SUPPLIER#%3%' order by name limit 50""")
def team_listing(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    x = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("name"), F.col("n_name").alias("country"))
    return reads.search(x, F.col("name"), "SUPPLIER#%3", [F.col("name")], 50)


@query(f"""with c as ({COUNTS_SQL}) select 'rows ' || "table" as name, n::varchar as value from c union all select 'last job', (select event_type from events order by ts desc, event_id desc, event_type desc limit 1)
 union all select 'pending reviews', (select count(*) filter (o_orderstatus = 'P') from orders)::varchar union all select 'flags ' || c_mktsegment, count(*)::varchar from customer where c_acctbal < 0 group by c_mktsegment""")
def dashboard(spark, d):
    t = _tables(spark, d)
    jobs = t["events"].select(F.col("event_id").alias("job_id"), F.col("ts").alias("started"), F.col("event_type").alias("state"))
    reviews = t["orders"].select(F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    return reads.dashboard(t, jobs, reviews, t["customer"].select(F.col("c_mktsegment").alias("severity"), (F.col("c_acctbal") < 0).alias("open")))


@query("""select to_json({'id': c_custkey, 'name': c_name, 'balance': case when c_custkey % 4 <> 0 then round(c_acctbal)::bigint end, 'balance_note': case when c_custkey % 4 = 0 then 'Data unavailable: no account' end})::varchar as body from customer""")
def response_shape(spark, d):
    c = table(spark, d, "customer")
    fields = {"id": F.col("c_custkey"), "name": F.col("c_name"), "balance": F.when(F.col("c_custkey") % 4 != 0, F.round("c_acctbal").cast("long"))}
    return reads.shaped(c, fields, {"balance": "no account"})


@query("""with x as (select c_custkey as id, case when c_custkey % 7 <> 0 then date '1975-01-01' + (c_custkey % 12000)::int end as born, 2000 + c_custkey % 20 as y, ['GK', 'CB', 'ST'][(c_custkey % 3 + 1)::int] as g, ['outfield', 'goalkeeper', 'all'][(c_custkey // 3 % 3 + 1)::int] as scope, ['playing_time', 'passing'][(c_custkey % 2 + 1)::int] as family from customer)
 select id, coalesce((make_date(y, 6, 30) - born) / 365.25::double between 18 and 23, false) as young, case when g = 'GK' then scope <> 'outfield' else scope <> 'goalkeeper' end as in_scope, family <> 'playing_time' and (id % 5 = 0 or id % 4 = 0) as eligible,
 (make_date(y, 6, 30) - born) / 365.25::double >= 15 and (make_date(y + 9, 6, 30) - born) / 365.25::double <= 45 as plausible, case when id % 6 <> 0 then (id % 4)::double / (id % 6)::double end as starts_share from x""")
def eligibility_rules(spark, d):
    k = F.col("c_custkey")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    born = F.when(k % 7 != 0, F.date_add(F.lit("1975-01-01").cast("date"), (k % 12000).cast("int")))
    y = (2000 + k % 20).cast("int")
    day = lambda after: F.make_date(y + after, F.lit(6), F.lit(30))
    return table(spark, d, "customer").select(
        k.alias("id"),
        rules.age_between(born, y, 18, 23).alias("young"),
        rules.in_scope(pick(("outfield", "goalkeeper", "all"), F.floor(k / 3) % 3), pick(("GK", "CB", "ST"), k % 3)).alias("in_scope"),
        rules.metric_eligible(pick(("playing_time", "passing"), k % 2), k % 5 == 0, k % 4 == 0).alias("eligible"),
        rules.plausible_age(born, day(0), day(9)).alias("plausible"),
        rules.starts_share(k % 4, k % 6).alias("starts_share"),
    )


@query("""with s as (select n_name as key, n_regionkey::varchar as value from nation where n_nationkey % 2 = 0), f as (select n_name as key, 'default' as value from nation where n_nationkey % 3 <> 0) select key, coalesce(s.value, f.value) as value from f full join s using (key)""")
def config_values(spark, d):
    n = table(spark, d, "nation")
    return rules.with_defaults(n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")), n.filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("key"), F.lit("default").alias("value")))


@query("""with r as (select c_custkey as id, case when c_custkey % 7 <> 0 then 6000 + c_custkey % 8000 end as age_days from customer), t as (select 5000 + o_orderkey % 9000 as age_days from orders where o_orderstatus = 'F'),
 n as (select r.id, r.age_days, count(t.age_days)::bigint as n_comparables from r left join (select age_days from t) t on t.age_days between r.age_days - 730 and r.age_days + 730 group by r.id, r.age_days),
 s as (select *, 0.35 * least(1.0, (id % 3000) / 1800.0) + 0.25 * ((id % 11) / 10.0) + 0.2 * least(1.0, n_comparables / 100.0) + 0.2 * greatest(0.0, 1 - ((id % 40) / 10.0) / 3.0) as score from n)
 select id, n_comparables, case when id % 3000 < 450 or id % 11 < 6 then 'low' when score >= 0.75 and n_comparables >= 30 then 'high' when score >= 0.5 then 'medium' else 'low' end as tier, (id % 40) / 10.0::double as width from s""")
def prediction_confidence(spark, d):
    k = F.col("c_custkey")
    r = table(spark, d, "customer").select(k.alias("id"), F.when(k % 7 != 0, 6000 + k % 8000).alias("age_days"))
    t = table(spark, d, "orders").filter("o_orderstatus = 'F'").select((5000 + F.col("o_orderkey") % 9000).alias("age_days"))
    x, i = value_features.comparables(r, t), F.col("id")
    c = value_features.prediction_confidence((i % 3000).cast("double"), (i % 11) / 10.0, F.col("n_comparables"), F.lit(10.0), F.lit(10.0) + (i % 40), F.lit(10.0))
    return x.select("id", "n_comparables", c["tier"].alias("tier"), c["width"].alias("width"))


@query("""with p as (select o_orderpriority as band, ln(1 + round(o_totalprice))::double as label, ln(1 + round(o_totalprice) * (0.33 + (o_orderkey % 10) / 10.0))::double as predicted from orders)
 select band, count(*)::bigint as n, round(avg(abs(label - predicted)), 6) as mae_log, round(avg((abs(exp(predicted) - exp(label)) <= 0.5 * (exp(label) - 1))::int), 6) as within_50 from p group by 1 having count(*) >= 5""")
def band_evaluation(spark, d):
    v = F.round("o_totalprice")
    p = table(spark, d, "orders").select(F.col("o_orderpriority").alias("band"), F.log1p(v).alias("label"), F.log1p(v * (F.lit(0.33) + (F.col("o_orderkey") % 10) / F.lit(10.0))).alias("predicted"))
    return value_features.evaluate_by(p, "band").select("band", "n", F.round("mae_log", 6).alias("mae_log"), F.round("within_50", 6).alias("within_50"))


@query("""with x as (select c_custkey as id, round(2.0 * ((c_custkey % 50) - 25.0) / 10.0, 4) as a, round(-1.5 * ((c_custkey % 30) - 10.0) / 5.0, 4) as b, round(0.25 * ((c_custkey % 9) - 4.0) / 2.0, 4) as c from customer), u as (select id, unnest(['a', 'b', 'c']) as feature, unnest([a, b, c])::double as contribution from x)
 select id, feature, contribution, row_number() over (partition by id order by abs(contribution) desc, feature)::bigint as rank from u qualify rank <= 2""")
def value_factors(spark, d):
    k = F.col("c_custkey")
    x = table(spark, d, "customer").select(k.alias("id"), (k % 50).cast("double").alias("a"), (k % 30).cast("double").alias("b"), (k % 9).cast("double").alias("c"))
    x = value_features.linear_explanation(x, {"a": (2.0, 25.0, 10.0), "b": (-1.5, 10.0, 5.0), "c": (0.25, 4.0, 2.0)}, top=2)
    return x.select("id", F.posexplode("factors").alias("i", "f")).select("id", "f.feature", "f.contribution", (F.col("i") + 1).cast("long").alias("rank"))


@query("""with r as (select n_nationkey as run_id, n_name as algorithm, (n_nationkey * 7 % 25)::double as validation_error from nation where n_regionkey = 1), b as (select algorithm from r order by validation_error, algorithm limit 1)
 select n_nationkey + 100 as run_id, n_name as algorithm, 0.5::double as validation_error, null::varchar as artifact, n_nationkey = 2 as is_active from nation where n_regionkey <> 1 union all select run_id, algorithm, validation_error, case when algorithm = (select algorithm from b) then 'models/1' end, false from r""")
def model_runs(spark, d):
    n = table(spark, d, "nation")
    old = n.filter("n_regionkey <> 1").select((F.col("n_nationkey") + 100).alias("run_id"), F.col("n_name").alias("algorithm"), F.lit(0.5).alias("validation_error"), F.lit(None).cast("string").alias("artifact"))
    new = value_features.require_rows(n.filter("n_regionkey = 1"), "runs").select(F.col("n_nationkey").alias("run_id"), F.col("n_name").alias("algorithm"), (F.col("n_nationkey") * 7 % 25).cast("double").alias("validation_error"))
    return value_features.record_runs(value_features.activate(old, 102), new, "models/1").select("run_id", "algorithm", "validation_error", "artifact", "is_active")


@query("""with t as (select s_suppkey as id, substr(md5((s_suppkey % 60)::varchar), 1, 10) as core, s_nationkey as country from supplier), l as (select c_custkey as id, substr(md5((c_custkey % 400)::varchar), 1, 10) as core, c_nationkey as country, c_custkey % 9 = 0 as national, c_custkey % 8 = 0 as second from customer),
 p as (select t.id as team_id, l.id as listed_id from t join l on t.core = l.core and t.country = l.country where not national and not second) select team_id, min(listed_id) as listed_id, 1.0::double as score from p group by 1 having count(distinct listed_id) = 1""")
def club_resolution(spark, d):
    core = lambda k, n: F.substring(F.md5((k % n).cast("string").cast("binary")), 1, 10)
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    teams = table(spark, d, "supplier").select(s.alias("id"), F.concat_ws(" ", core(s, 60), F.lit("fc")).alias("name"), F.col("s_nationkey").alias("country"))
    listed = table(spark, d, "customer").select(c.alias("id"), F.concat_ws(" ", core(c, 400), F.when(c % 8 == 0, "ii")).alias("name"), F.col("c_nationkey").alias("country"), (c % 9 == 0).alias("national"))
    return identity.resolve_clubs(teams, listed)


# Profiles out of vectors: two seasons a player, the first 46 dimensions as scores by code.
_LISTED = C.features()
_PLACES = ("CM", "DM", "AM", "LW", "ST", "CB", "LB")
PROFILES_SQL = f"""with fl(i, category, code, weight) as (values {", ".join(f"({i}, '{a}', '{n}', {w}::double)" for i, (a, n, w) in enumerate(_LISTED, 1))}),
 cw(grp, category, w) as (values {", ".join(f"('{g}', '{a}', {w}::double)" for g, ws in C.CATEGORY_WEIGHTS.items() for a, w in ws.items())}),
 co(a, b, v) as (values {", ".join(f"('{a}', '{b}', {v}::double)" for a, b, v in C.compatibility_pairs())}),
 pr as (select vec_id as profile_id, vec_id // 2 as player_id, vec_id % 40 as season_id, 2000 + vec_id % 2 as end_year, vec_id % 9 as competition_id, vec_id % 9 = 4 as tournament,
  case when (vec_id // 2) % 3 = 0 then 'f' else 'm' end as gender, case when (vec_id // 2) % 5 = 0 then 'ST' else 'CM' end as grp, (600 + vec_id * 37 % 2400)::double as minutes, embedding as e,
  ['CM', 'DM', 'AM', 'LW', 'ST', 'CB', 'LB'][1 + vec_id % 7] as p1, case when vec_id % 3 = 0 then ['CM', 'DM', 'AM', 'LW', 'ST', 'CB', 'LB'][1 + vec_id % 5] end as p2,
  case when vec_id % 11 <> 0 then date '1975-01-01' + (vec_id * 31 % 3500)::int end as born, case vec_id % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' end as lc from embeddings)"""


def _profiles(spark, d):
    i = F.col("vec_id")
    at = lambda v, n: F.get(F.array(*[F.lit(x) for x in v]), n.cast("int"))
    known = F.transform("embedding", lambda x: F.signum(x.cast("double")) * F.floor(F.abs(x.cast("double")) * 1000 + 0.5) / 1000)
    scores = F.map_from_arrays(F.array(*[F.lit(n) for _, n, _ in _LISTED]), F.slice(F.transform(known, lambda x: F.when(F.abs(x) < 0.3, 4 * x)), 1, len(_LISTED)))
    player = F.floor(i / 2)
    return table(spark, d, "embeddings").select(
        i.cast("long").alias("profile_id"), player.alias("player_id"), (i % 40).alias("season_id"), (2000 + i % 2).alias("end_year"), (i % 9).alias("competition_id"), (i % 9 == 4).alias("tournament"),
        F.when(player % 3 == 0, "f").otherwise("m").alias("gender"), F.lit("raw").alias("mode"), F.when(player % 5 == 0, "ST").otherwise("CM").alias("position_group"), (600 + i * 37 % 2400).cast("double").alias("minutes"), F.col("embedding").alias("vector"), scores.alias("z"),
        at(_PLACES, i % 7).alias("primary"), F.when(i % 3 == 0, at(_PLACES, i % 5)).alias("secondary"), F.when(i % 11 != 0, F.date_add(F.lit("1975-01-01").cast("date"), (i * 31 % 3500).cast("int"))).alias("date_of_birth"),
        F.lit(None).cast("double").alias("strength"), at(("high", "medium", "low", None), i % 4).alias("league_confidence"),
    )


@query(PROFILES_SQL + """, t as (select * from pr where profile_id in (select profile_id from pr where player_id % 25 = 0 qualify row_number() over (partition by player_id order by end_year desc, minutes desc, profile_id) = 1)),
 el0 as (select * from pr where minutes >= 900 and competition_id not in (2, 7)), el as (select * from el0 qualify end_year = max(end_year) over (partition by player_id, grp)),
 ok as (select * from el where (make_date(end_year::int, 6, 30) - born) / 365.25 between 17 and 25.5),
 nr as (select t.profile_id as target, ok.profile_id as candidate, t.grp, sqrt(list_sum(list_transform(list_zip(ok.e, t.e), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))) as distance, t.e as te, ok.e as ce, t.minutes as tm, ok.minutes as cm, t.p1 as t1, t.p2 as t2, ok.p1 as c1, ok.p2 as c2, ok.lc, ok.tournament
  from t join ok on t.grp = ok.grp and t.gender = ok.gender and t.player_id <> ok.player_id qualify row_number() over (partition by t.profile_id order by distance, ok.profile_id) <= 40),
 zs as (select target, candidate, grp, category, code, weight, round(abs(te[i]::double), 9) as ta, round(abs(ce[i]::double), 9) as ca, sign(te[i]) * floor(abs(te[i]::double) * 1000 + 0.5) / 1000 as tz, sign(ce[i]) * floor(abs(ce[i]::double) * 1000 + 0.5) / 1000 as cz from nr, fl),
 pz as (select target, candidate, grp, category, code, weight, 4 * tz as tz, 4 * cz as cz from zs where abs(tz) < 0.3 and abs(cz) < 0.3),
 ca as (select target, candidate, grp, category, 100.0 * exp(-sqrt(sum(weight * (tz - cz) * (tz - cz)) / sum(weight)) / 1.35) as s, sum(weight) as used from pz group by all),
 si as (select target, candidate, sum(w * s) / sum(w) as similarity, sum(used) / (select sum(weight) from fl) as usable from ca join cw using (grp, category) group by all having usable >= 0.6),
 cp as (select target, candidate, unnest([(t1, c1, 1.0::double), (t2, c1, 0.9::double), (t1, c2, 0.9::double), (t2, c2, 0.9::double * 0.9::double)]) as o from nr),
 cv as (select target, candidate, max(coalesce(v, 0.1) * o[3]) as compat from cp left join co on a = o[1] and b = o[2] where o[1] is not null and o[2] is not null group by all),
 su as (select target, candidate, string_agg(code, ',' order by weight * abs(tz - cz), code) as supporting from (select * from pz where abs(tz - cz) < 0.5 qualify row_number() over (partition by target, candidate order by weight * abs(tz - cz), code) <= 6) group by all),
 np as (select grp, count(*) as n from pr where minutes >= 900 group by 1),
 fi as (select *, round(similarity * compat, 2) as final, 0.35 * least(1.0, least(tm, cm) / 1800.0) + 0.25 * usable + 0.2 * least(1.0, n / 100.0) + 0.2 * case when lc = 'high' then 1.0 when lc = 'medium' then 0.7 when lc = 'low' then 0.4 when tournament then 0.5 else 0.3 end as sure from nr join si using (target, candidate) join cv using (target, candidate) join np using (grp))
 select target, row_number() over (partition by target order by final desc, distance, candidate) as rank, candidate, round(similarity, 2) as similarity, round(compat, 2) as compatibility, final, case when sure >= 0.75 then 'high' when sure >= 0.5 then 'medium' else 'low' end as tier, coalesce(supporting, '') as supporting, c_name as name
 from fi left join su using (target, candidate) left join customer on c_custkey = candidate // 2 qualify rank <= 10""")
def find_similar(spark, d):
    """The whole search for every player whose id is divisible by 25 (each has two profiles), filters and names included."""
    profiles = _profiles(spark, d)
    targets = similar_players.latest_targets(profiles, profiles.filter("player_id % 25 = 0").select("player_id"))
    ranking = spark.createDataFrame([(1, 0.9)], "id long, score double")
    out, _ = rules.exclusion(ranking, explicit=[2, 7])
    wanted = similar_players.Filters(min_age=17, max_age=25.5, candidates=40)
    found = similar_players.find_similar_all(profiles, targets, wanted, out)
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"))
    named = similar_players.with_identity(found, people)
    return named.select("target", F.col("rank").cast("long").alias("rank"), "candidate", "similarity", "compatibility", "final", "tier", F.array_join("supporting", ",").alias("supporting"), "name")


_EVERY_25TH = "where profile_id in (select profile_id from pr where player_id % 25 = 0 qualify row_number() over (partition by player_id order by end_year desc, minutes desc, profile_id) = 1)"
_BY_NAME = """where profile_id in (select profile_id from pr where player_id = (select player_id from pr join customer on c_custkey = player_id where gender = 'm' and c_name ilike '%#%7%' group by player_id order by sum(minutes) desc, player_id limit 1)
  qualify row_number() over (partition by player_id order by end_year desc, minutes desc, profile_id) = 1)"""


@query(ORACLE_SQL["find_similar"].replace(_EVERY_25TH, _BY_NAME))
def scouting_search(spark, d):
    """The search for a player given by a part of the name and a gender, of several the one who played most, with filters and
    excluded competitions. The player stays a table: nothing of it passes the driver by name."""
    profiles = _profiles(spark, d)
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"))
    played = profiles.filter("gender = 'm'").groupBy("player_id").agg(F.sum("minutes").alias("played"))
    who = reads.search(played.join(people, "player_id"), F.col("name"), "#%7", [F.desc("played"), F.col("player_id")], 1)
    out, _ = rules.exclusion(spark.createDataFrame([(1, 0.9)], "id long, score double"), explicit=[2, 7])
    wanted = similar_players.Filters(min_age=17, max_age=25.5, candidates=40)
    found = similar_players.find_similar_all(profiles, similar_players.latest_targets(profiles, who.select("player_id")), wanted, out)
    named = similar_players.with_identity(found, people)
    return named.select("target", F.col("rank").cast("long").alias("rank"), "candidate", "similarity", "compatibility", "final", "tier", F.array_join("supporting", ",").alias("supporting"), "name")
