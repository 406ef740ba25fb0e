"""Queries over the test tables, one per operator, each with its SQL oracle beside it.

Money and quantities are summed in whole cents, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions.stats import P_CLIP, inverse_normal_sql
from ..operators import aggregates, identity, nearest_join, percentiles, profiles, quality_scan, sequence, similarity, strength, temporal, value_model
from ..sources import sinks
from ..streaming import events as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def year(c: str) -> Column:
    return F.year(c).cast("long")


SEASONS = """select o_custkey as player_id, year(o_orderdate)::bigint as season_id, l_returnflag as team,
 round(l_quantity * 100)::bigint as quantity, case when l_linestatus = 'F' then round(l_extendedprice * 100)::bigint else 0 end as done,
 round(l_extendedprice * 100)::bigint as price from lineitem join orders on l_orderkey = o_orderkey"""


@query(f"""with x as ({SEASONS}) select player_id, season_id, team, grouping(team)::bigint as is_total, sum(quantity)::bigint as quantity,
 sum(done)::bigint as done, sum(price)::bigint as price, case when sum(price) > 0 then 100.0::double * sum(done)::double / sum(price)::double end as done_pct
 from x group by grouping sets ((player_id, season_id, team), (player_id, season_id))""")
def season_rollup(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = lines.select(F.col("o_custkey").alias("player_id"), year("o_orderdate").alias("season_id"), F.col("l_returnflag").alias("team"), "l_quantity", "l_extendedprice", "l_linestatus")
    sums = {"quantity": cents("l_quantity"), "done": F.when(F.col("l_linestatus") == "F", cents("l_extendedprice")).otherwise(F.lit(0)), "price": cents("l_extendedprice")}
    out = aggregates.roll_up(named, ["player_id", "season_id"], "team", sums, {"done_pct": ("done", "price")})
    return out.withColumn("is_total", F.col("is_total").cast("long"))


@query("""select l_partkey as entity, sum(round(l_extendedprice * 100)::bigint)::bigint as value, sum(round(l_quantity)::bigint)::bigint as minutes,
 sum(round(l_extendedprice * 100)::bigint)::double / (sum(round(l_quantity)::bigint)::double / 90.0::double) as per90 from lineitem group by 1""")
def per_rate_normalised(spark, d):
    from ..functions.stats import per_90

    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(F.sum(cents("l_extendedprice")).alias("value"), F.sum(F.round("l_quantity").cast("long")).alias("minutes"))
    return g.withColumn("per90", per_90(F.col("value").cast("double"), F.col("minutes").cast("double")))


@query("""with m as (select c_mktsegment as pool, round(c_acctbal)::bigint as v, c_custkey, c_acctbal > 0 as m from customer),
 c as (select pool, v, sum(m::int)::bigint as equal from m group by all),
 r as (select pool, v, equal, coalesce(sum(equal) over (partition by pool order by v rows between unbounded preceding and 1 preceding), 0)::bigint as below, (sum(equal) over (partition by pool))::bigint as n from c)
 select c_custkey, n, case when n > 0 then 100.0::double * (below + 0.5::double * equal) / n end as pct from m join r using (pool, v)""")
def midrank_percentile(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("pool"), F.round("c_acctbal").cast("long").alias("v"), (F.col("c_acctbal") > 0).alias("is_member"))
    return percentiles.mid_rank(c, ["pool"], "v").select("c_custkey", "n", percentiles.percentile().alias("pct"))


POOL = """select o_orderkey as id, c_mktsegment as g, year(o_orderdate)::bigint as y, n_regionkey::varchar as b, round(o_totalprice)::bigint as v,
 o_orderstatus <> 'P' as m from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""


def _pool_sql(levels: str, size: int, lower: bool) -> str:
    p = "100.0::double * (e_below + 0.5::double * e_equal) / n"
    return f"""with r as ({POOL}), ask as (select id, g, v, l.level, case l.level when 4 then 0 else y end as ky, case when l.level in (3, 4) then 'ALL' else b end as kb from r, (values {levels}) l(level)),
 mem as (select g, v, l.level, case l.level when 4 then 0 else y + l.d end as ky, case when l.level in (3, 4) then 'ALL' else b end as kb from r, (values (1, 0), (2, -1), (2, 0), (2, 1), (3, 0), (4, 0)) l(level, d) where m),
 c as (select g, level, ky, kb, v, count(*) as k from mem group by all),
 w as (select *, sum(k) over (partition by g, level, ky, kb order by v)::bigint as upto, (sum(k) over (partition by g, level, ky, kb))::bigint as n from c),
 f as (select a.id, a.level, x.n, coalesce(x.upto, 0) - case when x.v = a.v then x.k else 0 end as e_below, case when x.v = a.v then x.k else 0 end as e_equal
  from ask a asof join w x on a.g = x.g and a.level = x.level and a.ky = x.ky and a.kb = x.kb and a.v >= x.v),
 low as (select a.id, a.level, t.n, 0 as e_below, 0 as e_equal from ask a join (select g, level, ky, kb, max(n) as n, min(v) as lo from w group by all) t using (g, level, ky, kb) where a.v < t.lo),
 z as (select * from f union all select * from low), q as (select id, level, n, {'100.0::double - ' + p if lower else p} as percentile from z where n >= {size})
 select id, level::bigint as level, n::bigint as pool_n, percentile from q qualify row_number() over (partition by id order by level) = 1"""


def _pool_rows(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return x.select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("g"), year("o_orderdate").alias("y"), F.col("n_regionkey").cast("string").alias("b"), F.round("o_totalprice").cast("long").alias("v"), (F.col("o_orderstatus") != "P").alias("is_member"))


@query(_pool_sql("(1), (2), (3), (4)", 30, False))
def pool_fallback_percentile(spark, d):
    out = percentiles.pool_percentiles(_pool_rows(spark, d), group=["g"], year="y", band="b", value="v", ids=["id"])
    return out.withColumn("level", F.col("level").cast("long"))


@query(_pool_sql("(3), (4)", 250, True))
def pool_adjusted_percentile(spark, d):
    out = percentiles.pool_percentiles(_pool_rows(spark, d), group=["g"], year="y", band="b", value="v", ids=["id"], levels=(3, 4), min_size=250, lower_better=True)
    return out.withColumn("level", F.col("level").cast("long"))


@query(f"""with m as (select p_brand as pool, p_size::bigint as v, p_partkey, p_type <> 'STEEL' as m from part), c as (select pool, v, sum(m::int)::bigint as equal from m group by all),
 r as (select *, coalesce(sum(equal) over (partition by pool order by v rows between unbounded preceding and 1 preceding), 0)::bigint as below, (sum(equal) over (partition by pool))::bigint as n from c),
 q as (select p_partkey, greatest({P_CLIP}::double, least({1 - P_CLIP}::double, (below + 0.5::double * equal) / n)) as p from m join r using (pool, v) where n > 0)
 select p_partkey, round({inverse_normal_sql('p')}, 9) as z from q""")
def rank_normal_z(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("pool"), F.col("p_size").cast("long").alias("v"), (F.col("p_type") != "STEEL").alias("is_member"))
    return profiles.rank_normal(x, ["pool"], "v").select("p_partkey", F.round("z", 9).alias("z"))


_GRID = ", ".join(f"quantile_cont(round(c_acctbal)::double, {i / 20})" for i in range(21))


@query(f"""select c_mktsegment as pool, unnest(range(21))::bigint as i, unnest([{_GRID}]) as q from customer group by 1""".replace("unnest([", "round(unnest([").replace("]) as q", "]), 5) as q"))
def quantile_grid(spark, d):
    x = table(spark, d, "customer").select(F.col("c_mktsegment").alias("pool"), F.round("c_acctbal").alias("v"))
    return profiles.quantile_grid(x, ["pool"], "v").select("pool", F.posexplode("grid").alias("i", "q")).select("pool", F.col("i").cast("long").alias("i"), "q")


LAYOUT = "one A:1.0 N:1.5\ntwo R:0.5 X:1.0"


@query("""with s as (select l_suppkey as id, l_returnflag as code, (count(*) / 8.0)::double as z from lineitem group by all),
 w as (select id, max(z) filter (code = 'A') as a, max(z) filter (code = 'N') as n, max(z) filter (code = 'R') as r from s group by 1)
 select id, coalesce(a, 0.0::double) as v0, coalesce(n, 0.0::double) as v1, coalesce(r, 0.0::double) as v2, 0.0::double as v3, 0.0::double as v4, 0.0::double as v5, 0.0::double as v6, 0.0::double as v7,
 round(((a is not null)::int * 1.0 + (n is not null)::int * 1.5 + (r is not null)::int * 0.5)::double / 4.0, 3) as completeness from w""")
def profile_vector_pivot(spark, d):
    z = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("code")).agg((F.count("*") / 8.0).alias("z"))
    v = profiles.profile_vectors(z, ["id"], LAYOUT, 8)
    return v.select("id", *[F.get("vector", F.lit(i)).alias(f"v{i}") for i in range(8)], "completeness")


LEAGUES = """with l as (select n_regionkey::varchar as gender, s_suppkey % 3 as year, n_name as country, (s_suppkey % 5)::bigint as tier, max(s_acctbal) as points
 from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 0 group by all),
 b as (select gender, year, country, tier, points, max(points) over (partition by gender, year) as top from l qualify row_number() over (partition by gender, year, country order by tier) = 1),
 t as (select gender, year, max(points) as top from b group by all),
 s as (select b.gender, b.year, b.country, b.tier, round(least(greatest(b.points / t.top * case b.tier when 1 then 1.0::double when 2 then 0.6::double when 3 then 0.4::double when 4 then 0.3::double else 1.0::double end, 0.0::double), 1.0::double), 4) as score from b join t using (gender, year))"""


def _leagues(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    x = s.join(n, s.s_nationkey == n.n_nationkey).filter("s_acctbal > 0").groupBy(F.col("n_regionkey").cast("string").alias("gender"), (F.col("s_suppkey") % 3).alias("year"), F.col("n_name").alias("country"), (F.col("s_suppkey") % 5).alias("tier")).agg(F.max("s_acctbal").alias("points"))
    one = aggregates.top_k(x, ["gender", "year", "country"], [F.col("tier")], 1).drop("rank")
    return strength.strength_scores(one.drop("points").withColumns({"prior": F.lit(None).cast("double"), "tier": F.col("tier").cast("int")}), one.select("gender", "year", "country", "points"))


@query(LEAGUES + " select gender, year, country, tier, score, case when score >= 0.8 then 'A' when score >= 0.6 then 'B' when score >= 0.4 then 'C' else 'D' end as band, round(100 * pow(score, 0.35::double), 6) as adjusted from s")
def strength_score_band(spark, d):
    x = _leagues(spark, d)
    return x.select("gender", "year", "country", F.col("tier").cast("long").alias("tier"), "score", strength.band(F.col("score")).alias("band"), F.round(strength.adjusted(F.lit(100.0), F.col("score"), F.lit("passing")), 6).alias("adjusted"))


@query(LEAGUES + """, w as (select gender, year, country, score, row_number() over (partition by gender, year order by score desc, country) as rank, score - lead(score) over (partition by gender, year order by score desc, country) as gap from s)
 select gender, year, country, score, rank::bigint as rank, rank = 3 and coalesce(gap < 0.01, false) as near_tie from w where rank <= 3""")
def league_ranking(spark, d):
    x = strength.ranking(_leagues(spark, d).select("gender", "year", "country", "score"), by=("gender", "year"))
    return x.select("gender", "year", "country", "score", F.col("rank").cast("long").alias("rank"), "near_tie")


def _searches(spark, d):
    """All vectors, and those that are searched for: every id divisible by 50."""
    e = table(spark, d, "embeddings")
    return e, e.filter("vec_id % 50 = 0"), {"key": "vec_id", "vector": "embedding"}


def _dimensions(e):
    """Weight and category of every dimension: four runs of equal length."""
    n = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return [float(1 + i % 3) for i in range(1, n + 1)], [("attacking", "passing", "possession", "defending")[4 * i // n] for i in range(n)]


@query("""with q as (select vec_id as target, embedding as e from embeddings where vec_id % 50 = 0),
 x as (select target, vec_id as candidate, round(sqrt(list_sum(list_transform(list_zip(embedding, e), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))), 9) as distance from embeddings join q on vec_id <> target)
 select target, candidate, distance from x qualify row_number() over (partition by target order by distance, candidate) <= 300""")
def vector_knn(spark, d):
    e, targets, by = _searches(spark, d)
    return similarity.nearest_all(e, targets, **by).withColumn("distance", F.round("distance", 9))


@query("""with x as (select t.vec_id as target, c.vec_id as candidate, round(sqrt(list_sum(list_transform(list_zip(c.embedding, t.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))), 9) as distance
 from embeddings c join embeddings t on c.label = t.label and c.vec_id <> t.vec_id) select target, candidate, distance from x qualify row_number() over (partition by target order by distance, candidate) <= 10""")
def vector_knn_join(spark, d):
    """The ten nearest of its label for every vector: all are targets, and none passes the driver."""
    e = table(spark, d, "embeddings")
    found, _ = nearest_join.nearest_join(e, e, key="vec_id", vector="embedding", within=("label",))
    return found.withColumn("distance", F.round("distance", 9))


FEATURE_ROWS = """with f as (select vec_id, i, embedding[i]::double as v, ['attacking', 'passing', 'possession', 'defending'][(4 * (i - 1)) // len(embedding) + 1] as category, (1 + i % 3)::double as weight, len(embedding) as n from embeddings, range(1, 1 + (select max(len(embedding)) from embeddings)) t(i)),
 g as (select *, case when v < 0 then -floor(abs(v) * 1000 + 0.5) / 1000 else floor(abs(v) * 1000 + 0.5) / 1000 end as z from f),
 p as (select t.vec_id as target, c.vec_id as candidate, c.category, c.i as code, c.weight, case when abs(t.v) < 1.2 then t.z end as tz, case when abs(c.v) < 1.5 then c.z end as cz from g c join g t on t.vec_id % 50 = 0 and t.i = c.i where c.vec_id <> t.vec_id)"""


@query(FEATURE_ROWS + """, a as (select sum(weight) as total from g where vec_id = (select min(vec_id) from g)),
 c as (select target, candidate, category, 100.0 * exp(-sqrt(sum(weight * (tz - cz) * (tz - cz)) / sum(weight)) / 1.35) as s, sum(weight) as used from p where tz is not null and cz is not null group by all),
 k as (select *, case category when 'attacking' then 0.15 when 'passing' then 0.3 when 'possession' then 0.2 else 0.2 end::double as w from c)
 select target, candidate, round(sum(w * s) / sum(w), 6) as similarity, round(sum(used) / max(total), 6) as usable from k, a group by all having sum(used) / max(total) >= 0.6""")
def category_similarity(spark, d):
    e, targets, by = _searches(spark, d)
    weights, categories = _dimensions(e)
    x = similarity.vector_similarity_all(e, targets, "CM", categories, weights, limits=(1.2, 1.5), **by)
    return x.select("target", "candidate", F.round("similarity", 6).alias("similarity"), F.round("usable", 6).alias("usable"))


@query(FEATURE_ROWS + """, q as (select target, candidate, code, weight * abs(tz - cz) as wd, abs(tz - cz) as d from p where tz is not null and cz is not null),
 s as (select target, candidate, code::bigint as code, row_number() over (partition by target, candidate order by wd, code) as r from q where d < 0.5)
 select target, candidate, r::bigint as r, code from s where r <= 6""")
def similarity_supporting(spark, d):
    e, targets, by = _searches(spark, d)
    return similarity.vector_supporting_all(e, targets, _dimensions(e)[0], limits=(1.2, 1.5), **by)


_PLACES_SQL = "[" + ", ".join(f"'{p}'" for p in C.POSITIONS) + "]"
_PAIRS_SQL = ", ".join(f"('{a}', '{b}', {v}::double)" for a, b, v in C.compatibility_pairs())


@query(f"""with c(a, b, v) as (values {_PAIRS_SQL}), p as (select p_partkey as id, {_PLACES_SQL}[1 + p_partkey % 13] as a, {_PLACES_SQL}[1 + p_size % 13] as b from part)
 select id, p.a, p.b, case when p.a = p.b then 1.0 when p.a = 'GK' or p.b = 'GK' then 0.0 else coalesce(v, 0.1) end::double as v from p left join c on p.a = c.a and p.b = c.b""")
def positional_compatibility(spark, d):
    place = lambda n: F.get(F.array(*map(F.lit, C.POSITIONS)), (n % 13).cast("int"))
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), place(F.col("p_partkey")).alias("a"), place(F.col("p_size")).alias("b"))
    return x.join(F.broadcast(similarity.compatibility_table(spark)), ["a", "b"]).select("id", "a", "b", F.col("value").alias("v"))  # 169 rows


@query("""with x as (select c_custkey as id, 0.35 * least(1.0, least(1500.0, c_custkey::double) / 1800.0) + 0.25 * 0.8 + 0.2 * least(1.0, (c_custkey % 150)::double / 100.0) + 0.2 * case c_nationkey % 4 when 0 then 1.0 when 1 then 0.7 when 2 then 0.4 else 0.3 end as s from customer)
 select id, case when s >= 0.75 then 'high' when s >= 0.5 then 'medium' else 'low' end as tier from x""")
def confidence_tier(spark, d):
    c = table(spark, d, "customer")
    level = F.get(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit("none")), (F.col("c_nationkey") % 4).cast("int"))
    x = similarity.confidence(F.lit(1500.0), F.col("c_custkey").cast("double"), F.lit(0.8), (F.col("c_custkey") % 150).cast("double"), level, F.lit(False))
    return c.select(F.col("c_custkey").alias("id"), x["tier"].alias("tier"))


@query("""select o_custkey, o_orderkey, year(o_orderdate)::bigint as y from orders qualify rank() over (partition by o_custkey order by year(o_orderdate) desc) = 1""")
def latest_per_key_ties(spark, d):
    return aggregates.latest_with_ties(table(spark, d, "orders").select("o_custkey", "o_orderkey", year("o_orderdate").alias("y")), "o_custkey", "y").select("o_custkey", "o_orderkey", "y")


@query("""select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::bigint as rank from orders qualify rank <= 3""")
def topk_per_key(spark, d):
    x = aggregates.top_k(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return x.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query(f"""with x as ({SEASONS}), g as (select player_id, season_id, team as code, sum(quantity)::bigint as v from x group by all),
 s as (select *, v::double / (sum(v) over (partition by player_id, season_id))::double as share from g), r as (select *, row_number() over (partition by player_id, season_id order by share desc, code desc)::bigint as rank from s)
 select player_id, season_id, code, share, rank from r where rank = 1 or (rank = 2 and share >= 0.2 and v >= 2700)""")
def primary_secondary_position(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    maps = lines.select(F.col("o_custkey").alias("player_id"), year("o_orderdate").alias("season_id"), F.create_map("l_returnflag", cents("l_quantity")).alias("m"))
    p = aggregates.positions(aggregates.map_sum(maps, ["player_id", "season_id"], "m"), 0.2, 2700)
    return p.select("player_id", "season_id", "code", "share", F.col("rank").cast("long").alias("rank"))


@query("""with r as (select user_id, ts, max(round(value * 100)::bigint) as rate from events where event_type = 'purchase' group by all), c as (select event_id, user_id, ts from events where event_type = 'click')
 select c.event_id, r.rate from c asof left join r on c.user_id = r.user_id and c.ts >= r.ts""")
def asof_rate(spark, d):
    e = table(spark, d, "events")
    r = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("rts"), cents("value").alias("rate"))
    return temporal.asof_join(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), r, on=["user_id"], left_time="ts", right_time="rts", values=["rate"], bucket=lambda t: F.date_trunc("day", t)).select("event_id", "rate")


@query("""select a.event_id, count(b.event_id)::bigint as n, sum(round(b.value * 100)::bigint)::bigint as total from events a left join events b on a.user_id = b.user_id and epoch(b.ts)::bigint < epoch(a.ts)::bigint and epoch(b.ts)::bigint >= epoch(a.ts)::bigint - 7 * 86400 group by 1""")
def trailing_window_features(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), cents("value").alias("v"))
    return temporal.trailing(e, key="user_id", time=F.col("t"), days=7, aggregates={"n": F.count("*"), "total": F.sum("v")}).select("event_id", "n", "total")


@query("""with o as (select o_orderkey, o_orderdate, year(o_orderdate) as y, round(o_totalprice)::bigint as v from orders), q as (select distinct y, o_orderdate from o),
 m as (select q.y, q.o_orderdate, quantile_cont(b.v::double, 0.5) as median_before, count(b.v)::bigint as n_before from q left join o b on q.y = b.y and b.o_orderdate < q.o_orderdate and b.v >= 1000 group by all)
 select o_orderkey, median_before, n_before from o left join m using (y, o_orderdate)""")
def expanding_median_index(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", year("o_orderdate").alias("y"), F.round("o_totalprice").alias("v"))
    x = temporal.expanding_median(o, time="o_orderdate", year="y", value="v", at=o.select("o_orderkey", "o_orderdate", "y"), at_time="o_orderdate", at_year="y", minimum=1000)
    return x.select("o_orderkey", "median_before", F.coalesce("n_before", F.lit(0).cast("long")).alias("n_before"))


# Names that earlier results are known by.
# Earlier names of these whole-table searches.
vector_knn_all, category_similarity_all, similarity_supporting_all, expanding_median_all = vector_knn, category_similarity, similarity_supporting, expanding_median_index


@query("""with o as (select year(o_orderdate)::bigint as year, round(o_totalprice)::double as fee from orders where o_totalprice >= 1000), m as (select year, median(fee) as m from o group by 1) select year, m / (select m from m where year = 1998) as index from m""")
def inflation_index(spark, d):
    return value_model.inflation_index(table(spark, d, "orders").select(year("o_orderdate").alias("year"), F.round("o_totalprice").alias("fee")), reference_year=1998, minimum=1000.0)


RUNS = """with e as (select user_id as match_id, event_id as idx, date_trunc('day', ts) as period, epoch_ms(ts) as t, event_type, (value * 10)::bigint % 2 as team, (value * 10)::bigint % 5 as possession from events)"""


def _match_events(spark, d):
    e = table(spark, d, "events")
    ten = F.round(F.col("value") * 10).cast("long")
    return e.select(F.col("user_id").alias("match_id"), F.col("event_id").alias("idx"), F.date_trunc("day", "ts").alias("period"), (F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0).alias("t"), "event_type", (ten % 2).alias("team"), (ten % 5).alias("possession"))


RUNS_SQL = RUNS.replace("(value * 10)::bigint", "round(value * 10)::bigint")


@query(RUNS_SQL + """, j as (select p.match_id, p.idx, n.idx as k, n.period <> p.period or n.t - p.t > 86400000 as stop, n.team = p.team and n.possession <> p.possession as hit from e p join e n on p.match_id = n.match_id and n.idx > p.idx where p.event_type = 'click'),
 f as (select match_id, idx, min(k) filter (stop) as s, min(k) filter (hit and not stop) as h from j group by all) select match_id, idx from f where h is not null and (s is null or h < s)""")
def pressure_window(spark, d):
    e = _match_events(spark, d).withColumns({"possession_team": F.col("team"), "is_pressure": F.col("event_type") == "click"})
    return sequence.pressure_success(e, seconds=86400.0)


@query(RUNS_SQL + """, r0 as (select *, (possession is distinct from lag(possession) over (partition by match_id order by idx))::int as new from e), r as (select *, sum(new) over (partition by match_id order by idx) as run from r0),
 j as (select s.match_id, s.idx as shot_idx, a.idx, row_number() over (partition by s.match_id, s.idx order by a.idx desc) as k from r s join r a on s.match_id = a.match_id and s.run = a.run and s.team = a.team and a.idx < s.idx
 where s.event_type = 'purchase' and a.event_type in ('click', 'view')) select match_id, shot_idx, idx from j where k <= 2""")
def creating_actions(spark, d):
    e = _match_events(spark, d).withColumns({"player": F.lit(1), "is_shot": F.col("event_type") == "purchase", "is_goal": F.lit(False), "qualifies": F.col("event_type").isin("click", "view")})
    return sequence.creating_actions(e).select("match_id", "shot_idx", "idx")


@query("""with e as (select user_id as match_id, (1 + event_id % 4)::bigint as period, max(case when event_type = 'purchase' then round(value) end) as m, first(1) as one from events where value > 0 group by all),
 d as (select match_id, period, case when m > 0 then m::double / 60.0::double else [45.0, 45.0, 15.0, 15.0][period]::double end as duration from e)
 select match_id, period, round(duration, 6) as duration, round(coalesce(sum(duration) over (partition by match_id order by period rows between unbounded preceding and 1 preceding), 0), 6) as "offset" from d""")
def session_minutes(spark, d):
    e = table(spark, d, "events").filter("value > 0").select(F.col("user_id").alias("match_id"), (1 + F.col("event_id") % 4).cast("int").alias("period"), F.when(F.col("event_type") == "purchase", "Half End").alias("type"), F.round("value").alias("t"))
    x = sequence.period_durations(e)
    return x.select("match_id", F.col("period").cast("long").alias("period"), F.round("duration", 6).alias("duration"), F.round("offset", 6).alias("offset"))


@query("""with e as (select user_id, event_type as code, (props ->> '$.k')::bigint as k from events) select user_id, code, sum(k)::bigint as value from e where k is not null group by all""")
def map_sum_json(spark, d):
    e = table(spark, d, "events").select("user_id", F.create_map("event_type", F.get_json_object("props", "$.k").cast("long")).alias("m")).filter("element_at(map_values(m), 1) is not null")
    return aggregates.map_sum(e, ["user_id"], "m")


@query(r"""select c_custkey as id, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) as name from customer""")
def name_normalise(spark, d):
    suffixed = F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit(", Jr.")).otherwise(F.lit("")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.normalize_name(suffixed).alias("name"))


@query("""select o_orderkey as id, case o_orderkey % 5 when 0 then 'disclosed' when 1 then 'loan_fee' when 2 then 'free' when 3 then 'undisclosed' else 'unknown' end as status,
 case when o_orderkey % 5 = 0 then round(o_totalprice)::bigint::double * 1000.0 end as amount from orders""")
def fee_parse(spark, d):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.concat(F.lit("€ "), F.round("o_totalprice").cast("long").cast("string"), F.lit("K"))).when(k == 1, "Loan with option").when(k == 2, " Free ").when(k == 3, "N/A").otherwise("about ten")
    f = T.parse_fee(text)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), f["status"].alias("status"), f["amount"].alias("amount"))


@query("""select p_partkey as id, case when p_size % 7 = 0 then 'youth' when p_size % 7 = 1 then 'international_national' when p_size % 7 = 2 then 'international_club' when p_partkey % 2 = 0 then 'domestic_cup' else 'domestic_league' end as kind,
 (1990 + p_size)::bigint as starts, (1990 + p_size + p_partkey % 2)::bigint as ends from part""")
def competition_and_season(spark, d):
    m = F.col("p_size") % 7
    name = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, " Copa X").otherwise(" League"))
    y = 1990 + F.col("p_size")
    season = T.season_years(F.when(F.col("p_partkey") % 2 == 1, F.concat_ws("/", y, y + 1)).otherwise(y.cast("string")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.competition_kind(m == 0, m == 1, m == 2, name).alias("kind"), season["start"].cast("long").alias("starts"), season["end"].cast("long").alias("ends"))


@query("""with l as (select c_custkey as id, c_nationkey as block, lower(c_mktsegment) || ' ' || (c_custkey % 40) as name from customer), r as (select s_suppkey as id, s_nationkey as block, lower(['BUILDING', 'MACHINERY'][(s_suppkey % 2 + 1)::int]) || ' ' || (s_suppkey % 40) as name from supplier),
 e as (select l.id as left_id, r.id as right_id, count(*) over (partition by l.id) as n, row_number() over (partition by l.id order by r.id) as k from l join r using (block, name)),
 f as (select *, count(*) filter (n = 1) over (partition by right_id) as claims from e where k = 1)
 select left_id, right_id, case when n = 1 and claims = 1 then 'linked' else 'review' end as decision, case when n > 1 then 0.8 when claims > 1 then 0.85 else 0.95 end::double as score from f""")
def identity_exact(spark, d):
    return identity.decide(*_people(spark, d), threshold=None)


def _people(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    l = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("block"), F.array(F.concat_ws(" ", F.lower("c_mktsegment"), F.col("c_custkey") % 40)).alias("names"))
    kind = F.when(F.col("s_suppkey") % 2 == 0, "building").otherwise("machinery")
    return l, s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("block"), F.array(F.concat_ws(" ", kind, F.col("s_suppkey") % 40)).alias("names"))


@query()
def identity_decision(spark, d):
    return identity.decide(*_people(spark, d))


@query()
def fuzzy_block_match(spark, d):
    return identity.fuzzy_best(*_people(spark, d))


@query("""with f as (select 'negative_balance' as code from customer where c_acctbal < 0 union all select 'small_order' from orders where o_totalprice < 1000 union all select 'no_orders' from customer where c_custkey not in (select o_custkey from orders)
 union all select 'off_total' from (select l_suppkey, sum(round(l_quantity)::bigint) as t, count(*) * 25.5 as x from lineitem group by 1) where abs(t - x) > 0.05 * x) select code, count(*)::bigint as n from f group by 1""")
def quality_scan_counts(spark, d):
    c, o, l = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "lineitem")
    off = quality_scan.off_total(l.withColumn("q", F.round("l_quantity").cast("long")), ["l_suppkey"], "q", F.count("*") * 25.5)
    rules = [
        ("negative_balance", c, F.col("c_custkey"), F.col("c_acctbal") < 0),
        ("small_order", o, F.col("o_orderkey"), F.col("o_totalprice") < 1000),
        ("no_orders", c.join(o, c.c_custkey == o.o_custkey, "left_anti"), F.col("c_custkey"), F.lit(True)),
        ("off_total", off, F.col("l_suppkey"), F.lit(True)),
    ]
    return quality_scan.counts(quality_scan.flags(rules))


EXAMPLES = """with x as (select o_orderkey, year(o_orderdate) as y, o_orderpriority as k, ln(1 + round(o_totalprice))::double as label from orders), p as (select *, case when y < 1998 then 'train' when y < 2000 then 'validate' else 'test' end as part from x),
 m as (select k, median(label) as m from p where part = 'train' group by 1), f as (select part, label, coalesce(m, (select median(label) from p where part = 'train')) as predicted from p left join m using (k))"""


def _examples(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("k"), F.log1p(F.round("o_totalprice")).alias("label"), F.month("o_orderdate").cast("double").alias("month"), F.when(F.col("o_custkey") % 10 != 0, (F.col("o_custkey") % 100).cast("double")).alias("cust"))
    return value_model.split_by_time(o, "y", 1998, 2000)


@query(EXAMPLES + """ select part, count(*)::bigint as n, round(avg(abs(label - predicted)), 6) as mae_log, round(avg((abs(exp(predicted) - exp(label)) <= 0.5 * (exp(label) - 1))::int), 6) as within_50 from f group by 1""")
def median_baseline_metrics(spark, d):
    m = value_model.regression_metrics(value_model.baseline(_examples(spark, d), ["k"], "label"), ["part"], "label")
    return m.select("part", "n", F.round("mae_log", 6).alias("mae_log"), F.round("within_50", 6).alias("within_50"))


@query()
def value_models(spark, d):
    out = None
    for name, p in value_model.fit_models(_examples(spark, d), ["month", "cust"], "label").items():
        m = value_model.regression_metrics(value_model.conformal(p, "label"), ["part"], "label").withColumn("algorithm", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end as o_orderstatus, round(o_totalprice * 100)::bigint as price from orders union all select -o_orderkey, 'X', round(o_totalprice * 100)::bigint from orders where o_orderkey % 100 = 3""")
def upsert_keep_latest(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", cents("o_totalprice").alias("price"))
    changed = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(0).cast("long").alias("price")).unionByName(o.filter("o_orderkey % 100 = 3").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), "price"))
    return sinks.upsert(o, changed, ["o_orderkey"], ["o_orderstatus"], F.col("price"))


@query("""select distinct o_custkey as k from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)""")
def insert_if_absent(spark, d):
    have = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return sinks.new_rows(have, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("""with m as (select o_custkey as season_id, o_orderkey as match_id, o_orderstatus as home, substr(o_orderpriority, 1, 1) as away from orders), s as (select season_id, match_id, unnest([home, away]) as team from m),
 p as (select season_id, team, count(*) as c from s group by all), t as (select season_id, count(*) as n_teams, max(c) as most from p group by 1), n as (select season_id, count(*) as n from m group by 1)
 select season_id, case when season_id % 5 = 0 then 'tournament' when most = n and n_teams > 2 then 'single_team' when season_id % 5 in (1, 2) and n_teams > 2 then case when n >= 0.8 * n_teams * (n_teams - 1) then 'full_league' else 'partial' end
 when season_id % 5 = 3 and n < 10 then 'partial' else 'tournament' end as coverage from t join n using (season_id)""")
def coverage_classifier(spark, d):
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("season_id"), F.col("o_orderkey").alias("match_id"), F.col("o_orderstatus").alias("home_team"), F.substring("o_orderpriority", 1, 1).alias("away_team"))
    k = F.col("season_id") % 5
    kinds = m.select("season_id").distinct().withColumn("kind", F.when(k == 0, "youth").when(k.isin(1, 2), "domestic_league").when(k == 3, "international_club").otherwise("domestic_cup"))
    return aggregates.coverage(m, kinds).select("season_id", "coverage")


@query("""select n_name, y::bigint as season, count(o_orderkey)::bigint as matches from nation cross join (select unnest(range(1995, 2002)) as y) left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey and year(o_orderdate) = y group by all""")
def coverage_report(spark, d):
    n, c, o = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "orders")
    grid = n.select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(1995).cast("long"), F.lit(2001).cast("long"))).alias("season"))
    per = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("n_nationkey"), year("o_orderdate").alias("season")).agg(F.count("*").alias("matches"))
    return grid.join(per, ["n_nationkey", "season"], "left").select("n_name", "season", F.coalesce("matches", F.lit(0).cast("long")).alias("matches"))


@query("""select p_partkey, p_name, coalesce(t, 0)::bigint as total from part left join (select l_partkey, sum(round(l_quantity)::bigint) as t from lineitem group by 1) on l_partkey = p_partkey where contains(lower(p_name), 'e') order by total desc, p_partkey limit 20""")
def search_topk(spark, d):
    total = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.round("l_quantity").cast("long")).alias("t"))
    hits = table(spark, d, "part").filter(F.lower("p_name").contains("e")).select("p_partkey", "p_name")
    return hits.join(total, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("t", F.lit(0).cast("long")).alias("total")).orderBy(F.desc("total"), "p_partkey").limit(20)


@query("""with x as (select o_orderpriority as metric, c_mktsegment as player, sum(round(o_totalprice * 100)::bigint)::bigint as v from orders join customer on o_custkey = c_custkey group by all)
 select metric, max(v) filter (player = 'AUTOMOBILE') as automobile, max(v) filter (player = 'BUILDING') as building, max(v) filter (player = 'FURNITURE') as furniture, max(v) filter (player = 'HOUSEHOLD') as household, max(v) filter (player = 'MACHINERY') as machinery from x group by 1""")
def compare_pivot(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    players = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    x = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("o_orderpriority").alias("metric")).pivot("c_mktsegment", players).agg(F.sum(cents("o_totalprice")))
    return x.select("metric", *[F.col(p).alias(p.lower()) for p in players])


@query("""with x as (select c_mktsegment as id, n_name as metric, count(*) as v from customer join nation on c_nationkey = n_nationkey group by all), r as (select id, metric, v, row_number() over (partition by id order by v desc, metric)::bigint as top, row_number() over (partition by id order by v, metric)::bigint as bottom from x)
 select id, metric, case when top <= 5 then 'strength' else 'weakness' end as side from r where top <= 5 or bottom <= 5""")
def report_strengths(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    x = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("c_mktsegment").alias("id"), F.col("n_name").alias("metric")).agg(F.count("*").alias("v"))
    up = aggregates.top_k(x, ["id"], [F.desc("v"), F.col("metric")], 5).withColumn("side", F.lit("strength"))
    down = aggregates.top_k(x, ["id"], [F.col("v"), F.col("metric")], 5).withColumn("side", F.lit("weakness")).join(up.select("id", "metric"), ["id", "metric"], "left_anti")
    return up.unionByName(down).select("id", "metric", "side")


@query("""select s_suppkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ' / ') as flags from supplier join lineitem on l_suppkey = s_suppkey group by 1""")
def distinct_set_concat(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), " / ").alias("flags"))


@query("""with e as (select user_id, ts, round(value * 100)::bigint as v, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hours then 0 else 1 end as new from events),
 s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as start, max(ts) + interval 12 hours as "end", count(*)::bigint as n, sum(v)::bigint as value from s group by user_id, k""")
def event_sessions(spark, d):
    return streaming.sessions(table(spark, d, "events").select("user_id", "ts", cents("value").alias("value")), gap="12 hours")


def _two_sources(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")

    def side(df, key, nation, name):
        k = F.col(key)
        return df.select(k.alias("id"), F.array(F.concat_ws(" ", name, k % 400), F.concat_ws(" ", F.lit("alias"), k % 970)).alias("names"), F.when(k % 7 != 0, F.col(nation) % 3).alias("nationality"), F.when(k % 3 != 0, k % 2).alias("born"))

    kind = F.when(F.col("s_suppkey") % 2 == 0, "building").otherwise("machinery")
    return side(c, "c_custkey", "c_nationkey", F.lower("c_mktsegment")), side(s, "s_suppkey", "s_nationkey", kind)


@query("""with l as (select c_custkey as id, unnest([lower(c_mktsegment) || ' ' || (c_custkey % 400), 'alias ' || (c_custkey % 970)]) as name, case when c_custkey % 7 <> 0 then c_nationkey % 3 end as nat, case when c_custkey % 3 <> 0 then c_custkey % 2 end as born from customer),
 r as (select s_suppkey as id, unnest([case when s_suppkey % 2 = 0 then 'building ' else 'machinery ' end || (s_suppkey % 400), 'alias ' || (s_suppkey % 970)]) as name, case when s_suppkey % 7 <> 0 then s_nationkey % 3 end as nat, case when s_suppkey % 3 <> 0 then s_suppkey % 2 end as born from supplier),
 p as (select distinct l.id as left_id, r.id as right_id from l join r using (name) where coalesce(l.nat = r.nat, true) and coalesce(l.born = r.born, true)), g as (select left_id, count(*) as n, min(right_id) as right_id from p group by 1)
 select c_custkey as left_id, case when n = 1 then right_id end as right_id, case when n = 1 then 'linked' when n > 1 then 'ambiguous' else 'none' end as decision, case when n = 1 then 0.95::double end as score, coalesce(n, 0)::bigint as n_matches from customer left join g on left_id = c_custkey""")
def strict_identity_match(spark, d):
    return identity.strict_match(*_two_sources(spark, d))


def _initials(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    short = s.select(F.col("s_suppkey").alias("id"), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "B").otherwise("M"), F.lit(". Dé N"), F.col("s_nationkey")).alias("name"))
    return short, c.select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit(" de n"), F.col("c_nationkey")).alias("name"))


@query("""select s_suppkey as left_id, c_custkey as right_id from supplier join customer on s_nationkey = c_nationkey and c_mktsegment[1] = case when s_suppkey % 2 = 0 then 'B' else 'M' end""")
def initial_surname_match(spark, d):
    return identity.initial_matches(*_initials(spark, d))


@query("""with p as (select s_suppkey as left_id, c_custkey as right_id from supplier join customer on s_nationkey = c_nationkey and c_mktsegment[1] = case when s_suppkey % 2 = 0 then 'B' else 'M' end),
 x as (select distinct l_suppkey as left_id, l_partkey as club from lineitem), y as (select distinct o_custkey as right_id, l_partkey as club from lineitem join orders on l_orderkey = o_orderkey)
 select distinct left_id, right_id from p join x using (left_id) join y using (right_id, club)""")
def club_confirmed_match(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    right = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("right_id"), F.col("l_partkey").alias("club"))
    return identity.initial_matches_sharing_club(*_initials(spark, d), l.select(F.col("l_suppkey").alias("left_id"), F.col("l_partkey").alias("club")), right)


@query("""with q as (select o_custkey as left_id, o_orderkey % 500 as right_id, max(round(o_totalprice * 100)::bigint) as score from orders group by all), k as (select distinct c_custkey as left_id, c_custkey % 500 as right_id from customer where c_custkey % 4 = 0),
 a as (select left_id, right_id, score, case when (left_id + right_id) % 5 = 0 then null else right_id % 3 <> 0 end as approve from q)
 select left_id, right_id, score, approve, case when approve is null then 'pending' when not approve then 'rejected' when exists (select 1 from k where (k.left_id = a.left_id) <> (k.right_id = a.right_id)) then 'conflict' else 'approved' end as status from a""")
def identity_review(spark, d):
    q = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("left_id"), (F.col("o_orderkey") % 500).alias("right_id")).agg(F.max(cents("o_totalprice")).alias("score"))
    q = q.withColumn("approve", F.when((F.col("left_id") + F.col("right_id")) % 5 != 0, F.col("right_id") % 3 != 0))
    links = table(spark, d, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("left_id"), (F.col("c_custkey") % 500).alias("right_id"))
    return identity.review(q, links)


@query("""with s as (select o_custkey as player_id, year(o_orderdate)::bigint as season_id, count(*)::bigint as n, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ' / ') as teams from orders group by all)
 select player_id, count(*)::bigint as n_seasons, sum(n)::bigint as n, string_agg(season_id || ': ' || n || ' (' || teams || ')', '; ' order by season_id desc) as seasons from s group by 1""")
def season_refs(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("player_id"), year("o_orderdate").alias("season_id")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), " / ").alias("teams"))
    line = F.format_string("%d: %d (%s)", "season_id", "n", "teams")
    listed = F.sort_array(F.collect_list(F.struct("season_id", line.alias("line"))), asc=False)
    return s.groupBy("player_id").agg(F.count("*").alias("n_seasons"), F.sum("n").alias("n"), F.array_join(F.transform(listed, lambda x: x["line"]), "; ").alias("seasons"))
