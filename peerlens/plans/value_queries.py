"""Queries of the value model: features as of a day, examples, intervals, runs and scores. Matches and asked days are the
orders of a customer; players are customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.storage import fresh_folder, written
from ..operators import value_features, value_model, value_runs
from ..operators.boosting import Settings
from .queries import query, table

CODES, GROUPS = C.VALUE_CODES, value_features.GROUPS
FEATURES = ("minutes", "n_matches", "starts_share", *[f"{c}_p90" for c in CODES], "aerial_rate", "age", "age_sq", "height", "selling_strength")

_SUMS = ",\n  ".join(f"sum((o_orderkey * {i + 3} % {i + 4})::double) over y as {c}" for i, c in enumerate(CODES))
_P90 = ",\n  ".join(f"case when minutes >= 90 then coalesce({c}, 0.0) / (minutes / 90.0::double) end as {c}_p90" for c in CODES)
_GROUPS = ", ".join(f"coalesce((position_group = '{g}')::int, 0)::double as group_{g}" for g in GROUPS)
_KNOWN = " + ".join(f"({f} is not null)::int" for f in FEATURES)
# An order's window sees orders of earlier days alone; the key of the last earlier one is its day and its number.
FEATURES_SQL = f"""with o as (select o_orderkey, o_custkey as player_id, o_orderdate::date as day, date_diff('day', date '1970-01-01', o_orderdate::date)::bigint * 100000000 + o_orderkey as k, year(o_orderdate) * 10 + o_orderkey % 3 as season_id, round(o_totalprice)::double as fee,
  case o_orderkey % 4 when 0 then 'undisclosed' else 'disclosed' end as fee_status, case o_orderkey % 5 when 0 then 'loan' else 'permanent' end as kind from orders),
 w as (select o_orderkey as ask_id, player_id, day, fee, fee_status, kind, coalesce(sum((o_orderkey % 900)::double) over y, 0.0)::double as minutes, count(*) over y as n_matches, sum((o_orderkey % 2)::double) over y as started, max(k) over e as k,
  {_SUMS}
  from o window y as (partition by player_id order by day range between interval 365 days preceding and interval 1 day preceding), e as (partition by player_id order by day range between unbounded preceding and interval 1 day preceding)),
 l as (select w.*, o.day as features_as_of, o.season_id from w left join o using (k)),
 p as (select l.*, case when player_id % 7 <> 0 then date '1975-01-01' + (player_id % 3000)::int end as born, case when player_id % 5 <> 0 then (160 + player_id % 40)::double end as height,
  ['GK', 'CB', 'FB', 'CM', 'AMW', 'ST'][1 + (player_id + season_id) % 7] as position_group, case when season_id % 4 <> 0 then (season_id % 10 / 10.0)::double end as selling_strength from l),
 f as (select *, started / nullif(n_matches, 0)::double as starts_share,
  {_P90},
  case when aerial_duels > 0 then aerial_duels_won / aerial_duels end as aerial_rate, date_diff('day', born, day) / 365.25::double as age, age * age as age_sq, {_GROUPS} from p),
 c as (select *, ({_KNOWN})::double / {len(FEATURES)}.0::double as complete from f)"""


def value_rows(spark, d) -> DataFrame:
    """Features of every order as of its day, with fee, fee_status and kind."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    day, season = F.to_date("o_orderdate").alias("day"), F.year("o_orderdate") * 10 + k % 3
    matches = o.select(F.col("o_custkey").alias("player_id"), day, k.alias("match_id"), season.alias("season_id"), (k % 900).alias("minutes"), (k % 2).alias("started"), *[(k * (i + 3) % (i + 4)).alias(c) for i, c in enumerate(CODES)])
    fees = o.select(k.alias("ask_id"), F.round("o_totalprice").alias("fee"), F.when(k % 4 == 0, "undisclosed").otherwise("disclosed").alias("fee_status"), F.when(k % 5 == 0, "loan").otherwise("permanent").alias("kind"))
    x = value_features.trailing_features(o.select(k.alias("ask_id"), F.col("o_custkey").alias("player_id"), day), matches)
    c = F.col("c_custkey")
    players = table(spark, d, "customer").select(c.alias("player_id"), F.when(c % 7 != 0, F.date_add(F.lit("1975-01-01").cast("date"), (c % 3000).cast("int"))).alias("born"), F.when(c % 5 != 0, 160 + c % 40).alias("height"))
    seen = matches.select("player_id", "season_id").distinct()
    at = ((F.col("player_id") + F.col("season_id")) % 7).cast("int")
    positions = seen.select("player_id", "season_id", F.get(F.array(*map(F.lit, GROUPS)), at).alias("position_group"))
    s = F.col("season_id")
    strength = seen.select("season_id").distinct().select("season_id", F.when(s % 4 != 0, s % 10 / 10.0).alias("strength"), F.lit("medium").alias("confidence"))
    x = value_features.personal_features(value_features.season_features(x, players, positions, strength))
    return x.withColumn("feature_completeness", value_features.completeness(list(FEATURES))).join(fees, "ask_id")


def _rounded(*names: str) -> list:
    return [F.round(n, 9).alias(n) for n in names]


@query(FEATURES_SQL + f""" select ask_id, features_as_of::varchar as features_as_of, minutes, n_matches, season_id::bigint as season_id, {", ".join(f"round({f}, 9) as {f}" for f in FEATURES[2:])},
 {", ".join(f"group_{g}" for g in GROUPS)}, round(complete, 9) as complete from c""")
def value_features_as_of(spark, d):
    x = value_rows(spark, d)
    return x.select("ask_id", F.col("features_as_of").cast("string").alias("features_as_of"), "minutes", "n_matches", F.col("season_id").cast("long").alias("season_id"), *_rounded(*FEATURES[2:]), *[f"group_{g}" for g in GROUPS], F.round("feature_completeness", 9).alias("complete"))


@query(FEATURES_SQL + """ select ask_id, round(complete, 9) as feature_completeness, round(age_sq, 6) as age_sq, round(ln(1 + fee / (case when year(day) % 2 = 0 then 1.0 + (year(day) - 1990) / 10.0 else 1.0 end)::double), 9) as label,
 case when month(day) between 6 and 9 then 'summer' else 'winter' end as transfer_window, group_FB, group_CM, group_AMW from c
 where features_as_of is not null and fee_status = 'disclosed' and kind = 'permanent' and fee > 0 and minutes >= 450 and complete >= 0.6""")
def value_examples(spark, d):
    x = _examples(spark, d)
    return x.select("ask_id", F.round("feature_completeness", 9).alias("feature_completeness"), F.round("age_sq", 6).alias("age_sq"), F.round("label", 9).alias("label"), "transfer_window", "group_FB", "group_CM", "group_AMW")


def _examples(spark, d) -> DataFrame:
    rows = value_rows(spark, d)
    index = spark.range(1990, 2010, 2).select(F.col("id").cast("int").alias("year"), (1.0 + (F.col("id") - 1990) / 10.0).alias("index"))
    fees = rows.select("ask_id", "fee_status", "kind", "fee")
    return value_features.examples(fees, rows.drop("fee", "fee_status", "kind", "feature_completeness"), index, list(FEATURES))


def _parts(spark, d) -> tuple[DataFrame, list[str]]:
    """Examples by time, with a label that some features tell something about, and their feature columns."""
    x = _examples(spark, d)
    names = value_features.feature_columns(x)
    told = F.coalesce("npxg_p90", F.lit(0.0)) / 10 + F.coalesce("age", F.lit(25.0)) / 10 + F.col("group_ST")
    x = x.withColumn("label", F.col("label") / 4 + told).withColumn("age_days", F.datediff("day", "born"))
    return value_model.split_by_time(x.withColumn("y", F.year("day")), "y", 1998, 2000), names


SMALL = Settings(iterations=5, depth=3, rate=0.4)


@query()
def value_scores(spark, d):
    """Runs are trained, the best one is saved and read back, and all test examples are scored with what was read. Examples
    are made once, for training and for scoring."""
    x, names = _parts(spark, d)
    x = written(x, "value-rows")
    runs, _ = value_runs.train_runs(x, names, "label", folder=fresh_folder(spark, "value-runs"), kinds=("ridge", "hist_boosting"), settings=SMALL)
    saved = next(r["artifact"] for r in runs if r["artifact"])
    out = value_runs.score(x.filter("part = 'test'"), value_runs.load(spark, saved))
    return out.select("ask_id", "label", "predicted", "low", "high", "value", "low_value", "high_value", "n_comparables", F.col("confidence.tier").alias("tier"), F.col("factors")[0]["feature"].alias("first_factor"), F.col("factors")[0]["contribution"].alias("first_contribution"))


@query()
def value_run_metrics(spark, d):
    """A row per run and part; the best run has the coverage of its interval."""
    x, names = _parts(spark, d)
    runs, _ = value_runs.train_runs(x, names, "label", kinds=("ridge", "hist_boosting"), settings=SMALL, bands=("position_group",))
    rows = [(r["run_id"], r["algorithm"], part, m["n"], m["mae_log"], m["within_50"], m.get("interval_coverage")) for r in runs for part, m in r["metrics"].items()]
    return spark.createDataFrame(rows, "run_id long, algorithm string, part string, n long, mae_log double, within_50 double, interval_coverage double")
