"""Features, examples and predictions of the value model: as of a day, from earlier matches alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import constants as C

WINDOW_DAYS, MIN_MINUTES, MIN_COMPLETENESS = C.WINDOW_DAYS, C.MIN_PRIOR_MINUTES, C.MIN_COMPLETENESS
GROUPS = tuple(C.CATEGORY_WEIGHTS)
# Columns of asks, features and examples that are no features: identifiers, days, and what comes from the fee.
KEYS = ("ask_id", "player_id", "season_id", "day", "born", "features_as_of")
OF_THE_FEE = ("fee", "fee_status", "kind", "inflation_index", "fee_real", "label")
DESCRIPTIONS = ("position_group", "league_confidence", "transfer_window", "feature_completeness")


def trailing_features(asks: DataFrame, matches: DataFrame, codes: list[str] = C.VALUE_CODES, *, days: int = WINDOW_DAYS) -> DataFrame:
    """asks (ask_id, player_id, day) with features_as_of, minutes, n_matches, starts_share, <code>_p90, aerial_rate, and
    season_id if matches have one.

    matches: player_id, day, minutes, started and a column per code (the rate needs aerial_duels and aerial_duels_won);
    with season_id and match_id, season_id is that of the last earlier match, of one day's that with the largest match_id. Asked days and matches are sorted together per player: a range frame over the `days` days before an
    asked day sees matches only, so nothing is joined by range and no match of the day or later counts. Per-90 values
    need 90 minutes; features_as_of is null without any earlier match.
    """
    number = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    sums = ["minutes", "started", *codes]
    last = F.struct("day", "match_id", "season_id") if "season_id" in matches.columns else F.lit(None)
    played = matches.withColumn("__last", last).select(F.lit(None).cast("long").alias("ask_id"), "player_id", "day", F.col("minutes").cast("double").alias("minutes"), F.col("started").cast("double").alias("started"), *[F.col(c).cast("double").alias(c) for c in codes], "__last", F.lit(1).alias("__match"))
    wanted = asks.select(F.col("ask_id").cast("long").alias("ask_id"), "player_id", "day", *[F.lit(None).cast("double").alias(c) for c in sums], F.lit(0).alias("__match"))
    both = played.unionByName(wanted, allowMissingColumns=True).withColumn("__day", number)
    before = Window.partitionBy("player_id").orderBy("__day")
    window, earlier = before.rangeBetween(-days, -1), before.rangeBetween(Window.unboundedPreceding, -1)
    x = both.withColumns({f"__{c}": F.sum(c).over(window) for c in sums} | {"n_matches": F.sum("__match").over(window), "features_as_of": F.max(F.when(F.col("__match") == 1, F.col("day"))).over(earlier), "__last": F.max("__last").over(earlier)}).filter("__match = 0")
    minutes = F.coalesce("__minutes", F.lit(0.0))
    per90 = {f"{c}_p90": F.when(minutes >= 90, F.coalesce(F.col(f"__{c}"), F.lit(0.0)) / (minutes / 90.0)) for c in codes}
    if {"aerial_duels", "aerial_duels_won"} <= set(codes):
        per90["aerial_rate"] = F.when(F.col("__aerial_duels") > 0, F.col("__aerial_duels_won") / F.col("__aerial_duels"))
    n = F.coalesce("n_matches", F.lit(0)).cast("long")
    return x.select("ask_id", "player_id", "day", "features_as_of", minutes.alias("minutes"), n.alias("n_matches"), F.try_divide(F.col("__started"), n.cast("double")).alias("starts_share"), *[c.alias(k) for k, c in per90.items()], *([F.col("__last.season_id").alias("season_id")] if "season_id" in matches.columns else []))


def season_features(rows: DataFrame, players: DataFrame, positions: DataFrame, strength: DataFrame) -> DataFrame:
    """rows (of trailing_features, with season_id) with born, height, position_group, selling_strength and league_confidence.

    players: player_id, born, height. positions: player_id, season_id, position_group (one a season). strength: season_id,
    strength, confidence. Group and strength are those of the season of the last match before the day; null where unknown.
    """
    x = rows.join(players.select("player_id", "born", F.col("height").cast("double").alias("height")), "player_id", "left")
    x = x.join(positions.select("player_id", "season_id", "position_group"), ["player_id", "season_id"], "left")
    of = strength.select("season_id", F.col("strength").cast("double").alias("selling_strength"), F.col("confidence").alias("league_confidence"))
    return x.join(of, "season_id", "left")


def personal_features(rows: DataFrame) -> DataFrame:
    """rows (day, born, position_group) with age, age_sq and a 0 or 1 per position group."""
    age = F.datediff(F.col("day"), F.col("born")) / F.lit(365.25)
    ones = {f"group_{g}": F.coalesce((F.col("position_group") == g).cast("double"), F.lit(0.0)) for g in GROUPS}
    return rows.withColumns({"age": age, "age_sq": age * age} | ones)


def completeness(names: list[str]) -> Column:
    """Share of the named features that are known."""
    return sum((F.col(n).isNotNull().cast("double") for n in names), F.lit(0.0)) / F.lit(float(len(names)))


def examples(transfers: DataFrame, features: DataFrame, index: DataFrame, names: list[str], *, min_minutes: float = MIN_MINUTES, min_completeness: float = MIN_COMPLETENESS) -> DataFrame:
    """One row per disclosed permanent transfer with a fee and enough features, with label = log1p(fee / index).

    transfers: ask_id, fee_status, kind, fee. features: of trailing_features and personal_features. index: year, index;
    a missing year counts as 1. Features as of the day itself or later are an error, raised where the row is read.
    """
    disclosed = transfers.filter("fee_status = 'disclosed' and kind = 'permanent' and fee > 0").select("ask_id", "fee")
    guard = F.when(F.col("features_as_of") < F.col("day"), F.col("features_as_of")).otherwise(F.raise_error(F.lit("features from the transfer day or later")).cast("date"))
    x = features.filter("features_as_of is not null").withColumn("features_as_of", guard).join(disclosed, "ask_id")
    x = x.withColumn("feature_completeness", completeness(names)).filter((F.col("minutes") >= min_minutes) & (F.col("feature_completeness") >= min_completeness))
    x = x.withColumn("__year", F.year("day")).join(index.select(F.col("year").alias("__year"), F.col("index").alias("inflation_index")), "__year", "left").drop("__year")
    x = x.withColumn("inflation_index", F.coalesce("inflation_index", F.lit(1.0)))
    real = F.col("fee") / F.col("inflation_index")
    return x.withColumns({"fee_real": real, "label": F.log1p(real), "transfer_window": F.when(F.month("day").between(6, 9), "summer").otherwise("winter")})


def feature_columns(rows: DataFrame, more: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns of examples that are features: no identifier, no day, nothing that comes from the fee, none of more."""
    out = {*KEYS, *OF_THE_FEE, *DESCRIPTIONS, *more}
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, NumericType) and f.name not in out]


def evaluate_by(predicted: DataFrame, key: str, *, label: str = "label", prediction: str = "predicted", least: int = 5) -> DataFrame:
    """key, n, mae_log, within_50 for the values of a key with enough test rows."""
    y, p = F.col(label), F.col(prediction)
    near = F.abs(F.expm1(p) - F.expm1(y)) <= 0.5 * F.expm1(y)
    return predicted.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.abs(y - p)).alias("mae_log"), F.avg(near.cast("double")).alias("within_50")).filter(F.col("n") >= least)


def linear_explanation(rows: DataFrame, coefficients: dict[str, tuple[float, float, float]], top: int = 8) -> DataFrame:
    """rows with factors: array of (feature, contribution), the largest by size first.

    coefficients: feature -> (coefficient, mean, deviation) of a model on standardised features.
    """
    each = [F.struct(F.round(F.lit(c) * (F.col(n) - F.lit(m)) / F.lit(s or 1.0), 4).alias("contribution"), F.lit(n).alias("feature")) for n, (c, m, s) in coefficients.items()]
    ranked = F.array_sort(F.array(*each), lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1))
    return rows.withColumn("factors", F.transform(F.slice(ranked, 1, top), lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution"))))


def comparables(rows: DataFrame, training: DataFrame, *, days: str = "age_days", within: int = 730, most: int = 45_000) -> DataFrame:
    """rows with n_comparables: training examples whose age is within so many days (two years); 0 without an age.

    Ages are whole days, so their counts fit a table of `most` + 1 rows (123 years; ages are cut to 0 to `most`) whatever
    the data: it is summed along age and broadcast, and a row's count is the difference of two of its sums.
    """
    spark = rows.sparkSession
    cut = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(most)).cast("long")
    counted = training.filter(F.col(days).isNotNull()).groupBy(cut(F.col(days)).alias("id")).agg(F.count("*").alias("n"))
    along = spark.range(most + 1).join(counted, "id", "left").select("id", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("id")).alias("upto"))
    high = F.broadcast(along.select(F.col("id").alias("__h"), F.col("upto").alias("__high")))
    low = F.broadcast(along.select(F.col("id").alias("__l"), F.col("upto").alias("__low")))
    age = cut(F.col(days))
    x = rows.join(high, cut(age + within) == F.col("__h"), "left").join(low, age - within - 1 == F.col("__l"), "left")
    n = F.coalesce("__high", F.lit(0)) - F.coalesce("__low", F.lit(0))
    return x.withColumn("n_comparables", F.when(F.col(days).isNull(), F.lit(0)).otherwise(n).cast("long")).drop("__h", "__l", "__high", "__low")


def prediction_confidence(minutes: Column, complete: Column, n_comparables: Column, low: Column, high: Column, value: Column, *, min_minutes: float = MIN_MINUTES, min_completeness: float = MIN_COMPLETENESS) -> Column:
    """struct(score, tier, width): four terms of minutes, completeness, comparables and the interval's relative width."""
    one = F.lit(1.0)
    width = (high - low) / F.greatest(value, one)
    score = 0.35 * F.least(one, minutes / 1800.0) + 0.25 * complete + 0.2 * F.least(one, n_comparables / 100.0) + 0.2 * F.greatest(F.lit(0.0), 1 - width / 3.0)
    thin = (minutes < min_minutes) | (complete < min_completeness)
    tier = F.when(thin, "low").when((score >= 0.75) & (n_comparables >= 30), "high").when(score >= 0.5, "medium").otherwise("low")
    return F.struct(F.round(score, 3).alias("score"), tier.alias("tier"), F.round(width, 3).alias("width"))


def record_runs(runs: DataFrame, results: DataFrame, artifact: str | None) -> DataFrame:
    """runs plus one per algorithm of results (run_id, algorithm, validation_error); the best one has the artifact."""
    best = results.agg(F.min(F.struct("validation_error", "algorithm"))["algorithm"].alias("__best"))
    new = results.join(F.broadcast(best))  # one row
    new = new.withColumns({"artifact": F.when(F.col("algorithm") == F.col("__best"), F.lit(artifact)), "is_active": F.lit(False)}).drop("__best")
    return runs.unionByName(new, allowMissingColumns=True)


def activate(runs: DataFrame, run_id: int) -> DataFrame:
    """runs with exactly that one active."""
    return runs.withColumn("is_active", F.col("run_id") == run_id)


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    """rows, or a ValueError where there are none to train on."""
    if rows.isEmpty():
        raise ValueError(f"no {what}")
    return rows
