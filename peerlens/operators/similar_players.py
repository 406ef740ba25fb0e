"""The whole search for similar profiles: eligible candidates, nearest vectors, scores, confidence, explanation, rank."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import rules
from . import similarity

SHOWN = ("profile_id", "player_id", "season_id", "minutes", "primary", "secondary", "strength")


@dataclass(frozen=True)
class Filters:
    """What a search may return. Ages are those on 30 June of the candidate's season; weights replace the group's own."""

    min_minutes: float = 900
    latest_season_only: bool = True
    competitions: tuple[int, ...] = ()
    min_age: float | None = None
    max_age: float | None = None
    mode: str = "raw"
    limit: int = 10
    candidates: int = C.SIM_CANDIDATES
    weights: Mapping[str, float] | None = None


def latest_targets(profiles: DataFrame, players: DataFrame, *, mode: str = "raw") -> DataFrame:
    """One profile for each of players (player_id, and season_id where a season is asked for): of the latest season,
    then with most minutes, then of the smallest profile_id."""
    rows = profiles.filter(F.col("mode") == mode)
    on = [c for c in ("player_id", "season_id") if c in players.columns]
    w = Window.partitionBy(*on).orderBy(F.desc("end_year"), F.desc("minutes"), "profile_id")
    return rows.join(players.select(*on).distinct(), on, "left_semi").withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def eligible(profiles: DataFrame, filters: Filters, excluded: DataFrame | None = None) -> DataFrame:
    """Profiles that a search may return. excluded: id of competitions, as rules.exclusion gives them.

    A player's latest season is looked for among profiles of the same group that the mode, the minutes and the excluded
    competitions leave, before ages and competitions count.
    """
    x = profiles.filter((F.col("mode") == filters.mode) & (F.col("minutes") >= filters.min_minutes))
    if excluded is not None:
        x = x.join(excluded.select(F.col("id").alias("competition_id")).distinct(), "competition_id", "left_anti")
    if filters.latest_season_only:
        last = F.max("end_year").over(Window.partitionBy("player_id", "position_group"))
        x = x.withColumn("__last", last).filter("end_year = __last").drop("__last")
    if filters.competitions:
        x = x.filter(F.col("competition_id").isin(*filters.competitions))
    return x.filter(rules.age_between(F.col("date_of_birth"), F.col("end_year"), filters.min_age, filters.max_age))


def find_similar_all(profiles: DataFrame, targets: DataFrame, filters: Filters = Filters(), excluded: DataFrame | None = None, *, layouts: Mapping[str, str] | None = None) -> DataFrame:
    """The ranked profiles most like each target's: a row per target and candidate, at most filters.limit a target.

    profiles, targets: profile_id (long, unique), player_id, season_id, end_year, competition_id, tournament (boolean),
    gender, mode, position_group, minutes, vector, z (map of code to score), primary, secondary, date_of_birth,
    strength, league_confidence. Candidates share the target's group and gender and are of another player; the nearest
    by vector are scored by category, weighed, and multiplied with the positions' compatibility. Targets without a
    candidate, or of a group without a layout, have no row; one without a known position counts as CM. All groups and
    genders are searched in one scan for each block of targets, and what follows has at most filters.candidates rows a
    target.
    """
    layouts = layouts or {g: C.GK_FEATURES if g == "GK" else C.FEATURES for g in C.CATEGORY_WEIGHTS}
    pool = eligible(profiles, filters, excluded)
    sizes = profiles.filter((F.col("mode") == filters.mode) & (F.col("minutes") >= filters.min_minutes)).groupBy("position_group").agg(F.count("*").alias("n"))
    pool_n = {r["position_group"]: float(r["n"]) for r in sizes.filter("position_group is not null").collect()}  # a row per position group
    own = profiles.join(targets.select("player_id").distinct(), "player_id", "left_semi").groupBy("player_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    # A player's own profiles are among the nearest: as many more are sought, then they go.
    near = similarity.nearest_all(pool, targets, key="profile_id", within=("position_group", "gender"), k=filters.candidates + own)
    t = targets.select(F.col("profile_id").alias("target"), F.col("position_group").alias("group"), F.struct("z", "player_id", "minutes", "primary", "secondary").alias("t"))
    c = pool.select(F.col("profile_id").alias("candidate"), F.struct("z", "tournament", "league_confidence", *SHOWN).alias("c"))
    pairs = near.join(t, "target").join(c, "candidate").filter(F.col("t.player_id") != F.col("c.player_id"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy("distance", "candidate"))
    pairs = pairs.withColumn("__r", rank).filter(F.col("__r") <= filters.candidates).drop("__r")

    listed = {layout: C.features(layout) for layout in set(layouts.values())}
    features = F.lit(None)
    for layout, fs in sorted(listed.items()):
        shared = F.col("group").isin(*[g for g, x in layouts.items() if x == layout])
        features = F.when(shared, F.array(*[F.struct(F.lit(a).alias("category"), F.lit(n).alias("code"), F.lit(w).alias("weight")) for a, n, w in fs])).otherwise(features)
    long = pairs.select("target", "candidate", "group", "t.z", F.col("c.z").alias("z2"), F.explode(features).alias("f"))
    long = long.select("target", "candidate", "group", "f.*", F.try_element_at("z", F.col("f.code")).alias("tz"), F.try_element_at("z2", F.col("f.code")).alias("cz"))
    total = _by_group({g: float(sum(w for *_, w in listed[x])) for g, x in layouts.items()})
    of_category = similarity.category_similarity(long, keep=("group",))
    scored = similarity.combine(of_category, F.col("group"), total, weights=filters.weights, keep=("group",)).drop("group")
    compat = similarity.best_compatibility(F.coalesce("t.primary", F.lit("CM")), F.col("t.secondary"), F.coalesce("c.primary", F.lit("CM")), F.col("c.secondary"))
    sure = similarity.confidence(F.col("t.minutes").cast("double"), F.col("c.minutes").cast("double"), F.col("usable"), F.coalesce(_by_group(pool_n), F.lit(0.0)), F.col("c.league_confidence"), F.coalesce("c.tournament", F.lit(False)))
    x = pairs.join(scored, ["target", "candidate"]).join(similarity.explain(long), ["target", "candidate"])
    x = x.withColumns({"compat": compat, "sure": sure}).withColumn("final", F.round(F.col("similarity") * F.col("compat.value"), 2))
    order = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("final"), "distance", "candidate"))
    ranked = x.withColumn("rank", order).filter(F.col("rank") <= filters.limit)
    return ranked.select(
        "target", "rank", "candidate", *[F.col(f"c.{n}").alias(n) for n in SHOWN[1:]], F.round("similarity", 2).alias("similarity"), F.round("compat.value", 2).alias("compatibility"), F.col("compat.pair").alias("compatibility_basis"),
        "final", F.round("usable", 3).alias("usable"), F.col("sure.score").alias("confidence"), F.col("sure.tier").alias("tier"), "categories", "supporting", "divergent",
    )


def _by_group(values: Mapping[str, float]) -> Column:
    """The value of the row's group, null for one that has none."""
    if not values:
        return F.lit(None).cast("double")
    return F.try_element_at(F.create_map(*[v for g, n in values.items() for v in (F.lit(g), F.lit(n))]), F.col("group"))


def with_identity(found: DataFrame, players: DataFrame) -> DataFrame:
    """found + the other columns of players (player_id and what is shown of them); unknown players keep a row."""
    return found.join(players.dropDuplicates(["player_id"]), "player_id", "left")


STORED = "key string, path string, created timestamp"


def stored_result(spark: SparkSession, folder: str, *, config: dict, request: dict, build: Callable[[], DataFrame], max_age: timedelta = timedelta(hours=6), now: datetime | None = None) -> DataFrame:
    """What build() gives for a request, read back where it was stored under the same configuration less than max_age ago.

    Results are tables of their own under folder; an index, one row each, says which configuration and request (by hash)
    they answer and since when. A changed configuration or request, or one that has expired, is built and stored anew; of
    several the newest counts, so two jobs that build at once do no harm. now: for tests.
    """
    now = now or datetime.now(UTC).replace(tzinfo=None)
    key = f"{rules.config_hash(config)}-{rules.config_hash(request)}"
    index = f"{folder}/index"
    try:
        known = spark.read.schema(STORED).parquet(index).filter((F.col("key") == key) & (F.col("created") > F.lit(now - max_age))).orderBy(F.desc("created"), "path").limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = []
    if known:
        return spark.read.parquet(known[0]["path"])
    path = f"{folder}/results/{key}-{uuid.uuid4().hex}"
    build().write.parquet(path)
    spark.createDataFrame([(key, path, now)], STORED).coalesce(1).write.mode("append").parquet(index)
    return spark.read.parquet(path)
