"""Rules, read operators and value features beyond what their SQL oracles cover."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from peerlens.functions import rules
from peerlens.operators import reads, value_features


def test_config_hash_and_exclusion(spark):
    assert rules.config_hash({"b": 1, "a": [2]}) == rules.config_hash({"a": [2], "b": 1}) != rules.config_hash({"a": [2], "b": 2})
    assert len(rules.config_hash({})) == 12
    leagues = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.9), (4, 0.5)], "id long, score double")
    ids = lambda **o: (sorted(r["id"] for r in rules.exclusion(leagues, **o)[0].collect()), rules.exclusion(leagues, **o)[1])
    assert ids(explicit=[7, 7, 1]) == ([1, 7], "manually configured")
    assert ids(exclude_top=False) == ([], "none") and ids(top=2) == ([2, 3], "model") and ids() == ([2, 3, 4], "model")


def test_rules_on_missing_values(spark):
    x = spark.createDataFrame([(dt.date(2000, 6, 30), "\u00a0Korea\u00a0Republic "), (None, None)], "born date, name string")
    got = x.select(
        rules.age_between(F.col("born"), F.lit(2020)).alias("any"),
        rules.age_between(F.col("born"), F.lit(2020), low=19.9).alias("old"),
        rules.age_between(F.col("born"), F.lit(2020), high=19).alias("young"),
        rules.country_name(F.col("name"), {"Korea Republic": "South Korea"}).alias("c"),
        rules.country_name(F.col("name"), {}).alias("same"),
    ).collect()
    assert [tuple(r) for r in got] == [(True, True, False, "South Korea", "Korea Republic"), (True, False, False, None, None)]


def test_leakage_is_an_error(spark):
    day = dt.date(2020, 7, 1)
    f = spark.createDataFrame([(1, day, day, 900.0, 1.0)], "ask_id long, day date, features_as_of date, minutes double, a double")
    t = spark.createDataFrame([(1, "disclosed", "permanent", 5.0)], "ask_id long, fee_status string, kind string, fee double")
    index = spark.createDataFrame([], "year int, index double")
    with pytest.raises(Exception, match="transfer day or later"):
        value_features.examples(t, f, index, ["a"]).collect()
    earlier = f.withColumn("features_as_of", F.lit("2020-06-30").cast("date"))
    row = value_features.examples(t, earlier, index, ["a"]).first()
    assert row["inflation_index"] == 1.0 and row["transfer_window"] == "summer" and row["fee_real"] == 5.0
    assert value_features.feature_columns(value_features.examples(t, earlier, index, ["a"])) == ["minutes", "a"]
    with pytest.raises(ValueError, match="no transfers"):
        value_features.require_rows(t.limit(0), "transfers")


def test_trailing_features_edges(spark):
    """A match of the day itself and one 366 days before don't count; one 365 days before does."""
    day = dt.date(2020, 7, 1)
    m = spark.createDataFrame([(1, day, 90, 1, 9), (1, day - dt.timedelta(365), 80, 1, 2), (1, day - dt.timedelta(366), 70, 0, 5)], "player_id long, day date, minutes int, started int, goals int")
    asks = spark.createDataFrame([(1, 1, day), (2, 2, day), (3, 1, day - dt.timedelta(365))], "ask_id long, player_id long, day date")
    got = {r["ask_id"]: r for r in value_features.trailing_features(asks, m, ["goals"]).collect()}
    assert (got[1]["minutes"], got[1]["n_matches"], got[1]["goals_p90"], got[1]["features_as_of"]) == (80.0, 1, None, day - dt.timedelta(365))
    assert (got[2]["minutes"], got[2]["features_as_of"], got[2]["starts_share"]) == (0.0, None, None)
    assert (got[3]["minutes"], got[3]["n_matches"], got[3]["starts_share"]) == (70.0, 1, 0.0)


def test_comparables_against_pairs(spark):
    rows = [(i, a) for i, a in enumerate([None, 0, 700, 730, 9000, 9001, 44_990, 60_000])]
    ages = [0, 1, 730, 1460, 8270, 8271, 9730, 9731, 9732, 44_000, None]
    got = value_features.comparables(spark.createDataFrame(rows, "id long, age_days long"), spark.createDataFrame([(a,) for a in ages], "age_days long")).collect()
    for r in got:
        a = None if r["age_days"] is None else min(r["age_days"], 45_000)
        assert r["n_comparables"] == (0 if a is None else sum(abs(a - x) <= 730 for x in ages if x is not None)), r


def test_reads_on_empty_tables(spark):
    players = spark.createDataFrame([(1, "A B", None, None)], "player_id long, full_name string, known_as string, born date")
    sources, seasons = spark.createDataFrame([], "player_id long, code string"), spark.createDataFrame([], "player_id long, season_id long, end_year long, minutes long")
    got = reads.player_summary(players, sources, seasons, F.current_date()).first()
    assert (got["display_name"], got["sources"], got["latest_season"], got["age"]) == ("A B", [], None, None) and "date of birth" in got["age_note"]
    got = reads.player_quality(players, seasons, sources).first()
    assert (got["seasons_loaded"], got["total_minutes"], got["n_sources"], got["flags"]) == (0, 0, 0, ["missing_date_of_birth"])
