"""Reports and the quality scan on missing values and ties."""

import datetime as dt

from pyspark.sql import functions as F

from peerlens.operators import quality_scan, report

SEASON = "player_id long, display_name string, position string, position_group string, nationality string, age long, minutes double, appearances long, starts long, teams array<string>, competition string, season string, strength double, strength_confidence string"
METRIC = "player_id long, place long, name string, family string, value double, per90 double, is_rate boolean, percentile double, pool string, pool_n long"


def test_report_of_known_and_unknown(spark):
    seasons = spark.createDataFrame([(1, "A", "CB", "CB", "X", 20, 1234.5, 10, 9, ["T", "U"], "L", "2001", 0.625, "high"), (2, "B", None, None, None, None, 10.0, 1, 0, ["T"], "L", "2001", None, None)], SEASON)
    metrics = spark.createDataFrame([(1, i, f"m{i}", "discipline" if i == 0 else "passing", 10.25, 0.125, i == 3, p, "P", 40) for i, p in enumerate([99.0, 50.0, 50.0, 80.5, None, 10.0, 90.0, 20.0])], METRIC)
    values = spark.createDataFrame([(1, 2.5e6, 1.25e6, None, None)], "player_id long, value double, low double, high double, confidence string")
    got = {r["player_id"]: r for r in report.reports(seasons, metrics, values).collect()}
    one, two = got[1], got[2]
    assert one["overview"] == "A (CB, X, age 20) played 1234 minutes in 10 appearances (9 starts) for T / U in L 2001."
    assert one["key_strengths"] == ["m6 0.12/90 (90th, pool n=40)", "m3 10.2% (80th, pool n=40)", "m1 0.12/90 (50th, pool n=40)", "m2 0.12/90 (50th, pool n=40)", "m7 0.12/90 (20th, pool n=40)"]
    assert [x.split()[0] for x in one["weaknesses"]] == ["m5", "m7", "m1", "m2", "m3"] and one["performance_level"].endswith("50th.")
    assert one["statistical_profile"] == "6 of 8 metrics have a percentile within the CB pool (pool: P)." and one["league_context"].startswith("League strength 0.62 (high)")
    assert one["estimated_transfer_value"] == "€2.5M (range €1.2M–€0.0M, confidence insufficient)" and len(one["model_limitations"]) == 4
    assert two["overview"] == "B (position unknown, nationality unavailable, age unavailable) played 10 minutes in 1 appearances (0 starts) for T in L 2001."
    assert two["key_strengths"] == ["No percentile pool of sufficient size."] and two["performance_level"] == "Insufficient comparable players." and "No league-strength" in two["league_context"]
    assert two["model_limitations"][0] == "Sample size 10 minutes (< 900: treat with caution)" and "unavailable" in two["estimated_transfer_value"]
    found = spark.createDataFrame([(7, 1, 88.5), (7, 1, 12.0)], "target long, candidate long, final double")
    said = {r["player_id"]: r["similarity_to_target"] for r in report.with_target(report.reports(seasons, metrics, values), found).collect()}
    assert said[1] == "88.50 to 7" and said[2].startswith("Not in the target's")


def test_scan_replaces_its_open_flags(spark):
    players = spark.createDataFrame([(1, None, None), (2, None, 1), (3, dt.date(2000, 1, 1), None)], "player_id long, born date, merged_into long")
    stats = spark.createDataFrame([(1, 5, 269.5), (1, 6, 270.0), (3, 5, None)], "player_id long, season_id long, minutes double")
    seasons = spark.createDataFrame([(5, "single_team", None), (6, "full_league", "x")], "season_id long, coverage string, note string")
    reviews = spark.createDataFrame([(9, 3, 44, 0.8, "pending"), (10, 3, 45, 0.9, "approved")], "candidate_id long, player_id long, source_player_id long, score double, status string")
    apps = spark.createDataFrame([(1, 1, 940.0), (1, 2, 941.0), (2, 1, 1040.0)], "match_id long, team_id long, minutes double")
    matches = spark.createDataFrame([(1, 90.0), (2, 90.0)], "match_id long, regulation double")
    found = quality_scan.scan(players, stats, seasons, reviews, apps, matches)
    got = {(r["code"], r["entity_type"], r["entity_id"], r["season_id"]) for r in found.collect()}
    assert got == {("missing_date_of_birth", "player", 1, None), ("small_sample_season", "player", 1, 5), ("single_team_coverage", "season", 5, 5), ("pending_identity_review", "player", 3, None), ("match_minutes_mismatch", "match", 1, None), ("match_minutes_mismatch", "match", 2, None)}
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    first = found.select(*quality_scan.FLAGS).withColumns({"created_at": now, "resolved_at": F.when(F.col("entity_type") == "season", now)})
    other = first.limit(1).withColumn("code", F.lit("other")).withColumn("resolved_at", F.lit(None).cast("timestamp"))
    again = quality_scan.replace_open(first.unionByName(other), found, now)
    assert again.count() == found.count() + 2 and again.filter("code = 'other'").count() == 1
