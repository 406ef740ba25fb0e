"""Job log, listing-driven scans and the season tables' sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from peerlens.operators import aggregates
from peerlens.sources import jobs, readers, sinks


def test_job_counts_come_from_the_write(spark, tmp_path):
    path, log = str(tmp_path / "out"), str(tmp_path / "log")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = spark.range(10).withColumn("season_id", F.col("id") % 2).mapInArrow(counted, "id long, season_id long")
    error = F.when(F.col("id") % 4 == 3, F.concat(F.lit("bad "), "id"))
    job = dict(job_type="load", params={"season": "1"}, key=F.col("id"), error=error, log=log, by=("season_id",))
    assert jobs.run_job(rows, path, job_id="a", **job) == "partial" and reads.value == 10
    assert jobs.run_job(rows.filter("id % 4 <> 3"), path, job_id="b", **job) == "succeeded"
    assert jobs.run_job(rows.filter("id % 4 = 3"), path, job_id="c", **job) == "partial"
    assert jobs.run_job(rows.limit(0), path, job_id="d", **job) == "succeeded"
    with pytest.raises(Exception, match="no good"):
        jobs.run_job(rows.withColumn("x", F.raise_error(F.lit("no good")).cast("int")), path, job_id="e", **job)
    got = {r["job_id"]: r for r in spark.read.schema(jobs.JOBS).parquet(log).collect()}
    assert {k: (r["status"], r["rows_read"], r["rows_written"], r["rows_failed"]) for k, r in got.items()} == {"a": ("partial", 10, 8, 2), "b": ("succeeded", 8, 8, 0), "c": ("partial", 2, 0, 2), "d": ("succeeded", 0, 0, 0), "e": ("failed", None, None, None)}
    assert [(f["key"], f["error"]) for f in got["a"]["failed"]] == [("3", "bad 3"), ("7", "bad 7")] and "no good" in got["e"]["error"]
    assert got["a"]["params"] == {"season": "1"} and got["a"]["started_at"] <= got["a"]["finished_at"]
    out = spark.read.parquet(path)
    assert sorted(r["id"] for r in out.filter("job = 'a' and state = 'ok'").collect()) == [0, 1, 2, 4, 5, 6, 8, 9]
    before = out.count()
    jobs.run_job(rows, path, job_id="a", **job)
    assert spark.read.parquet(path).count() == before


def test_listed_scan_opens_listed_files_only(spark, tmp_path):
    root = tmp_path / "events"
    for c, s, m in [(1, 1, 10), (1, 1, 11), (1, 2, 12), (2, 1, 13)]:
        folder = root / f"competition_id={c}" / f"season_id={s}" / f"match_id={m}"
        folder.mkdir(parents=True)
        # What the listing leaves out can't be read at all.
        (folder / "events.json").write_text(json.dumps([{"id": f"e{m}", "n": 1}, {"id": f"f{m}", "n": 2}]) if (c, s) == (1, 1) else "{ not json")
    listing = spark.createDataFrame([(1, 1, 10, "available"), (1, 1, 10, "available"), (1, 1, 11, "scheduled"), (1, 1, 99, "available"), (1, 2, 12, "available"), (2, 1, 13, "available")], "competition_id long, season_id long, match_id long, match_status string")
    wanted = readers.available_matches(listing, 1, 1)
    got = readers.read_listed(spark, str(root), "id string, n int", wanted, multiLine=True, mode="FAILFAST")
    assert sorted((r["match_id"], r["id"]) for r in got.collect()) == [(10, "e10"), (10, "f10")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    with pytest.raises(Exception, match="(?i)malformed|parse|fail"):
        readers.read_listed(spark, str(root), "id string, n int", readers.available_matches(listing, 1, 2), multiLine=True, mode="FAILFAST").collect()
    assert readers.read_listed(spark, str(root), "id string, n int", wanted.limit(0), multiLine=True, mode="FAILFAST").count() == 0


APPS = "player_id long, season_id long, team_id long, match_id long, day date, minutes double, minutes_elapsed double, started boolean, yellow_cards int, red_card boolean, minutes_by_position map<string,double>, source_id long"
DAY = dt.date(2020, 1, 1)


def season(spark, apps, stats):
    return aggregates.season_tables(spark.createDataFrame(apps, APPS), spark.createDataFrame(stats, "player_id long, season_id long, team_id long, code string, value double"), run="r", timestamp=F.lit(DAY).cast("timestamp"))


def test_season_tables_of_a_mover(spark, tmp_path):
    """Two teams in a season: rates out of sums at both levels, saves out of saves and conceded goals, per 90 and places."""
    apps = [(1, 1, 7, 1, DAY, 90.0, 95.0, True, 1, False, {"GK": 60.0, "unknown_x": 30.0}, 4), (1, 1, 8, 2, DAY + dt.timedelta(9), 45.0, 50.0, False, 0, True, {"CB": 20.0, "GK": 25.0}, 5), (1, 1, 8, 3, DAY, 0.0, 0.0, False, 0, False, None, 6)]
    stats = [(1, 1, 7, "gk_saves", 3.0), (1, 1, 7, "gk_goals_conceded", 1.0), (1, 1, 8, "gk_saves", 1.0), (1, 1, 8, "passes", 10.0), (1, 1, 8, "passes_completed", 5.0), (1, 1, 7, "passes", 2.0), (1, 1, 7, "passes_completed", 2.0)]
    t = season(spark, apps, stats)
    team = {(r["team_id"], r["code"]): (r["value"], r["minutes"], r["appearances"]) for r in t["team_stats"].collect()}
    assert team[7, "gk_save_pct"] == (75.0, 90.0, 1) and team[8, "gk_save_pct"] == (100.0, 45.0, 1) and team[8, "pass_completion_pct"][0] == 50.0
    total = {r["code"]: r for r in t["season_stats"].collect()}
    assert (total["gk_save_pct"]["value"], total["gk_save_pct"]["per90"]) == (80.0, None) and total["pass_completion_pct"]["value"] == 58.3333
    assert (total["minutes"]["value"], total["starts"]["value"], total["red_cards"]["value"], total["appearances"]["value"]) == (135.0, 1.0, 1.0, 2.0)
    assert total["gk_saves"]["per90"] == 2.66667 and total["minutes"]["per90"] is None and total["yellow_cards"]["per90"] == 0.66667 and {r["source_id"] for r in total.values()} == {5}
    assert [(r["code"], r["rank"], r["confidence"]) for r in t["positions"].collect()] == [("GK", 1, "medium")]
    assert t["observations"].count() == len(total) and {r["raw_ref"] for r in t["observations"].collect()} == {"events (season 1)"}
    for _ in range(2):
        sinks.write_season_tables(t, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "observations")).count() == len(total) == spark.read.parquet(str(tmp_path / "season_stats")).count()


def test_season_tables_of_nothing(spark):
    assert {k: v.count() for k, v in season(spark, [], []).items()} == {"team_stats": 0, "season_stats": 0, "observations": 0, "positions": 0}
    only_stats = season(spark, [], [(1, 1, 1, "npxg", 0.5)])["season_stats"].collect()
    assert [(r["code"], r["value"], r["minutes"], r["per90"], r["source_id"]) for r in only_stats] == [("npxg", 0.5, 0.0, None, None)]
