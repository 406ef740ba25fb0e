import glob
import os

import duckdb
import pytest

from peerlens.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_oracle(spark, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    q = db.sql(ORACLE_SQL[name])
    assert sorted(q.columns) == columns
    at = [q.columns.index(c) for c in columns]
    assert rows == sorted(str(tuple(r[i] for i in at)) for r in q.fetchall())


@pytest.mark.parametrize("name", ["season_team_stats", "season_player_stats"])
def test_season_sums_are_shuffled_by_player_and_season_alone(spark, name):
    """No sum by code or team has a shuffle of its own."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and not [k for k in keys if "code#" in k or "team_id#" in k]
