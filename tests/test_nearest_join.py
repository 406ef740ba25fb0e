"""The join for nearest neighbours against comparing everything."""

import numpy as np
import pytest

from peerlens.operators import nearest_join as N

SCHEMA = "id long, g string, vector array<double>"


def brute(c, t, k, by_group):
    out = set()
    for i, g, v in t:
        if i is None or v is None:
            continue
        near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, h, w in c if j is not None and w is not None and j != i and (not by_group or h == g))[:k]
        out |= {(i, j, round(d, 9)) for d, j in near}
    return out


@pytest.mark.parametrize("by_group", [False, True])
def test_equals_comparing_everything(spark, monkeypatch, by_group):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 5)) * 20
    rows = [(i, "ab"[i % 3 % 2] if i % 7 else None, [float(x) for x in centres[i % 8] + rng.normal(size=5)]) for i in range(600)]
    rows += [(600, "a", rows[5][2]), (601, "a", rows[5][2]), (None, "a", rows[5][2]), (602, "a", None), (603, "alone", [0.0] * 5)]
    targets = [r for r in rows if r[0] is None or r[0] % 5 == 0]
    c, t = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(targets, SCHEMA)
    monkeypatch.setattr(N, "TARGETS_A_BLOCK", 7)
    monkeypatch.setattr(N, "CANDIDATES_A_BLOCK", 11)
    found, work = N.nearest_join(c, t, key="id", within=("g",) if by_group else (), k=4, pivots=8)
    assert {(r["target"], r["candidate"], round(r["distance"], 9)) for r in found.collect()} == brute(rows, targets, 4, by_group)
    w = work.first()
    assert 0 < w["computed"] < 0.6 * w["all"]


def test_few_and_none(spark):
    rows = spark.createDataFrame([(1, "a", [0.0]), (2, "a", [1.0])], SCHEMA)
    found, _ = N.nearest_join(rows, rows, key="id", k=10)
    assert sorted((r["target"], r["candidate"]) for r in found.collect()) == [(1, 2), (2, 1)]
    for c, t in ((rows.limit(0), rows), (rows, rows.limit(0))):
        found, work = N.nearest_join(c, t, key="id", k=3)
        assert found.count() == 0 and work.first()["computed"] == 0
