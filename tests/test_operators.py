import json
import math
import random
import statistics
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from peerlens.functions import constants as C
from peerlens.operators import identity, percentiles, sequence, similarity, temporal
from peerlens.operators.match_metrics import EVENT_SCHEMA, match_metrics
from peerlens.plans import queries as plans
from peerlens.sources import readers, sinks


def test_pool_levels(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("gh"), rng.randint(2010, 2014), rng.choice("AB"), rng.randint(0, 9), rng.random() < 0.6) for i in range(160)]
    df = spark.createDataFrame(rows, "id int, g string, y int, b string, v int, is_member boolean")
    got = {r["id"]: (r["level"], r["pool_n"], r["percentile"]) for r in percentiles.pool_percentiles(df, group=["g"], year="y", band="b", value="v", ids=["id"], min_size=12).collect()}
    for i, g, y, b, v, _ in rows:
        pools = [[r for r in rows if r[5] and r[1] == g and r[2] == y and r[3] == b], [r for r in rows if r[5] and r[1] == g and abs(r[2] - y) <= 1 and r[3] == b], [r for r in rows if r[5] and r[1] == g and r[2] == y], [r for r in rows if r[5] and r[1] == g]]
        want = None
        for level, pool in enumerate(pools, 1):
            if len(pool) >= 12:
                s = sorted(r[4] for r in pool)
                lo, hi = bisect_left(s, v), bisect_right(s, v)
                want = (level, len(s), 100.0 * (lo + 0.5 * (hi - lo)) / len(s))
                break
        assert got.get(i) == want


def test_sequences_against_loops(spark):
    rng = random.Random(9)
    rows = []
    for m in range(20):
        t = 0.0
        for i in range(60):
            t += rng.choice([-1.0, 0.0, 1.0, 3.0])
            rows.append((m, i, 1 + i // 40, t, rng.randint(0, 1), rng.randint(0, 3), rng.randint(0, 1), rng.random() < 0.3, 1 if rng.random() < 0.9 else None, rng.random() < 0.1, rng.random() < 0.5, rng.random() < 0.5))
    names = "match_id int, idx int, period int, t double, team int, possession int, possession_team int, is_pressure boolean, player int, is_shot boolean, qualifies boolean, is_goal boolean"
    df = spark.createDataFrame(rows, names)
    won, acts = set(), set()
    for m in range(20):
        e = [r for r in rows if r[0] == m]
        for i, r in enumerate(e):
            if r[7]:
                for n in e[i + 1 :]:
                    if n[2] != r[2] or n[3] - r[3] > 5:
                        break
                    if n[6] == r[4] and n[5] != r[5]:
                        won.add((m, r[1]))
                        break
            if r[9]:
                found = 0
                for p in reversed(e[:i]):
                    if p[5] != r[5]:
                        break
                    if p[4] == r[4] and p[8] and p[10]:
                        acts.add((m, r[1], p[1]))
                        found += 1
                        if found == 2:
                            break
    assert {(r["match_id"], r["idx"]) for r in sequence.pressure_success(df).collect()} == won
    assert {(r["match_id"], r["shot_idx"], r["idx"]) for r in sequence.creating_actions(df).collect()} == acts


def event(i, kind, player=1, **more):
    return {"id": f"e{i}", "index": i, "period": 1, "timestamp": f"00:00:{i:02d}.000", "type": {"name": kind}, "possession": 1, "possession_team": {"id": 9}, "team": {"id": 9}, "player": {"id": player}, "match_id": 3} | more


def test_match_metrics(spark, tmp_path):
    events = [
        event(1, "Pass", location=[60.0, 40.0], **{"pass": {"end_location": [104.0, 40.0], "length": 44.0, "goal_assist": True, "assisted_shot_id": "e2"}}),
        event(2, "Shot", player=2, location=[105.0, 40.0], shot={"statsbomb_xg": 0.5, "outcome": {"name": "Goal"}, "type": {"name": "Open Play"}}),
        event(3, "Duel", player=4, duel={"type": {"name": "Tackle"}, "outcome": {"name": "Won"}}),
        event(4, "50/50", player=4, **{"50_50": {"outcome": {"name": "Won"}}}),
        event(5, "Shot", player=2, period=5, shot={"statsbomb_xg": 0.7, "outcome": {"name": "Goal"}}),
    ]
    (tmp_path / "3.json").write_text(json.dumps(events))
    df = readers.read_events(spark, str(tmp_path / "3.json"))
    got = {(r["player_id"], r["code"]): r["value"] for r in match_metrics(df).collect()}
    assert {k: got[1, k] for k in ("passes", "passes_completed", "long_passes", "key_passes", "assists", "xa", "progressive_passes", "passes_into_box", "passes_final_third", "sca", "gca")} == {"passes": 1, "passes_completed": 1, "long_passes": 1, "key_passes": 1, "assists": 1, "xa": 0.5, "progressive_passes": 1, "passes_into_box": 1, "passes_final_third": 1, "sca": 1, "gca": 1}
    assert got[2, "np_goals"] == 1 and got[2, "xg"] == 0.5 and (2, "penalties_taken") not in got
    assert got[4, "ground_duels"] == 2 and got[4, "ground_duels_won"] == 2 and got[4, "defensive_actions"] == 1
    assert (4, "fifty_fifties") not in got
    assert "goalkeeper" in EVENT_SCHEMA


def test_two_clock_minutes(spark):
    e = spark.createDataFrame([(1, 1, "Half End", 47 * 60 + 3.0), (1, 2, "Half End", 50 * 60 + 2.0)], "match_id int, period int, type string, t double")
    s = spark.createDataFrame([(1, 7, 3, 0.0, None, 1, None, "Starting XI"), (1, 8, 3, 0.0, 89.25, 1, 2, "Starting XI"), (1, 9, 3, 89.25, None, 2, None, "Sub"), (1, 10, None, None, None, None, None, None)], "match_id int, player_id int, position_id int, from_min double, to_min double, from_period int, to_period int, start_reason string")
    got = {r["player_id"]: r for r in sequence.appearances(s, sequence.period_durations(e)).collect()}
    assert (got[7]["minutes_nominal"], got[7]["minutes_elapsed"], got[7]["started"]) == (90.0, 97.08, True)
    assert got[8]["minutes_nominal"] == 89.25 and got[9]["minutes_nominal"] == 0.75
    assert got[10]["minutes_nominal"] == 0 and got[10]["minutes_by_position"] == {}


def test_appearances_keep_tasks_small(spark, monkeypatch):
    """A task has a set number of segments at most, whatever their bytes; results stay the same."""
    ends = spark.range(300).selectExpr("id as match_id", "explode(array(1, 2, 7)) as period", "'Half End' as type", "2700.0 + id % 50 as t")
    more = spark.createDataFrame([(900, None, "Pass", 3.0), (901, 3, "Half End", 600.0), (901, 1, "Pass", 5.0)], "match_id long, period int, type string, t double")
    durations = sequence.period_durations(ends.unionByName(more))
    got = {(r["match_id"], r["period"]): (r["start"], r["length"], r["duration"], r["offset"]) for r in durations.filter("match_id >= 299").collect()}
    last = (2700 + 299 % 50) / 60
    assert got == {(299, 1): (0.0, 45.0, last, 0.0), (299, 2): (45.0, 45.0, last, last), (900, 1): (0.0, 45.0, 45.0, 0.0), (900, 2): (45.0, 45.0, 45.0, 45.0), (901, 1): (0.0, 45.0, 45.0, 0.0), (901, 3): (90.0, 15.0, 10.0, 45.0)}
    segments = durations.selectExpr("match_id", "match_id % 7 as player_id", "2 as position_id", "10.0 as from_min", "80.0 as to_min", "1 as from_period", "2 as to_period", "'Starting XI' as start_reason").distinct()
    whole = sequence.appearances(segments, durations)
    want = sorted(map(str, whole.collect()))
    monkeypatch.setattr(sequence, "SEGMENTS_A_TASK", 20)
    small = sequence.appearances(segments, durations)
    assert sorted(map(str, small.collect())) == want and len(want) == 302
    assert small.rdd.getNumPartitions() == 16  # 302 segments, 20 a task


def test_compatibility(spark):
    def best(t1, t2, c1, c2):
        x = similarity.best_compatibility(*[F.lit(v).cast("string") for v in (t1, t2, c1, c2)])
        return tuple(spark.range(1).select(x.alias("r")).first()["r"])

    assert best("LW", None, "RW", None) == (0.9, "LW-RW")
    assert best("GK", None, "CB", None) == (0.0, "GK-CB")
    assert best("RW", "ST", "ST", None) == (0.9, "ST-ST")
    assert len(C.features()) == 46 and len(C.features(C.GK_FEATURES)) == 12


def test_find_similar(spark):
    z = {c: 0.1 for _, c, _ in C.features()}
    rows = [(i, [float(i)] * 64, {k: v + i / 10 for k, v in z.items()}, "CM", None, 900.0) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, z map<string,double>, primary string, secondary string, minutes double")
    got = [r["candidate"] for r in similarity.find_similar(df, 2, group="CM", limit=2).collect()]
    assert sorted(got) == [1, 3]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 8)], "k int, x string, y int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], ["x"], F.col("y")).collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 8)]
    assert [r["k"] for r in sinks.new_rows(old, new, ["k"]).collect()] == [3]
    path = str(tmp_path / "t")
    sinks.replace_partitions(old, path, ["k"])
    sinks.replace_partitions(new, path, ["k"])
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == ["a", "c", "d"]


def test_rates(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Date,USD,GBP,\n2024-01-02,1.1,N/A,\n2024-01-01,1.2,0.9,\n")
    r = readers.read_rates(spark, str(tmp_path / "r.csv"))
    assert r.count() == 3
    assert readers.validate_rates(r, "2024-01-05") is r


def test_upsert_stream(spark, tmp_path):
    from peerlens.streaming.events import latest_rows, stream_table, upsert_stream

    src = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1)], "k int, v int, t int")
    rows.write.parquet(src)
    out = str(tmp_path / "out")
    run = lambda: upsert_stream(stream_table(spark, src, rows), out, ["k"], ["v", "t"], "t", str(tmp_path / "cp")).awaitTermination()
    run()
    assert sorted(map(tuple, latest_rows(spark, out, rows).collect())) == [(1, 6, 2), (2, 7, 1)]
    spark.createDataFrame([(1, 9, 3), (4, 8, 1)], rows.schema).write.mode("append").parquet(src)
    run()
    assert sorted(map(tuple, latest_rows(spark, out, rows).collect())) == [(1, 9, 3), (2, 7, 1), (4, 8, 1)]
    versions = {(r["upsert_bucket"], r["upsert_version"]) for r in spark.read.parquet(out).select("upsert_bucket", "upsert_version").distinct().collect()}
    of = {r["k"]: r["b"] for r in spark.createDataFrame([(k,) for k in (1, 2, 4)], "k int").selectExpr("k", "cast(pmod(xxhash64(k), 64) as int) as b").collect()}
    assert versions == {(of[1], 0), (of[2], 0), (of[1], 1), (of[4], 1)}  # the second batch left key 2's bucket alone
    assert latest_rows(spark, str(tmp_path / "none"), rows).isEmpty()


def test_strict_match(spark):
    schema = "id long, names array<string>, nationality string, born int"
    left = spark.createDataFrame([(1, ["ann lee", "a lee"], "x", 1), (2, ["bo"], None, None), (3, ["cy"], "x", 2), (4, None, "x", 1), (5, [""], "x", 1)], schema)
    right = spark.createDataFrame([(11, ["ann lee", "a lee"], "x", None), (12, ["a lee"], "y", 1), (21, ["bo"], "x", 1), (22, ["bo"], "y", 2), (31, ["cy"], "x", 3), (51, [""], "x", 1)], schema)
    got = {r["left_id"]: (r["right_id"], r["decision"], r["score"], r["n_matches"]) for r in identity.strict_match(left, right).collect()}
    assert got == {1: (11, "linked", 0.95, 1), 2: (None, "ambiguous", None, 2), 3: (None, "none", None, 0), 4: (None, "none", None, 0), 5: (None, "none", None, 0)}
    assert identity.strict_match(left, right.limit(0)).filter("decision <> 'none'").count() == 0


def test_initials_clubs_and_review(spark):
    short = spark.createDataFrame([(1, "K. Del Río"), (2, "K. Rio"), (3, "Kim Rio"), (4, None)], "id long, name string")
    people = spark.createDataFrame([(11, "Kim del Rio"), (12, "Ken Rio"), (13, "Rio"), (14, "Tom del Rio"), (15, None)], "id long, name string")
    found = identity.initial_matches(short, people)
    assert {(r[0], r[1]) for r in found.collect()} == {(1, 11), (2, 11), (2, 12)}
    mine = spark.createDataFrame([(1, "a"), (2, "b"), (2, None)], "left_id long, club string")
    theirs = spark.createDataFrame([(11, "a"), (12, "b"), (11, None)], "right_id long, club string")
    assert {(r[0], r[1]) for r in identity.sharing_club(found, mine, theirs).collect()} == {(1, 11), (2, 12)}
    queue = spark.createDataFrame([(1, 11, 0.8, True), (2, 12, 0.8, True), (3, 13, 0.8, None), (4, 14, 0.8, False), (5, 15, 0.8, True)], "left_id long, right_id long, score double, approve boolean")
    links = spark.createDataFrame([(1, 11), (2, 99), (98, 15)], "left_id long, right_id long")
    assert {r["left_id"]: r["status"] for r in identity.review(queue, links).collect()} == {1: "approved", 2: "conflict", 3: "pending", 4: "rejected", 5: "conflict"}


def test_searches_of_all_targets(spark, tmp_path):
    rng = random.Random(3)
    vectors = {i: [rng.choice([-2.0, -1.3, -0.5, 0.0, 0.25, 0.5, 1.25]) if j % 5 else rng.gauss(0, 0.6) for j in range(24)] for i in range(420)}
    vectors[350] = vectors[3] = vectors[100]
    df = spark.createDataFrame([*vectors.items(), (None, vectors[3]), (950, None)], "vec_id long, embedding array<double>")
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    targets = [i for i in vectors if i % 50 == 0]
    kinds = ["attacking"] * 6 + ["passing"] * 6 + ["possession"] * 6 + ["defending"] * 6
    near, scores, supports = set(), {}, set()
    for t in targets:
        a = vectors[t]
        for d, c in sorted((math.dist(a, b), c) for c, b in vectors.items() if c != t)[:300]:
            near.add((t, c, round(d, 9)))
        for c, b in vectors.items():
            both = [(j, 1.0 + (j + 1) % 3, abs(round(x, 3) - round(y, 3))) for j, (x, y) in enumerate(zip(a, b)) if abs(x) < 1.2 and abs(y) < 1.5]
            if c == t:
                continue
            for r, (_, j) in enumerate(sorted((w * d, j) for j, w, d in both if d < 0.5)[:6], 1):
                supports.add((t, c, r, j + 1))
            if sum(w for _, w, _ in both) / 48 >= 0.6:
                top = bottom = 0.0
                for kind in set(kinds):
                    of = [(w, d) for j, w, d in both if kinds[j] == kind]
                    if of:
                        share = C.CATEGORY_WEIGHTS["CM"][kind]
                        top += share * 100 * math.exp(-math.sqrt(sum(w * d * d for w, d in of) / sum(w for w, _ in of)) / 1.35)
                        bottom += share
                scores[t, c] = (top / bottom, sum(w for _, w, _ in both) / 48)
    d = str(tmp_path)
    assert {(r["target"], r["candidate"], round(r["distance"], 9)) for r in plans.vector_knn_all(spark, d).collect()} == near
    got = {(r["target"], r["candidate"]): (r["similarity"], r["usable"]) for r in plans.category_similarity_all(spark, d).collect()}
    assert got.keys() == scores.keys() and scores and all(abs(x - y) < 2e-6 for k in got for x, y in zip(got[k], scores[k]))
    assert {(r["target"], r["candidate"], r["r"], r["code"]) for r in plans.similarity_supporting_all(spark, d).collect()} == supports
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    blocks = similarity.nearest_all(e, e.filter("vec_id % 50 = 0"), key="vec_id", vector="embedding", block=4)
    assert {(r["target"], r["candidate"], round(r["distance"], 9)) for r in blocks.collect()} == near


def test_supporting_features_leave_a_task_as_one_row_a_pair(spark, monkeypatch):
    """Python gives Spark a row per pair, not one per feature; equal distances keep their order, missing values stay out."""
    nan = float("nan")
    vectors = {0: [0.0, 0.1, 0.2, nan, 0.4, 0.0, 0.0, 0.0], 1: [0.1, 0.2, 0.1, 0.3, nan, 0.0, 0.9, 0.1], 2: [nan] * 8, 3: [0.4, 0.1, 0.2, 0.3, 0.4, 0.1, 0.2, 0.3]}
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<double>").repartition(2)
    made, by_blocks = [], similarity.by_blocks
    monkeypatch.setattr(similarity, "by_blocks", lambda *a, **k: made.append(by_blocks(*a, **k)) or made[-1])
    weights = [1.0, 2.0, 1.0, 2.0, 1.0, 2.0, 1.0, 2.0]
    got = {(r["target"], r["candidate"], r["r"], r["code"]) for r in similarity.vector_supporting_all(df, df, weights, key="id", vector="v").collect()}
    want = set()
    for t, a in vectors.items():
        for c, b in vectors.items():
            near = sorted((w * abs(y - x), i) for i, (x, y, w) in enumerate(zip(a, b, weights), 1) if abs(y - x) < 0.5)
            want |= {(t, c, r, i) for r, (_, i) in enumerate(near[:6], 1) if t != c}
    assert got == want and len(got) > 6
    assert made[0].count() == len({(t, c) for t, c, *_ in want})
    with pytest.raises(Exception, match="vectors of different lengths"):
        similarity.vector_supporting_all(df.unionAll(spark.createDataFrame([(9, [0.0] * 4)], df.schema)).coalesce(1), df, weights, key="id", vector="v").collect()


def test_candidates_of_scores_take_few_bytes(spark, tmp_path):
    """A written result has the similarities' own bytes and next to none for the ids beside; all pairs are there."""
    import numpy as np
    import pyarrow.parquet as pq

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(3205)], "id long, v array<double>").coalesce(1)
    out = similarity.vector_similarity_all(df, df.filter("id % 50 = 0"), "CM", ["attacking", "passing"] * 4, [1.0] * 8, key="id", vector="v")
    out.write.parquet(str(tmp_path / "out"))
    parts = [pq.read_metadata(f).row_group(0) for f in (tmp_path / "out").glob("*.parquet")]
    columns = {c.path_in_schema: c.total_compressed_size for c in map(parts[0].column, range(4))}
    assert len(parts) == 1 and parts[0].num_rows == 65 * 3204
    assert columns["target"] + columns["candidate"] + columns["usable"] < 0.4 * parts[0].num_rows
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.select("target", "candidate").distinct().count() == 65 * 3204 and found.filter("target = candidate").isEmpty()


def test_expanding_median_of_all_orders(spark):
    rng = random.Random(4)
    rows = [(i, 2000 + rng.randint(0, 1), rng.randint(0, 30), float(rng.choice([5, 5, 7, rng.randint(0, 99)])) if rng.random() < 0.9 else None) for i in range(400)]
    df = spark.createDataFrame([*rows, (400, None, 3, 9.0), (401, 2000, None, 9.0)], "id long, y int, t int, v double")
    for bins in (2, 5, 256):
        got = {r["id"]: (r["median_before"], r["n_before"]) for r in temporal.expanding_median(df, time="t", year="y", value="v", at=df, at_time="t", at_year="y", minimum=3, bins=bins).collect()}
        want = {400: (None, None), 401: (None, None)}
        for i, y, t, _ in rows:
            before = [v for _, b, s, v in rows if b == y and s < t and v is not None and v >= 3]
            want[i] = (statistics.median(before), len(before)) if before else (None, None)
        assert got == want
    assert plans.expanding_median_all(spark, "/root/testdata/sf0.001").count() == 1500


def test_nearest_within(spark):
    """Only rows that agree in the given columns are compared, nulls being equal; groups may differ in their vectors' length."""
    rows = [(i, g, s, [float(i % 7 + j) for j in range(3 if g == "GK" else 2)]) for i, (g, s) in enumerate([("GK", "f"), ("CM", "m"), ("CM", None)] * 12)]
    df = spark.createDataFrame(rows, "id long, g string, s string, vector array<double>").repartition(3)
    targets = df.filter("id < 5 or id = 35")
    got = {(r["target"], r["candidate"]) for r in similarity.nearest_all(df, targets, key="id", within=("g", "s"), k=4, block=2).collect()}
    want = set()
    for i, g, s, v in rows:
        if i < 5 or i == 35:
            near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) ** 0.5, j) for j, h, t, w in rows if (h, t) == (g, s) and j != i)
            want |= {(i, j) for _, j in near[:4]}
    assert got == want


def test_large_pools_and_keys_give_the_same(spark):
    """Parts of values and of time decide how work is split, not what comes out."""
    rng = random.Random(8)
    rows = [(i, "ab"[i % 2], 2000 + rng.randrange(4), "x", float(rng.randrange(60)), rng.random() < 0.8) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, y int, b string, v double, is_member boolean")
    how = dict(group=["g"], year="y", band="b", value="v", ids=["id"], lower_better=F.col("id") % 3 == 0)
    few, many = (sorted(percentiles.pool_percentiles(df, large=n, **how).collect()) for n in (3, 10**6))
    assert few == many and len(few) == 500
    left = spark.createDataFrame([(i, rng.randrange(3), rng.randrange(100)) for i in range(300)], "id long, k int, t int")
    right = spark.createDataFrame([(rng.randrange(3), rng.randrange(100), float(i)) for i in range(60)], "k int, t int, v double")
    how = dict(on=["k"], left_time="t", right_time="t", values=["v"], bucket=lambda t: F.floor(t / 7))
    few, many = (sorted(temporal.asof_join(left, right, large=n, **how).collect()) for n in (0, 10**6))
    assert few == many and any(r["v"] is not None for r in few)
    seen = right.collect()
    for r in few:
        before = [(x["t"], x["v"]) for x in seen if x["k"] == r["k"] and x["t"] <= r["t"]]
        assert r["v"] == (max(before)[1] if before else None)


def test_stored_results(spark, tmp_path):
    """A second request reads; another configuration, another request or age makes it anew; empty results are stored too."""
    import datetime as dt

    from peerlens.operators import similar_players

    built, now = [], dt.datetime(2024, 1, 1)

    def ask(config, request, at=now, rows=3):
        def build():
            built.append((str(config), str(request)))
            return spark.range(rows)

        return similar_players.stored_result(spark, str(tmp_path / "s"), config=config, request=request, build=build, now=at).count()

    assert [ask({"a": 1}, {"p": 5}), ask({"a": 1}, {"p": 5}), len(built)] == [3, 3, 1]
    assert [ask({"a": 2}, {"p": 5}, rows=0), ask({"a": 2}, {"p": 5}, rows=9), len(built)] == [0, 0, 2]
    assert [ask({"a": 1}, {"p": 6}), len(built)] == [3, 3]
    assert [ask({"a": 1}, {"p": 5}, at=now + dt.timedelta(hours=5)), len(built), ask({"a": 1}, {"p": 5}, at=now + dt.timedelta(hours=7), rows=4), len(built)] == [3, 3, 4, 4]


def test_trailing_rounds_seconds_and_sets_rows_without_key_apart(spark):
    """Times are whole seconds by rounding, as the SQL casts them; rows without key or time see no others."""
    rows = spark.createDataFrame([(1, "a", 0.6), (2, "a", 1.4), (3, "a", 2.0), (4, None, 5.0), (5, None, 9.0), (6, "a", None), (7, "a", None)], "id int, k string, t double")
    got = temporal.trailing(rows, key="k", time=F.col("t"), days=7, aggregates={"n": F.count("*"), "s": F.sum("id")})
    assert got.columns == ["id", "k", "t", "n", "s"]
    assert {r["id"]: (r["n"], r["s"]) for r in got.collect()} == {1: (0, None), 2: (0, None), 3: (2, 3), 4: (0, None), 5: (0, None), 6: (0, None), 7: (0, None)}
