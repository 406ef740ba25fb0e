"""Runs, intervals and the artifact of the value model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens.operators import value_model, value_runs
from peerlens.operators.boosting import Forest, Settings
from peerlens.plans import value_queries

NAMES = ["a", "b"]
SMALL = Settings(iterations=4, depth=2, rate=0.4, least_leaf=10)


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        a, b = rng.normal(), None if rng.random() < 0.1 else float(rng.integers(0, 5))
        y = 10 + 2 * (a > 0) + 0.5 * (b or 0) + rng.normal() * (0.3 + 0.5 * (a > 0))
        rows.append((i, float(a), b, float(y), ("train", "validate", "test")[min(2, i // 400)], ("X", "Y", None)[i % 3], 6000 + i * 5 if i % 7 else None, 900.0, 0.9))
    return spark.createDataFrame(rows, "id long, a double, b double, label double, part string, position_group string, age_days int, minutes double, feature_completeness double")


@pytest.mark.parametrize("kinds", [("ridge", "hist_boosting"), ("ridge",)])
def test_best_run_is_saved_and_scores_the_same(spark, examples, tmp_path, kinds):
    runs, best = value_runs.train_runs(examples, NAMES, "label", folder=str(tmp_path), kinds=kinds, settings=SMALL, bands=("position_group",))
    assert [r["algorithm"] for r in runs] == ["baseline_median", *kinds] and [r["run_id"] for r in runs] == list(range(1, len(kinds) + 2))
    errors = {r["algorithm"]: r["metrics"]["validate"]["mae_log"] for r in runs[1:]}
    assert best.algorithm == min(errors, key=errors.get) and [r["algorithm"] for r in runs if r["artifact"]] == [best.algorithm]
    assert isinstance(best.model, Forest) == (best.algorithm == "hist_boosting")
    own = next(r for r in runs if r["artifact"])
    assert own["metrics"]["test"]["interval_coverage"] >= 0.75 and own["metrics"]["test"]["interval_median_width"] > 0
    assert set(own["metrics"]["test"]["by_position_group"]) <= {"X", "Y", None} and errors[best.algorithm] < runs[0]["metrics"]["validate"]["mae_log"]
    loaded = value_runs.load(spark, own["artifact"])
    new = examples.filter("part = 'test'").unionByName(spark.createDataFrame([(-1, None, None, None, "test", None, None, 0.0, 0.0)], examples.schema))
    first, second = ({r["id"]: r for r in value_runs.score(new, x).collect()} for x in (best, loaded))
    assert first.keys() == second.keys() and len(first) == new.count()
    for i, r in first.items():
        s = second[i]
        assert (r["value"], r["low_value"], r["high_value"], r["n_comparables"], r["confidence"]) == (s["value"], s["low_value"], s["high_value"], s["n_comparables"], s["confidence"])
        assert [(f["feature"], f["contribution"]) for f in r["factors"]] == [(f["feature"], f["contribution"]) for f in s["factors"]]
        assert abs(r["value"] - math.expm1(r["predicted"])) < 0.006
    assert first[-1]["n_comparables"] == 0 and first[-1]["confidence"]["tier"] == "low"
    assert value_runs.score(new.limit(0), loaded).count() == 0


def test_conformal_width_is_that_of_numpy(spark):
    rng = np.random.default_rng(1)
    y, lo, hi = rng.normal(size=137), np.full(137, -0.5), np.full(137, 0.5)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(y, lo, hi, strict=True)], "y double, l double, h double").repartition(3)
    scores = np.maximum(lo - y, y - hi)
    want = np.quantile(scores, min(1.0, math.ceil(138 * 0.8) / 137))
    assert abs(value_runs.conformal_width(df, "y", "l", "h") - want) < 1e-12
    for share in (0.0, 0.3, 0.5, 1.0):
        assert abs(value_runs.interpolated_quantile(df, "y", share) - np.quantile(y, share)) < 1e-12
    with pytest.raises(ValueError):
        value_runs.conformal_width(df.limit(0), "y", "l", "h")


def test_quantiles_of_large_keys_are_exact(spark, monkeypatch):
    """Keys of many rows have F.percentile's quantiles, though only values near the ranks come together; so have metrics."""
    rng = np.random.default_rng(8)
    values = {"a": rng.normal(size=3001), "b": np.r_[np.full(900, 2.5), rng.normal(size=400)], None: np.array([1.0, 4.0]), "n": np.array([np.nan, 1.0, np.nan]), "i": np.array([np.inf, -np.inf, 3.0, 7.0])}
    rows = [(k, float(v), float(rng.normal())) for k, x in values.items() for v in x] + [("none", None, 1.0), ("a", None, None)]
    df = spark.createDataFrame(rows, "k string, v double, p double").repartition(3).cache()
    plain = {s: {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", F.lit(s)).alias("q")).filter("k is null or k <> 'none'").collect()} for s in (0.0, 0.37, 0.5, 0.8, 1.0)}
    whole = df.agg(F.percentile("v", F.lit(0.37)).alias("q")).first()["q"]
    finite = df.filter("k in ('a', 'b')")
    metrics = value_model.regression_metrics(finite, ["k"], "v", "p").orderBy("k").collect()
    width = value_model.conformal(finite.selectExpr("*", "'validate' as part", "p as predicted"), "v").agg(F.max("high")).first()
    monkeypatch.setattr(value_model, "LARGE", 4)
    taken, between = [], value_model._between
    monkeypatch.setattr(value_model, "_between", lambda *a: taken.append(a) or between(*a))
    for accuracy in (1000, 100):
        monkeypatch.setattr(value_model, "ACCURACY", accuracy)
        for share, want in plain.items():
            assert repr(sorted((str(r["k"]), r["quantile"]) for r in value_model.quantile(df, ["k"], "v", share).collect())) == repr(sorted((str(k), v) for k, v in want.items()))
        assert value_model.quantile(df, [], "v", 0.37).collect() == [(whole,)]
    assert len(taken) == 12 and value_model.quantile(df.filter("v > 1e9 and v < 1e10"), ["k"], "v").collect() == []
    x, bounds, *_ = taken[-1]
    assert x.join(bounds).filter("__v between lo and hi").count() < 0.1 * x.count()
    assert [r.asDict() for r in value_model.regression_metrics(finite, ["k"], "v", "p").orderBy("k").collect()] == [pytest.approx(r.asDict()) for r in metrics]
    assert value_model.conformal(finite.selectExpr("*", "'validate' as part", "p as predicted"), "v").agg(F.max("high")).first() == width
    monkeypatch.setattr(value_model, "_between", lambda x, b, n, s: between(x, b.withColumn("hi", F.col("lo")), n, s) if "c" not in seen and not seen.append("c") else between(x, b, n, s))
    seen = []
    assert {r["k"]: r["quantile"] for r in value_model.quantile(finite, ["k"], "v").collect()} == {k: plain[0.5][k] for k in "ab"}


def test_too_few_rows(examples):
    with pytest.raises(ValueError, match="validate"):
        value_runs.train_runs(examples.filter("part <> 'validate'"), NAMES, "label", settings=SMALL)


def test_ridge_is_the_closed_form(spark, examples):
    """The pipeline's ridge against normal equations on standardised features: the check of value_models' linear part."""
    train = examples.filter("part = 'train'")
    model = value_model.pipeline("ridge", NAMES, "label").fit(train)
    rows = train.select(*NAMES, "label").toPandas()
    x = rows[NAMES].fillna(rows[NAMES].median()).to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    y = rows["label"].to_numpy()
    # Spark's loss is the mean squared error over 2 plus lambda / 2 of the squared coefficients of features of deviation 1.
    w = np.linalg.solve(z.T @ z / len(y) + np.eye(2) * 1.0 / y.std(ddof=1) * y.std(ddof=1), z.T @ (y - y.mean()) / len(y))
    got = np.array([r["predicted"] for r in model.transform(train).select("predicted").collect()])
    assert np.corrcoef(got, z @ w)[0, 1] > 0.9999


def test_value_models_beat_the_median(examples):
    """Every kind of value_models predicts held-out rows better than the overall median does."""
    median = examples.filter("part = 'train'").agg(F.median("label").alias("m")).first()["m"]
    for name, p in value_model.fit_models(examples, NAMES, "label").items():
        r = p.filter("part = 'test'").agg(F.avg(F.abs(F.col("label") - F.col("predicted"))).alias("e"), F.avg(F.abs(F.col("label") - F.lit(median))).alias("b")).first()
        assert r["e"] < 0.9 * r["b"], name
        assert {"raw", "x"}.isdisjoint(p.columns) and p.count() == 900


def test_features_are_prepared_once(examples, monkeypatch):
    """All models of value_models train on features prepared once, and predict what each does in a pipeline of its own."""
    fitted, imputer = [], value_model.Imputer
    monkeypatch.setattr(value_model, "Imputer", lambda **k: fitted.append(k) or imputer(**k))
    found = value_model.fit_models(examples, NAMES, "label")
    assert len(fitted) == 1
    train = examples.filter("part = 'train'").cache()
    for kind, p in found.items():
        own = value_model.pipeline(kind, NAMES, "label").fit(train).transform(examples)
        got, want = ({r["id"]: r["predicted"] for r in x.select("id", "predicted").collect()} for x in (p, own))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got), kind


def test_examples_are_made_once(spark, monkeypatch):
    """Training reads its examples from where they were written, and doesn't make them for each pass."""
    seen = []

    def stop(examples, minimum):
        seen.extend(examples.inputFiles())
        raise ValueError("seen")

    monkeypatch.setattr(value_runs.value_model, "require_parts", stop)
    with pytest.raises(ValueError, match="seen"):
        value_runs.train_runs(spark.range(5).selectExpr("id", "'train' as part"), ["id"], "id")
    assert seen and all("value-examples" in f for f in seen)


def test_scored_examples_are_not_made_again(spark, monkeypatch):
    """value_scores trains and scores on one written table."""
    seen = []

    def train(examples, *args, **more):
        seen.append(examples.inputFiles())
        return [{"artifact": "none"}], None

    def score(rows, artifact):
        seen.append(rows.inputFiles())
        raise ValueError("seen")

    for name, f in (("train_runs", train), ("load", lambda *_: None), ("score", score)):
        monkeypatch.setattr(value_runs, name, f)
    with pytest.raises(ValueError, match="seen"):
        value_queries.value_scores(spark, "/root/testdata/sf0.001")
    assert sorted(seen[0]) == sorted(seen[1]) and all("value-rows" in f for f in seen[1])
