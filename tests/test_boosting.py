"""Boosting against a plain NumPy grower, coverage on held-out rows, attributions against all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens.operators import boosting


def plain_boosting(x, y, q, s):
    """The same trees by direct loops over rows. x: row by feature with NaN; q: a quantile or None."""
    order = lambda v, p: np.sort(v)[max(0, math.ceil(p * len(v)) - 1)]
    edges = [np.unique(f[~np.isnan(f)]) for f in x.T]
    base = y.mean() if q is None else order(y, q)
    pred, trees = np.full(len(y), base), []

    def grow(rows, r, g, depth):
        best = None
        if depth:
            for f, cuts in enumerate(edges):
                v = x[rows, f]
                lost = np.isnan(v)
                for cut in np.intersect1d(cuts, v):  # a cut is made at bins that have rows
                    for missing_left in (False, True) if lost.any() else (False,):
                        left = np.where(lost, missing_left, v <= cut)
                        a, b = left.sum(), (~left).sum()
                        if min(a, b) < s.least_leaf:
                            continue
                        ga, gb = g[rows][left].sum(), g[rows][~left].sum()
                        gain = round(ga * ga / a + gb * gb / b - (ga + gb) ** 2 / (a + b), 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, f, cut, missing_left if lost.any() else a >= b, left)
        if best is None:
            value = (g[rows].mean() if q is None else order(r[rows], q)) * s.rate
            pred[rows] += value
            return ("leaf", round(value, 8))
        _, f, cut, missing_left, left = best
        return (f, round(cut, 8), bool(missing_left), grow(rows[left], r, g, depth - 1), grow(rows[~left], r, g, depth - 1))

    for _ in range(s.iterations):
        r = y - pred
        g = r if q is None else np.where(r > 0, q, q - 1)
        trees.append(grow(np.arange(len(y)), r.copy(), g, s.depth))
    return base, trees, pred


def nested(t, node=0):
    if t.feature[node] < 0:
        return ("leaf", round(t.value[node], 8))
    return (t.feature[node], round(t.threshold[node], 8), bool(t.missing_left[node]), nested(t, t.left[node]), nested(t, t.right[node]))


def table(spark, x, y, names):
    rows = [(*[None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "y"])).repartition(3)


def sample(n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[rng.random((n, 3)) < 0.15] = np.nan
    noise = rng.normal(size=n)
    y = np.nan_to_num(x[:, 0], nan=2.0) * 2 + np.abs(np.nan_to_num(x[:, 1])) + noise * (1 + (np.nan_to_num(x[:, 2]) > 0))
    return x, y


def test_equals_plain_grower(spark):
    x, y = sample(400, 1)
    s = boosting.Settings(iterations=3, depth=3, rate=0.5, least_leaf=15)
    got = boosting.fit(table(spark, x, y, "abc"), list("abc"), "y", {"mean": None, "low": 0.1, "high": 0.9}, s)
    for name, q in (("mean", None), ("low", 0.1), ("high", 0.9)):
        base, trees, pred = plain_boosting(x, y, q, s)
        forest = got[name]
        assert abs(forest.base - base) < 1e-9 and [nested(t) for t in forest.trees] == trees
        assert np.allclose(forest.predict(x.T), pred)
        assert all(t.cover[0] == 400 and all(t.cover[i] == t.cover[t.left[i]] + t.cover[t.right[i]] for i, f in enumerate(t.feature) if f >= 0) for t in forest.trees)


def test_keeping_predictions_changes_nothing(spark, monkeypatch):
    x, y = sample(300, 2)
    s = boosting.Settings(iterations=4, depth=2, rate=0.3, least_leaf=10)
    df = table(spark, x, y, "abc")
    one = boosting.fit(df, list("abc"), "y", {"m": None}, s)["m"]
    monkeypatch.setattr(boosting, "KEEP", 1)
    two = boosting.fit(df, list("abc"), "y", {"m": None}, s)["m"]
    assert [nested(t) for t in one.trees] == [nested(t) for t in two.trees]


def test_edges_of_the_input(spark):
    df = spark.createDataFrame([(None, 1.0, None), (float("nan"), 2.0, 1.0), (None, None, 3.0)], "a double, b double, y double")
    forest = boosting.fit(df, ["a", "b"], "y", {"m": None}, boosting.Settings(iterations=1, least_leaf=1))["m"]
    got = [r["p"] for r in df.select(forest.column().alias("p")).collect()]
    assert len(got) == 3 and all(math.isfinite(p) for p in got)
    for bad, features in ((df.filter("y is null"), ["a"]), (df, [])):
        with pytest.raises(ValueError):
            boosting.fit(bad, features, "y", {"m": None})


def exhaustive(forest, row):
    """Shapley values of the path-dependent game: unknown features split a row by the covers."""
    n = len(forest.features)

    def value(tree, known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        a, b = tree.left[node], tree.right[node]
        if f in known:
            left = tree.missing_left[node] if np.isnan(row[f]) else row[f] <= tree.threshold[node]
            return value(tree, known, a if left else b)
        return (tree.cover[a] * value(tree, known, a) + tree.cover[b] * value(tree, known, b)) / tree.cover[node]

    game = lambda known: sum(value(t, known) for t in forest.trees)
    out = []
    for f in range(n):
        rest = [g for g in range(n) if g != f]
        out.append(sum(math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) * (game({*c, f}) - game(set(c))) for k in range(n) for c in itertools.combinations(rest, k)))
    return np.array(out), forest.base + game(set())


def test_attributions_equal_all_subsets(spark):
    x, y = sample(300, 3)
    x = np.c_[x, np.random.default_rng(4).integers(0, 3, 300).astype(float)]
    names = ["a", "b", "c", "d"]
    forest = boosting.fit(table(spark, x, y, names), names, "y", {"m": None}, boosting.Settings(iterations=4, depth=4, rate=0.4, least_leaf=5))["m"]
    phi, mean = boosting.attributions(forest, x.T)
    assert np.allclose(phi.sum(axis=0), forest.predict(x.T) - mean)
    for r in range(0, 300, 20):
        want, base = exhaustive(forest, x[r])
        assert np.allclose(phi[:, r], want) and abs(base - mean) < 1e-9
    got = table(spark, x, y, names).select(*names, boosting.explanation(forest, 2).alias("f")).collect()
    for r in got[:40]:
        want, _ = exhaustive(forest, np.array([np.nan if r[n] is None else r[n] for n in names]))
        first = np.argsort(-np.abs(want), kind="stable")[:2]
        assert [(f["feature"], f["contribution"]) for f in r["f"]] == [(names[i], round(float(want[i]), 4)) for i in first]
