"""Gradient boosting on feature histograms, for means and for quantiles: trees grow by (node, feature, bin) sums.

Rows stay where they are. A pass over them gives each node's sums by feature and bin, Spark adds these up and picks the
best split of each node by windows over the bins, and only the chosen splits, a row per node, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written

BINS = 255
MISSING = 255
ACCURACY = 10_000
KEEP = 10
SUMS = "model int, node int, feature int, bin int, g double, n long"
LEAVES = "model int, node int, residual double"


@dataclass(frozen=True)
class Settings:
    """iterations trees of at most 2 ** depth leaves with least_leaf rows or more, each weighing rate."""

    iterations: int = 100
    depth: int = 4
    rate: float = 0.1
    least_leaf: int = 20
    bins: int = BINS


@dataclass
class Tree:
    """Nodes as arrays; node 0 is the root. feature is -1 in a leaf. A row goes left if its value is at most the threshold,
    and where it is missing if missing_left. cover is the number of training rows of a node."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, bin_: int, threshold: float, missing_left: bool, covers: tuple[int, int], values: tuple[float, float]) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.bin[node], self.threshold[node], self.missing_left[node] = feature, bin_, threshold, missing_left
        self.left[node], self.right[node] = at, at + 1
        for cover, value in zip(covers, values, strict=True):
            for name, x in (("feature", -1), ("threshold", 0.0), ("bin", 0), ("missing_left", False), ("left", 0), ("right", 0), ("value", value), ("cover", cover)):
                getattr(self, name).append(x)
        return at, at + 1

    def leaf_of(self, columns: np.ndarray, missing: np.ndarray, cuts: list) -> np.ndarray:
        """The leaf of each row. columns: feature by row, bins or values; cuts: the tree's bins or thresholds."""
        node = np.zeros(columns.shape[1], dtype=np.int64)
        feature, cut, default, left, right = (np.array(x) for x in (self.feature, cuts, self.missing_left, self.left, self.right))
        row = np.arange(len(node))
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                return node
            f, at = feature[node[inner]], row[inner]
            goes = np.where(missing[f, at], default[node[inner]], columns[f, at] <= cut[node[inner]])
            node[inner] = np.where(goes, left[node[inner]], right[node[inner]])


@dataclass
class Forest:
    """base plus the values of the leaves that a row comes to, one of each tree. features: names in the trees' order."""

    features: list[str]
    base: float
    trees: list[Tree]

    def predict(self, values: np.ndarray) -> np.ndarray:
        """values: feature by row, not-a-number where missing."""
        missing = np.isnan(values)
        out = np.full(values.shape[1], self.base)
        for t in self.trees:
            out += np.array(t.value)[t.leaf_of(values, missing, t.threshold)]
        return out

    def column(self) -> Column:
        """The prediction for rows with the forest's features as columns. The trees travel with the function."""

        @F.pandas_udf("double")
        def predicted(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(self.predict(rows.to_numpy(dtype=float).T))

        return predicted(self.inputs())

    def inputs(self) -> Column:
        return F.struct(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(self.features)])


def bin_edges(train: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Per feature the upper ends of its bins: quantiles of the known values, all values where there are few."""
    shares = [(i + 1) / bins for i in range(bins)]
    known = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    row = train.agg(*[F.percentile_approx(k, shares, ACCURACY).alias(f"e{i}") for i, k in enumerate(known)]).first()
    return [np.unique(np.array(row[f"e{i}"] if row[f"e{i}"] is not None else [], dtype=float)) for i in range(len(features))]


def binned(train: DataFrame, features: list[str], label: str, edges: list[np.ndarray], starts: list[float]) -> DataFrame:
    """y, bins (a byte per feature, 255 where missing) and the predictions so far, of rows that have a label."""

    @F.pandas_udf("binary")
    def to_bins(rows: pd.DataFrame) -> pd.Series:
        values = rows.to_numpy(dtype=float)
        out = np.empty(values.shape, dtype=np.uint8)
        for i, e in enumerate(edges):
            out[:, i] = np.where(np.isnan(values[:, i]), MISSING, np.minimum(np.searchsorted(e, values[:, i]), max(0, len(e) - 1)))
        return pd.Series([x.tobytes() for x in out])

    inputs = F.struct(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    begun = F.array(*[F.lit(float(s)) for s in starts])
    return written(train.filter(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), to_bins(inputs).alias("bins"), begun.alias("so_far")), "boosting")


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, bins (feature by row) and predictions so far (model by row)."""
    y = batch.column("y").to_numpy(zero_copy_only=False)
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(len(y), -1).T
    return y, bins, batch.column("so_far").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1).T


def _residuals(y: np.ndarray, bins: np.ndarray, so_far: np.ndarray, pending: list[list[Tree]]) -> np.ndarray:
    """What is left of y for each model, after the trees that so_far doesn't have yet."""
    missing, out = bins == MISSING, y - so_far
    for m, trees in enumerate(pending):
        for t in trees:
            out[m] -= np.array(t.value)[t.leaf_of(bins, missing, t.bin)]
    return out


def node_sums(rows: DataFrame, pending: list[list[Tree]], growing: list[Tree], open_nodes: list[list[int]], quantiles: list[float | None]) -> DataFrame:
    """model, node, feature, bin, g, n: sums of negative gradients, and counts, in the open nodes of the growing trees.

    Of a squared error the negative gradient is the residual; of the pinball loss it is the quantile where the residual is
    positive, else the quantile less 1. A task holds 256 sums for each open node and feature.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g_sum: dict[tuple[int, int], np.ndarray] = {}
        n_sum: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            y, bins, so_far = _matrix(batch)
            if not len(y):
                continue
            residuals, missing = _residuals(y, bins, so_far, pending), bins == MISSING
            for m, tree in enumerate(growing):
                r, q = residuals[m], quantiles[m]
                g = r if q is None else np.where(r > 0, q, q - 1)
                leaf = tree.leaf_of(bins, missing, tree.bin)
                for node in open_nodes[m]:
                    inside = leaf == node
                    at = bins[:, inside].astype(np.int64) + 256 * np.arange(len(bins))[:, None]
                    size = 256 * len(bins)
                    key = (m, node)
                    g_sum[key] = g_sum.get(key, 0.0) + np.bincount(at.ravel(), np.tile(g[inside], len(bins)), size)
                    n_sum[key] = n_sum.get(key, 0) + np.bincount(at.ravel(), minlength=size)
        for (m, node), n in n_sum.items():
            has = np.flatnonzero(n)
            columns = [np.full(len(has), m, dtype=np.int32), np.full(len(has), node, dtype=np.int32), (has // 256).astype(np.int32), (has % 256).astype(np.int32), g_sum[m, node][has], n[has]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["model", "node", "feature", "bin", "g", "n"])

    return rows.mapInArrow(sums, SUMS).groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def best_splits(sums: DataFrame, least_leaf: int) -> DataFrame:
    """A row per model and node that can be split: the feature, bin and side of missing values with the largest gain.

    Equal gains go to the first feature, then the first bin, then missing values on the right. A feature without missing
    values in the node sends them to the side with more rows.
    """
    of = Window.partitionBy("model", "node", "feature")
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.col("bin") == MISSING
    x = sums.withColumns({
        "gl": F.sum("g").over(upto), "nl": F.sum("n").over(upto), "ga": F.sum("g").over(of), "na": F.sum("n").over(of),
        "gm": F.coalesce(F.sum(F.when(lost, F.col("g"))).over(of), F.lit(0.0)), "nm": F.coalesce(F.sum(F.when(lost, F.col("n"))).over(of), F.lit(0)),
    }).filter(~lost)
    sides = F.explode(F.array(F.lit(False), F.lit(True)))
    x = x.withColumn("missing_left", sides).filter(~F.col("missing_left") | (F.col("nm") > 0))
    x = x.withColumns({"gl": F.col("gl") + F.when(F.col("missing_left"), F.col("gm")).otherwise(0.0), "nl": F.col("nl") + F.when(F.col("missing_left"), F.col("nm")).otherwise(0)})
    x = x.withColumns({"gr": F.col("ga") - F.col("gl"), "nr": F.col("na") - F.col("nl")}).filter((F.col("nl") >= least_leaf) & (F.col("nr") >= least_leaf))
    gain = F.col("gl") * F.col("gl") / F.col("nl") + F.col("gr") * F.col("gr") / F.col("nr") - F.col("ga") * F.col("ga") / F.col("na")
    x = x.withColumn("gain", F.round(gain, 9)).filter("gain > 0")
    side = F.when(F.col("nm") > 0, F.col("missing_left")).otherwise(F.col("nl") >= F.col("nr"))
    best = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("missing_left")).alias("r"), side.alias("missing_left"), "gl", "nl", "gr", "nr")).alias("s")
    return x.groupBy("model", "node").agg(best).select("model", "node", "s.*")


def leaf_residuals(rows: DataFrame, pending: list[list[Tree]], grown: list[Tree], models: list[int]) -> DataFrame:
    """model, node, residual: of each row and each of the models."""

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, bins, so_far = _matrix(batch)
            if not len(y):
                continue
            left, missing = _residuals(y, bins, so_far, pending), bins == MISSING
            for m in models:
                leaf = grown[m].leaf_of(bins, missing, grown[m].bin)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), m, dtype=np.int32)), pa.array(leaf.astype(np.int32)), pa.array(left[m])], names=["model", "node", "residual"])

    return rows.mapInArrow(residuals, LEAVES)


def _keep(rows: DataFrame, pending: list[list[Tree]]) -> DataFrame:
    """rows with the pending trees in so_far, written: later passes no longer walk them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, bins, so_far = _matrix(batch)
            if len(y):
                now = y - _residuals(y, bins, so_far, pending)
                yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("bins"), pa.array(list(now.T), pa.list_(pa.float64()))], names=["y", "bins", "so_far"])

    return written(rows.mapInArrow(add, rows.schema), "boosting")


def fit(train: DataFrame, features: list[str], label: str, quantiles: dict[str, float | None], settings: Settings = Settings()) -> dict[str, Forest]:
    """A forest for each name of quantiles: of the mean (None) or of a quantile. All grow in the same passes.

    Null and not-a-number features are missing values; each split learns their side. Rows without a label are left
    out; without any, or without a feature, it is a ValueError. Leaves of a quantile have that quantile of their
    residuals (exact up to ten thousand rows a leaf, then within a ten-thousandth of its rank). The result doesn't
    depend on how rows are dealt, but for the rounding of sums. The driver holds bin edges (255 a feature), a row
    per open node, and the trees.
    """
    if not features:
        raise ValueError("no features")
    names, wanted = list(quantiles), list(quantiles.values())
    at_start = train.agg(F.count(label).alias("n"), *[(F.avg(label) if q is None else F.percentile_approx(label, q, ACCURACY)).cast("double").alias(f"s{m}") for m, q in enumerate(wanted)]).first()
    if not at_start["n"]:
        raise ValueError("no rows to train on")
    starts = [at_start[f"s{m}"] for m in range(len(names))]
    edges = bin_edges(train, features, min(settings.bins, BINS))
    rows = binned(train, features, label, edges, starts)
    forests = [Forest(list(features), s, []) for s in starts]
    pending: list[list[Tree]] = [[] for _ in names]
    for _ in range(settings.iterations):
        growing = [Tree(cover=[at_start["n"]]) for _ in names]
        open_nodes = [[0] for _ in names]
        for _ in range(settings.depth):
            if not any(open_nodes):
                break
            found = best_splits(node_sums(rows, pending, growing, open_nodes, wanted), settings.least_leaf).collect()
            open_nodes = [[] for _ in names]
            for r in sorted(found, key=lambda r: (r["model"], r["node"])):
                f, b = -r["f"], -r["b"]
                values = (r["gl"] / r["nl"], r["gr"] / r["nr"])
                open_nodes[r["model"]] += growing[r["model"]].split(r["node"], f, b, float(edges[f][b]), r["missing_left"], (r["nl"], r["nr"]), values)
        # A tree of one leaf is kept as well: of a mean it is worth nothing, of a quantile it moves the base.
        at_quantile = [m for m, q in enumerate(wanted) if q is not None]
        if at_quantile:
            share = F.percentile_approx("residual", F.array(*[F.lit(wanted[m]) for m in at_quantile]), ACCURACY)
            for r in leaf_residuals(rows, pending, growing, at_quantile).groupBy("model", "node").agg(share.alias("v")).collect():
                growing[r["model"]].value[r["node"]] = r["v"][at_quantile.index(r["model"])]
        for m, tree in enumerate(growing):
            tree.value = [settings.rate * v if f < 0 else 0.0 for v, f in zip(tree.value, tree.feature, strict=True)]
            forests[m].trees.append(tree)
            pending[m].append(tree)
        if len(pending[0]) >= KEEP:
            rows, pending = _keep(rows, pending), [[] for _ in names]
    return dict(zip(names, forests, strict=True))


# Explanations.


def leaf_paths(tree: Tree) -> Iterator[tuple[float, float, dict[int, tuple[float, list[tuple[int, bool]]]]]]:
    """Per leaf: value, share of the root's cover, and by feature the share of cover that its splits on the way keep
    and these splits as (node, goes left)."""
    stack: list[tuple[int, float, dict]] = [(0, 1.0, {})]
    while stack:
        node, share, path = stack.pop()
        f = tree.feature[node]
        if f < 0:
            yield tree.value[node], share, path
            continue
        for child, goes_left in ((tree.left[node], True), (tree.right[node], False)):
            part = tree.cover[child] / tree.cover[node]
            kept, splits = path.get(f, (1.0, []))
            stack.append((child, share * part, path | {f: (kept * part, [*splits, (node, goes_left)])}))


def attributions(forest: Forest, values: np.ndarray) -> tuple[np.ndarray, float]:
    """(feature by row contributions, mean): by the covers of the paths, contributions add up to prediction less mean.

    For each leaf with features i on its way, z_i the share of cover that i's splits keep and o_i whether the row passes
    them, i's part is value * (o_i - z_i) * sum over k of k! (m-1-k)! / m! * [t^k] of the product of (z_j + o_j t) over
    the other features j: polynomials a leaf, in all rows at once, and no subsets.
    """
    missing = np.isnan(values)
    out, mean = np.zeros(values.shape), forest.base
    for tree in forest.trees:
        for value, share, path in leaf_paths(tree):
            mean += value * share
            if not path or value == 0.0:
                continue
            m = len(path)
            passes = np.ones((m, values.shape[1]), dtype=bool)
            for i, (f, (_, splits)) in enumerate(path.items()):
                for node, goes_left in splits:
                    left = np.where(missing[f], tree.missing_left[node], values[f] <= tree.threshold[node])
                    passes[i] &= left == goes_left
            weights = [1.0 / m]
            for k in range(1, m):
                weights.append(weights[-1] * k / (m - k))  # k! (m-1-k)! / m!
            kept = [z for z, _ in path.values()]
            for i, f in enumerate(path):
                poly = np.zeros((m, values.shape[1]))
                poly[0] = 1.0
                for j in range(m):
                    if j != i:
                        poly[1:] = kept[j] * poly[1:] + passes[j] * poly[:-1]
                        poly[0] *= kept[j]
                out[f] += value * (passes[i] - kept[i]) * np.tensordot(weights, poly, axes=1)
    return out, mean


def explanation(forest: Forest, top: int = 8) -> Column:
    """array of (feature, contribution), the `top` largest by size first, equal ones in the features' order."""
    names = np.array(forest.features)

    @F.pandas_udf("array<struct<feature:string,contribution:double>>")
    def factors(rows: pd.DataFrame) -> pd.Series:
        found, _ = attributions(forest, rows.to_numpy(dtype=float).T)
        order = np.argsort(-np.abs(found), axis=0, kind="stable")[:top]
        return pd.Series([[{"feature": names[f], "contribution": round(float(found[f, r]), 4)} for f in order[:, r]] for r in range(found.shape[1])])

    return factors(forest.inputs())
