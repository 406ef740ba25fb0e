"""Exact nearest neighbours for a table of targets: pivots, triangle bounds, and blocks of what the bounds leave."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written

PIVOTS = 32
TARGETS_A_BLOCK = 256
CANDIDATES_A_BLOCK = 4096
BROADCAST_ROWS = 200_000
SLACK = 1e-9


def pick_pivots(candidates: DataFrame, key: str, vector: str, n: int) -> np.ndarray:
    """The vectors of the n candidates that come first by hash: n rows reach the driver. They decide the work, not the result."""
    rows = candidates.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(n).select(F.col(vector).cast("array<double>").alias("v")).collect()
    return np.array([r["v"] for r in rows], dtype=np.float64)


def _cells(rows: DataFrame, pivots: np.ndarray, key: str, vector: str, within: tuple[str, ...]) -> DataFrame:
    """of, id, v, cell, d: each row's nearest pivot and the distance to it. Rows without an id or a vector take no part."""

    @F.pandas_udf("cell int, d double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        cell, d = np.zeros(len(x), dtype=np.int32), np.full(len(x), np.inf)
        for i, p in enumerate(pivots):
            to = np.sqrt(((x - p) ** 2).sum(axis=1))
            cell, d = np.where(to < d, np.int32(i), cell), np.minimum(to, d)
        return pd.DataFrame({"cell": cell, "d": d})

    of = F.to_json(F.struct(*within)) if within else F.lit("")
    x = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(of.alias("of"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return x.withColumn("c", nearest("v")).select("of", "id", "v", "c.cell", "c.d")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def bounds(targets: DataFrame, candidates: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """of, i, j, low, high: a candidate of cell j can be among the k nearest of some target of cell i only if its distance
    to its pivot lies between low and high.

    reach, the largest distance of a target of cell i to its pivot, and the k + 1 candidates nearest to each pivot give an
    upper bound of the distance to the k-th neighbour (one more, as a target can be among them); the triangle does the rest.
    """
    n = len(pivots)
    between = np.sqrt(((pivots[:, None] - pivots[None, :]) ** 2).sum(axis=2))
    gap = F.element_at(F.array(*[F.lit(float(x)) for x in between.ravel()]), (F.col("i") * n + F.col("j") + 1).cast("int"))
    reach = targets.groupBy("of", F.col("cell").alias("i")).agg(F.max("d").alias("reach"))
    near = candidates.select("of", F.col("cell").alias("j"), "d").withColumn("r", F.row_number().over(Window.partitionBy("of", "j").orderBy("d"))).filter(F.col("r") <= k + 1)
    within = reach.join(near, "of").withColumn("upper", F.col("reach") + gap + F.col("d"))
    nth = within.withColumn("r", F.row_number().over(Window.partitionBy("of", "i").orderBy("upper"))).filter(F.col("r") == k + 1).select("of", "i", "upper")
    at = reach.join(nth, ["of", "i"], "left").withColumn("far", F.col("reach") + F.coalesce("upper", F.lit(float("inf"))) + SLACK)
    pairs = at.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return pairs.select("of", "i", "j", (gap - F.col("far")).alias("low"), (gap + F.col("far")).alias("high"))


def nearest_join(candidates: DataFrame, targets: DataFrame, *, key: str, vector: str = "vector", within: tuple[str, ...] = (), k: int = 10, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(target, candidate, distance) and (computed, all): for every target the k candidates of another id nearest to it, ties
    by id, among those that agree with it in the columns `within` (nulls being equal).

    Targets are a table like the candidates and never pass the driver. Both go to the cell of their nearest pivot; a candidate
    is sent to the cells of targets that the triangle doesn't rule out, in blocks of bounded size on either side, and each
    block leaves k rows a target. computed and all: distances that were computed, and those that comparing everything
    within would take. Exact for any vectors; where distances differ little, as in many random dimensions, the bounds
    rule out little. Rows without an id or a vector take no part; no candidates, or no targets, give no rows.
    """
    spots = pick_pivots(candidates, key, vector, pivots)
    spark = candidates.sparkSession
    if not len(spots):
        return spark.createDataFrame([], "target long, candidate long, distance double"), spark.createDataFrame([(0, 0)], "computed long, all long")
    c, t = written(_cells(candidates, spots, key, vector, within), "candidates"), written(_cells(targets, spots, key, vector, within), "targets")
    limits = _small(written(bounds(t, c, spots, k), "bounds"))
    sent = written(c.withColumnRenamed("cell", "j").join(limits, ["of", "j"]).filter((F.col("d") >= F.col("low")) & (F.col("d") <= F.col("high"))).select("of", "i", "id", "v"), "sent")
    asks = t.select("of", F.col("cell").alias("i"), "id", "v")
    parts = lambda n, size: F.ceil(F.coalesce(F.col(n), F.lit(1)) / size).cast("int")
    sizes = asks.groupBy("of", "i").agg(F.count("*").alias("n_t")).join(sent.groupBy("of", "i").agg(F.count("*").alias("n_c")), ["of", "i"], "left")
    sizes = written(sizes.select("of", "i", "n_t", "n_c", parts("n_t", TARGETS_A_BLOCK).alias("t_parts"), parts("n_c", CANDIDATES_A_BLOCK).alias("c_parts")), "sizes")
    counted = _small(sizes.select("of", "i", "t_parts", "c_parts"))
    own, other = F.pmod(F.xxhash64("id"), F.col("own_parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1))

    def dealt(df: DataFrame, mine: str, theirs: str) -> DataFrame:
        x = df.join(counted.withColumnsRenamed({mine: "own_parts", theirs: "other_parts"}), ["of", "i"])
        return x.select("of", "i", own.alias("own"), other.alias("other"), "id", "v")

    left = dealt(asks, "t_parts", "c_parts").select("of", "i", F.col("own").alias("tp"), F.col("other").alias("cp"), F.lit(True).alias("asks"), "id", "v")
    right = dealt(sent, "c_parts", "t_parts").select("of", "i", F.col("other").alias("tp"), F.col("own").alias("cp"), F.lit(False).alias("asks"), "id", "v")

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        a, b = df[df["asks"]], df[~df["asks"]]
        out = [pd.DataFrame({"target": np.zeros(0, dtype=np.int64), "candidate": np.zeros(0, dtype=np.int64), "distance": np.zeros(0)})]
        if len(a) and len(b):
            ids, x = b["id"].to_numpy(), np.stack(b["v"].to_numpy())
            for target, v in zip(a["id"], a["v"], strict=True):
                d = np.sqrt(((x - v) ** 2).sum(axis=1))
                others = np.flatnonzero(ids != target)
                first = others[np.lexsort((ids[others], d[others]))[:k]]
                out.append(pd.DataFrame({"target": target, "candidate": ids[first], "distance": d[first]}))
        return pd.concat(out, ignore_index=True)

    found = left.unionAll(right).groupBy("of", "i", "tp", "cp").applyInPandas(compare, "target long, candidate long, distance double")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy("distance", "candidate"))).filter(F.col("r") <= k).drop("r")
    everything = t.groupBy("of").agg(F.count("*").alias("n")).join(c.groupBy("of").agg(F.count("*").alias("m")), "of").agg(F.sum(F.col("n") * F.col("m")).alias("all"))
    done = sizes.agg(F.sum(F.col("n_t") * F.coalesce("n_c", F.lit(0))).alias("computed"))
    work = done.join(F.broadcast(everything)).select(F.coalesce("computed", F.lit(0)).alias("computed"), F.coalesce("all", F.lit(0)).alias("all"))  # one row each
    return ranked, work
