"""Value regression without leakage: examples, baseline, models, intervals."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.storage import written

# Rows of a key beyond which its quantiles are found by bounds, and how near to their ranks bounds come, as a share of its rows.
LARGE, ACCURACY = 1_000_000, 10_000


def banded(value: Column, edges: tuple[float, ...]) -> Column:
    """Index of the right-closed bin; null outside."""
    b = F.when(value.isNull() | (value <= edges[0]) | (value > edges[-1]), None)
    for i, e in enumerate(edges[1:]):
        b = b.when(value <= e, i)
    return b.cast("int")


def largest(rows: DataFrame, keys: list[str]) -> int:
    """How many rows the most frequent key has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def quantile(rows: DataFrame, keys: list[str], value: str, share: float = 0.5) -> DataFrame:
    """keys, quantile: F.percentile of value, a row per key that has values. Nulls don't count, NaN is above all others.

    F.percentile holds the distinct values of a key in one task, so it serves only keys of up to LARGE rows. Beyond, a sketch
    gives two values that the wanted ranks lie between; rows below them are counted, and those between go on as values
    with counts, about 6 / ACCURACY of all; of smaller keys all do. Should a sketch be off, all values go on, sorted (and
    spilled) by key.
    """
    names = [f"__{i}" for i in range(len(keys))]
    x = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("__v")).filter("__v is not null")
    back = [F.col(n).alias(k) for k, n in zip(keys, names, strict=True)]
    if largest(x, names) <= LARGE:
        return x.groupBy(*names).agg(F.count("*").alias("__n"), F.percentile("__v", F.lit(float(share))).alias("quantile")).filter("__n > 0").select(*back, "quantile")
    x = written(x, "quantile-values")
    top = F.lit(float("inf"))
    near = F.percentile_approx(F.nanvl("__v", top), [max(0.0, share - 3 / ACCURACY), min(1.0, share + 3 / ACCURACY)], ACCURACY)
    bounds = written(x.groupBy(*names).agg(F.count("*").alias("n"), near.alias("c")).select(*names, "n", F.when(F.col("n") > LARGE, F.col("c")[0]).otherwise(-top).alias("lo"), F.when(F.col("n") > LARGE, F.nullif(F.col("c")[1], top)).alias("hi")), "quantile-bounds")
    found = written(_between(x, bounds, names, share), "quantiles")
    if not found.filter("quantile is null").isEmpty():
        found = _between(x, bounds.withColumns({"lo": F.lit(float("-inf")), "hi": F.lit(None).cast("double")}), names, share)
    return found.select(*back, "quantile")


def _between(x: DataFrame, bounds: DataFrame, names: list[str], share: float) -> DataFrame:
    """names, quantile of x (names, __v) from its values from lo to hi (to the end where that is null); null where these lack
    its ranks. bounds: names, n, lo, hi."""
    b = bounds.select(*[F.col(k).alias(f"__b{k}") for k in names], "n", "lo", "hi")
    on = [F.col(k).eqNullSafe(F.col(f"__b{k}")) for k in names]
    with_bounds = x.join(b, on) if on else x.crossJoin(F.broadcast(b))  # without keys b is one row
    inside = F.when((F.col("__v") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("__v") <= F.col("hi"))), F.col("__v"))
    counted = with_bounds.groupBy(*names, "n", inside.alias("u")).agg(F.count("*").alias("c"), F.count(F.when(F.col("__v") < F.col("lo"), 1)).alias("below"))
    along = Window.partitionBy(*names).orderBy("u").rowsBetween(Window.unboundedPreceding, 0)  # rows that are not inside come first
    upto = F.sum(F.when(F.col("u").isNull(), F.col("below")).otherwise(F.col("c"))).over(along)
    at = (F.col("n") - 1) * F.lit(float(share))
    holds = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank), F.col("u")))
    ends = counted.withColumn("upto", upto).filter("u is not null").groupBy(*names, "n").agg(holds(F.floor(at)).alias("low"), holds(F.ceil(at)).alias("high"))
    between = (F.ceil(at) - at) * F.col("low") + (at - F.floor(at)) * F.col("high")
    ends = ends.select(*names, F.when((F.floor(at) == F.ceil(at)) | (F.col("low") == F.col("high")), F.col("low")).otherwise(between).alias("quantile"))
    b = bounds.select(*[F.col(k).alias(f"__b{k}") for k in names])
    return b.join(ends, [F.col(f"__b{k}").eqNullSafe(F.col(k)) for k in names], "left").select(*[F.col(f"__b{k}").alias(k) for k in names], "quantile") if names else b.crossJoin(ends).select("quantile")


def inflation_index(fees: DataFrame, *, reference_year: int = C.REFERENCE_YEAR, minimum: float = 1e6) -> DataFrame:
    """year, index: yearly exact median over the reference year's; 1 where either is missing."""
    yearly = quantile(fees.filter(F.col("fee") >= minimum), ["year"], "fee").withColumnRenamed("quantile", "m")
    ref = yearly.filter(F.col("year") == reference_year).agg(F.max("m").alias("ref"))
    return yearly.join(F.broadcast(ref)).select("year", F.coalesce(F.col("m") / F.col("ref"), F.lit(1.0)).alias("index"))  # ref is one row


def split_by_time(examples: DataFrame, year: str, validate_from: int, test_from: int) -> DataFrame:
    return examples.withColumn("part", F.when(F.col(year) < validate_from, "train").when(F.col(year) < test_from, "validate").otherwise("test"))


def baseline(examples: DataFrame, keys: list[str], label: str) -> DataFrame:
    """examples + predicted: the train median of the same keys, else of all."""
    train = examples.filter("part = 'train'")
    medians = quantile(train, keys, label).withColumnRenamed("quantile", "m")
    overall = train.sparkSession.range(1).select().join(quantile(train, [], label).withColumnRenamed("quantile", "all"), how="left")
    return examples.join(medians, keys, "left").join(F.broadcast(overall)).withColumn("predicted", F.coalesce("m", "all")).drop("m", "all")  # overall is one row


def regression_metrics(predicted: DataFrame, keys: list[str], label: str, prediction: str = "predicted") -> DataFrame:
    """mae, rmse, r2 of the log values; mae, median error and shares within 25 and 50 % of the money.

    Where a key has more than LARGE rows, labels and predictions are written once, and the median found by quantile().
    """
    y, p = F.col(label), F.col(prediction)
    large = largest(predicted, keys) > LARGE
    if large:
        predicted = written(predicted.select(*keys, y.alias("__y"), p.alias("__p"), F.abs(F.expm1(p) - F.expm1(y)).alias("__off")), "predictions")
        y, p = F.col("__y"), F.col("__p")
    eur, e = F.expm1(y), F.expm1(p)
    off = F.abs(e - eur)
    out = predicted.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(y - p)).alias("mae_log"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse_log"),
        F.when(F.var_pop(y) > 0, 1 - F.avg((y - p) * (y - p)) / F.var_pop(y)).alias("r2_log"),
        F.avg(off).alias("mae"), (F.lit(None).cast("double") if large else F.median(off)).alias("median_error"), F.avg((off <= 0.25 * eur).cast("double")).alias("within_25"), F.avg((off <= 0.5 * eur).cast("double")).alias("within_50"),
    )
    if not large:
        return out
    medians = quantile(predicted, keys, "__off").select(*[F.col(k).alias(f"__{k}") for k in keys], "quantile")
    joined = out.join(medians, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    return joined.withColumn("median_error", F.col("quantile")).select(out.columns)


def require_parts(examples: DataFrame, minimum: tuple[int, int, int]) -> None:
    """A ValueError where train, validate or test has too few examples."""
    sizes = {r["part"]: r["n"] for r in examples.groupBy("part").agg(F.count("*").alias("n")).collect()}
    for part, least in zip(("train", "validate", "test"), minimum, strict=True):
        if sizes.get(part, 0) < least:
            raise ValueError(f"{part}: {sizes.get(part, 0)} examples, at least {least} are needed")


def _filled(features: list[str]) -> list[str]:
    return [f"{c}__i" for c in features]


def _prepare(features: list[str]) -> list:
    """raw and x: the features, and these standardised, with the train median for missing numbers."""
    filled = _filled(features)
    return [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]


def _model(kind: str, label: str) -> Estimator:
    return {
        "ridge": lambda: LinearRegression(featuresCol="x", labelCol=label, predictionCol="predicted", regParam=1.0, elasticNetParam=0.0),
        "forest": lambda: RandomForestRegressor(featuresCol="raw", labelCol=label, predictionCol="predicted", numTrees=50, seed=7),
        "boosted": lambda: GBTRegressor(featuresCol="raw", labelCol=label, predictionCol="predicted", maxIter=30, maxDepth=3, seed=7),
    }[kind]()


def pipeline(kind: str, features: list[str], label: str) -> Pipeline:
    """ridge (on standardised features), forest or boosted trees, with the train median for missing numbers."""
    return Pipeline(stages=[*_prepare(features), _model(kind, label)])


def fit_models(examples: DataFrame, features: list[str], label: str, *, minimum: tuple[int, int, int] = (30, 10, 10)) -> dict[str, DataFrame]:
    """Predictions per algorithm (ridge, forest, boosted) on all parts, trained on the train part alone.

    Missing numbers take the train median. Too few examples in a part is a ValueError. Features are prepared once, and all
    models train on what is kept of that.
    """
    require_parts(examples, minimum)
    train = examples.filter("part = 'train'")
    prepared = Pipeline(stages=_prepare(features)).fit(train)
    ready = prepared.transform(train).select(label, "raw", "x").cache()
    made = ["raw", "x", *_filled(features)]
    out = {k: _model(k, label).fit(ready).transform(prepared.transform(examples)).drop(*made) for k in ("ridge", "forest", "boosted")}
    ready.unpersist()
    return out


def conformal(predicted: DataFrame, label: str, *, coverage: float = 0.8) -> DataFrame:
    """predicted + low and high: split-conformal by the quantile ceil((n + 1) * coverage) / n of validation residuals,
    interpolated between two of them as quantiles commonly are; without validation rows both are null."""
    r = predicted.filter("part = 'validate'").select(F.abs(F.col(label) - F.col("predicted")).alias("r"))
    n = r.count()
    q = min(1.0, -(-(n + 1) * coverage // 1) / n) if n else 1.0
    width = (quantile(r, [], "r", q).first() or {"quantile": None})["quantile"]
    return predicted.withColumns({"low": F.expm1(F.col("predicted") - F.lit(width)), "high": F.expm1(F.col("predicted") + F.lit(width))})
