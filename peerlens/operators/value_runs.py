"""Training runs of the value model: candidates, intervals, the best run's artifact, and scoring from what was saved."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, fields

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import written
from . import boosting, value_features, value_model
from .boosting import Forest, Settings, Tree

COVERAGE = 0.8
LOW, HIGH = 0.1, 0.9
RANKS = 1_000_000
TREES = "part string, tree int, node int, feature int, threshold double, bin int, missing_left boolean, left int, right int, value double, cover long"
MODEL, INTERVAL, META, EXAMPLES = "model", "trees", "meta", "examples"


def interpolated_quantile(rows: DataFrame, value: str, share: float) -> float | None:
    """Quantile between the two order statistics around share * (n - 1); exact up to RANKS rows, then within n / RANKS ranks."""
    n = rows.filter(F.col(value).isNotNull()).count()
    if not n:
        return None
    at = share * (n - 1)
    low, part = math.floor(at), at - math.floor(at)
    ranks = [(low + 0.5) / n, (min(low + 1, n - 1) + 0.5) / n]
    a, b = rows.agg(F.percentile_approx(value, ranks, RANKS).alias("q")).first()["q"]
    return a + part * (b - a)


def conformal_width(validation: DataFrame, label: str, low: str, high: str, coverage: float = COVERAGE) -> float:
    """What both ends of an interval move outwards: the corrected quantile of how far labels lie outside (negative: inside)."""
    scores = validation.filter(F.col(label).isNotNull()).select(F.greatest(F.col(low) - F.col(label), F.col(label) - F.col(high)).alias("score"))
    n = scores.count()
    if not n:
        raise ValueError("no validation rows")
    return interpolated_quantile(scores, "score", min(1.0, math.ceil((n + 1) * coverage) / n))


@dataclass
class Artifact:
    """What scoring needs: the best model (a forest, or a pipeline over the features), interval forests and width, the
    medians that fill a pipeline's missing values, and the training examples that comparables are counted among."""

    algorithm: str
    features: list[str]
    medians: list[float]
    width: float
    model: Forest | PipelineModel
    low: Forest
    high: Forest
    training: DataFrame


def tree_rows(part: str, forest: Forest) -> list[tuple]:
    names = [f.name for f in fields(Tree)]
    return [(part, t, node, *[{"feature": tree.feature, "threshold": tree.threshold, "bin": tree.bin, "missing_left": tree.missing_left, "left": tree.left, "right": tree.right, "value": tree.value, "cover": tree.cover}[n][node] for n in names]) for t, tree in enumerate(forest.trees) for node in range(len(tree.feature))]


def forest_of(part: str, rows: list, features: list[str], base: float) -> Forest:
    own = sorted((r for r in rows if r["part"] == part), key=lambda r: (r["tree"], r["node"]))
    trees: dict[int, list] = {}
    for r in own:
        trees.setdefault(r["tree"], []).append(r)
    return Forest(features, base, [Tree(**{f.name: [r[f.name] for r in t] for f in fields(Tree)}) for t in trees.values()])


def save(artifact: Artifact, folder: str) -> None:
    """Write an artifact under folder, a shared one, as Parquet and, for a pipeline, in Spark ML's own format."""
    spark = artifact.training.sparkSession
    forests = {"low": artifact.low, "high": artifact.high} | ({MODEL: artifact.model} if isinstance(artifact.model, Forest) else {})
    if MODEL not in forests:
        artifact.model.write().overwrite().save(f"{folder}/{MODEL}")
    rows = [r for part, forest in forests.items() for r in tree_rows(part, forest)]
    spark.createDataFrame(rows, TREES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{INTERVAL}")
    meta = {"algorithm": artifact.algorithm, "features": artifact.features, "medians": artifact.medians, "width": artifact.width, "bases": {k: f.base for k, f in forests.items()}}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{META}")
    artifact.training.write.mode("overwrite").parquet(f"{folder}/{EXAMPLES}")


def load(spark: SparkSession, folder: str) -> Artifact:
    """The artifact saved under folder. Trees, bounded by iterations and leaves, come to the driver; examples don't."""
    meta = json.loads(spark.read.text(f"{folder}/{META}").first()["value"])
    rows = spark.read.parquet(f"{folder}/{INTERVAL}").collect()
    forests = {part: forest_of(part, rows, meta["features"], base) for part, base in meta["bases"].items()}
    model = forests.get(MODEL) or PipelineModel.load(f"{folder}/{MODEL}")
    return Artifact(meta["algorithm"], meta["features"], meta["medians"], meta["width"], model, forests["low"], forests["high"], spark.read.parquet(f"{folder}/{EXAMPLES}"))


def predict(rows: DataFrame, artifact: Artifact) -> DataFrame:
    """rows with predicted, low and high, all of the label (a logarithm)."""
    kept = rows.columns
    out = rows.withColumns({"low": artifact.low.column() - artifact.width, "high": artifact.high.column() + artifact.width})
    if isinstance(artifact.model, Forest):
        return out.withColumn("predicted", artifact.model.column())
    return artifact.model.transform(out).select(*kept, "low", "high", "predicted")


def explained(rows: DataFrame, artifact: Artifact, top: int = 8) -> DataFrame:
    """rows with factors: the largest contributions to the prediction. Null for a kind of model that has no explanation."""
    if isinstance(artifact.model, Forest):
        return rows.withColumn("factors", boosting.explanation(artifact.model, top))
    last, scaler = artifact.model.stages[-1], artifact.model.stages[-2]
    if not hasattr(last, "coefficients"):
        return rows.withColumn("factors", F.lit(None).cast("array<struct<feature:string,contribution:double>>"))
    scales = {f: (float(c), float(m), float(s)) for f, c, m, s in zip(artifact.features, last.coefficients, scaler.mean, scaler.std, strict=True)}
    filled = rows.select(F.struct("*").alias("__row"), *[F.coalesce(F.col(f).cast("double"), F.lit(m)).alias(f) for f, m in zip(artifact.features, artifact.medians, strict=True)])
    return value_features.linear_explanation(filled, scales, top).select("__row.*", "factors")


def score(rows: DataFrame, artifact: Artifact, *, days: str = "age_days", minutes: str = "minutes", complete: str = "feature_completeness", top: int = 8) -> DataFrame:
    """rows with value, low_value and high_value in money (2 decimals), factors, n_comparables and confidence.

    Null features are missing values; rows of all null features are scored as well. An empty table gives an empty result.
    """
    x = explained(predict(rows, artifact), artifact, top)
    x = value_features.comparables(x, artifact.training, days=days)
    x = x.withColumns({"value": F.round(F.expm1("predicted"), 2), "low_value": F.round(F.expm1("low"), 2), "high_value": F.round(F.expm1("high"), 2)})
    sure = value_features.prediction_confidence(F.col(minutes).cast("double"), F.col(complete), F.col("n_comparables"), F.expm1("low"), F.expm1("high"), F.expm1("predicted"))
    return x.withColumn("confidence", sure)


def candidates(train: DataFrame, features: list[str], label: str, settings: Settings, kinds: tuple[str, ...]) -> tuple[dict[str, Forest | PipelineModel], Forest, Forest]:
    """Fitted models by algorithm, and the two interval forests; the forests grow in the same passes."""
    quantiles: dict[str, float | None] = {"low": LOW, "high": HIGH} | ({"hist_boosting": None} if "hist_boosting" in kinds else {})
    forests = boosting.fit(train, features, label, quantiles, settings)
    found: dict[str, Forest | PipelineModel] = {k: value_model.pipeline(k, features, label).fit(train) for k in kinds if k != "hist_boosting"}
    if "hist_boosting" in kinds:
        found["hist_boosting"] = forests["hist_boosting"]
    return found, forests["low"], forests["high"]


def train_runs(examples: DataFrame, features: list[str], label: str, *, folder: str | None = None, kinds: tuple[str, ...] = ("ridge", "hist_boosting", "forest"), settings: Settings = Settings(), first_run: int = 1, bands: tuple[str, ...] = (), minimum: tuple[int, int, int] = (30, 10, 10), days: str = "age_days") -> tuple[list[dict], Artifact]:
    """(runs, best): a run for the median baseline and for each kind, with validation and test metrics.

    examples have part (train, validate, test), features, label, baseline keys position_group, and the band columns. The
    best kind is that with the smallest error on validation rows; its run alone has the artifact (where a folder is given),
    coverage and median width of the 80 % interval on test rows, and metrics by band. Too few rows is a ValueError.
    Examples are written once: fits and metrics pass over them many times, and would make them anew each time.
    """
    examples = written(examples, "value-examples")
    value_model.require_parts(examples, minimum)
    train, validation, test = (examples.filter(F.col("part") == p) for p in ("train", "validate", "test"))
    found, low, high = candidates(train, features, label, settings, kinds)
    medians = train.agg(*[F.median(F.col(f).cast("double")).alias(f) for f in features]).first()
    filled = [float(medians[f]) if medians[f] is not None else 0.0 for f in features]
    known = [c for c in (days, "position_group") if c in examples.columns]
    width = conformal_width(validation.withColumns({"__low": low.column(), "__high": high.column()}), label, "__low", "__high")

    def measured(model: Forest | PipelineModel) -> dict[str, dict]:
        probe = Artifact("", features, filled, width, model, low, high, train)
        by = value_model.regression_metrics(predict(examples.filter("part <> 'train'"), probe), ["part"], label)
        return {r["part"]: {k: v for k, v in r.asDict().items() if k != "part"} for r in by.collect()}

    base = value_model.regression_metrics(value_model.baseline(examples, [c for c in known if c != days] or ["part"], label).filter("part <> 'train'"), ["part"], label)
    runs = [{"algorithm": "baseline_median", "metrics": {r["part"]: {k: v for k, v in r.asDict().items() if k != "part"} for r in base.collect()}}]
    runs += [{"algorithm": k, "metrics": measured(m)} for k, m in found.items()]
    best = min(runs[1:], key=lambda r: (r["metrics"]["validate"]["mae_log"], r["algorithm"]))
    artifact = Artifact(best["algorithm"], features, filled, width, found[best["algorithm"]], low, high, train.select(*known))
    on_test = predict(test, artifact)
    inside = on_test.agg(F.avg(F.col(label).between(F.col("low"), F.col("high")).cast("double")).alias("coverage"), F.median(F.expm1("high") - F.expm1("low")).alias("width")).first()
    best["metrics"]["test"] |= {"interval_coverage": inside["coverage"], "interval_median_width": inside["width"]}
    best["metrics"]["test"] |= {f"by_{b}": {r[b]: {"n": r["n"], "mae_log": r["mae_log"], "within_50": r["within_50"]} for r in value_features.evaluate_by(on_test, b, label=label).collect()} for b in bands}
    for i, r in enumerate(runs):
        r |= {"run_id": first_run + i, "features": features, "settings": asdict(settings), "artifact": None, "is_active": False}
    if folder:
        best["artifact"] = f"{folder}/{best['algorithm']}-{best['run_id']}"
        save(artifact, best["artifact"])
    return runs, artifact
