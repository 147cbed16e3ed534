"""Training, ensembles and scoring with Spark ML."""

from __future__ import annotations

import json
import random
from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.functions.numbers import decision, focal_terms
from tapewatch.operators.features import sanitised
from tapewatch.operators.metrics import LABEL, SCORE, evaluation, ranking_quality
from tapewatch.operators.selection import class_weights, under_sample
from tapewatch.schemas import KEYS
from tapewatch.session import staged

# Settings of the published learners that Spark's trees share.
LEARNING_RATE, SECOND_LEARNING_RATE = 0.05, 0.03
TREE_DEPTH, ROW_SHARE = 6, 0.8
FOREST_TREES, FOREST_DEPTH, FOREST_LEAF_ROWS = 300, 8, 10
FOCAL_ALPHA, FOCAL_GAMMA = 0.25, 2.0
VALIDATION_FLAG, WEIGHT = "_held_out", "_weight"
#: Trials of a search that are fitted at a time.
TRIALS_AT_ONCE = 4


def boosted_trees(rounds: int = 100, rate: float = LEARNING_RATE, depth: int = TREE_DEPTH, seed: int = 42, **more):
    """Boosted trees; with a ``validationIndicatorCol`` they stop early."""
    settings = dict(
        labelCol=LABEL, featuresCol="features", maxIter=rounds, stepSize=rate, maxDepth=depth,
        subsamplingRate=ROW_SHARE, featureSubsetStrategy="0.8", seed=seed,
    )
    return GBTClassifier(**(settings | more))


def second_boosted_trees(rounds: int = 100, seed: int = 43, **more):
    return boosted_trees(rounds, SECOND_LEARNING_RATE, seed=seed, **({"featureSubsetStrategy": "sqrt"} | more))


def random_forest(
    trees: int = FOREST_TREES, depth: int = FOREST_DEPTH, leaf_rows: int = FOREST_LEAF_ROWS, seed: int = 42, **more
):
    settings = dict(
        labelCol=LABEL, featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf_rows, seed=seed
    )
    return RandomForestClassifier(**(settings | more))


def linear_member(**more):
    """A linear model on scaled features, as a differently-minded ensemble member."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    model = LogisticRegression(labelCol=LABEL, featuresCol="scaled", regParam=0.01, **more)
    return Pipeline(stages=[scaler, model])


def model_input(
    df: DataFrame, features: Sequence[str], keep: Sequence[str] = KEYS, fill_absent: bool = False
) -> DataFrame:
    """Keys, label and one feature vector; missing values are 0, and with ``fill_absent`` absent columns too."""
    absent = {c: F.lit(0.0) for c in features if c not in df.columns}
    if absent and not fill_absent:
        raise ValueError(f"features the table lacks: {', '.join(absent)}")
    clean = sanitised(df.withColumns(absent), list(features))
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(clean)
    kept = [c for c in dict.fromkeys([*keep, LABEL, WEIGHT, VALIDATION_FLAG]) if c in assembled.columns]
    return assembled.select(*kept, "features")


def with_class_weight(df: DataFrame, weight: float | None = None) -> DataFrame:
    """``_weight``: negatives per positive for positives (or the given weight), 1 for the rest."""
    if weight is None:
        weight = class_weights(df).first()["positive_weight"] or 1.0
    return df.withColumn(WEIGHT, F.when(F.col(LABEL) == 1, float(weight)).otherwise(1.0))


def with_held_out(df: DataFrame, share: float = 0.1, seed: int = 42, ids: Sequence[str] = KEYS) -> DataFrame:
    """Mark a repeatable share of the rows for early stopping."""
    lot = F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(10_000))
    return df.withColumn(VALIDATION_FLAG, lot < int(share * 10_000))


def fit(estimator: Estimator, data: DataFrame) -> PipelineModel:
    stages = estimator if isinstance(estimator, Pipeline) else Pipeline(stages=[estimator])
    return stages.fit(data)


def scored(model: PipelineModel, data: DataFrame, out: str = SCORE) -> DataFrame:
    added = model.transform(data)
    # a model that saw no positive row has one class only
    positive = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)).alias(out)
    return added.select(*data.columns, positive)


@dataclass
class Ensemble:
    """Members and their shares of the combined probability."""

    members: dict[str, PipelineModel]
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, data: DataFrame, out: str = SCORE) -> DataFrame:
        frame, parts = data, []
        for name, model in self.members.items():
            frame = scored(model, frame, f"_p_{name}")
            parts.append(F.col(f"_p_{name}") * F.lit(self.weights[name]))
        return frame.withColumn(out, sum(parts[1:], parts[0])).drop(*[f"_p_{n}" for n in self.members])


def quality_weights(quality: dict[str, float]) -> dict[str, float]:
    """Shares proportional to each member's average precision; equal when there is none."""
    total = sum(q or 0.0 for q in quality.values())
    if not total:
        return {name: 1.0 / len(quality) for name in quality}
    return {name: (q or 0.0) / total for name, q in quality.items()}


def fit_ensemble(estimators: dict[str, Estimator], train: DataFrame, valid: DataFrame) -> Ensemble:
    """Fit all members and weigh them by average precision on the validation rows.

    All members' scores are put in one tall table and evaluated by one grouped aggregate.
    """
    members = {name: fit(e, train) for name, e in estimators.items()}
    frame = valid
    for name, model in members.items():
        frame = scored(model, frame, f"_p_{name}")
    pairs = [x for n in members for x in (F.lit(n), F.col(f"_p_{n}"))]
    tall = frame.select(LABEL, F.explode(F.create_map(*pairs)).alias("member", SCORE))
    quality = {r["member"]: r["pr_auc"] for r in ranking_quality(tall, ["member"]).collect()}
    return Ensemble(members, quality_weights({n: quality.get(n) for n in members}))


class AveragePrecision(Evaluator):
    """Exact average precision as the objective of a parameter search."""

    def _evaluate(self, dataset: DataFrame) -> float:
        frame = dataset.select(LABEL, vector_to_array("probability")[1].alias(SCORE))
        return ranking_quality(frame).first()["pr_auc"] or 0.0

    def isLargerBetter(self) -> bool:
        return True


def search(
    estimator: Estimator, grid: dict, train: DataFrame, valid: DataFrame, trials: int = 50, seed: int = 42, at_once: int = TRIALS_AT_ONCE
) -> PipelineModel:
    """Try a random sample of a parameter grid and keep the best by average precision on the validation rows.

    ``at_once`` trials run at a time, as a round of boosting has many short jobs; the result does not depend on it.
    """
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(getattr(estimator, param), values)
    options = builder.build()
    chosen = random.Random(seed).sample(options, min(trials, len(options)))
    judge = AveragePrecision()

    @inheritable_thread_target(train.sparkSession)
    def trial(k: int) -> tuple[float, int, PipelineModel]:
        # one fit per trial, as a search requires
        model = fit(estimator.copy(chosen[k]), train)
        return judge.evaluate(model.transform(valid)) or 0.0, -k, model

    with ThreadPool(at_once) as pool:
        return max(pool.imap(trial, range(len(chosen))), key=lambda x: x[:2])[2]


def importances(model: PipelineModel, features: Sequence[str], spark: SparkSession, n: int = 20) -> DataFrame:
    """The n most important features of a tree model; as many rows as there are features at most."""
    values = model.stages[-1].featureImportances.toArray()
    table = spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(n)


def mean_focal_loss(df: DataFrame, alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA, score: str = SCORE):
    """Mean focal loss of predicted probabilities, by way of their log-odds."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(score)))
    terms = focal_terms(F.ln(p / (1 - p)), F.col(LABEL), alpha, gamma)
    return df.agg(F.avg(terms["focal_loss"]).alias("focal_loss"))


def predictions(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The prediction table: keys, time, label, probability and decision."""
    wanted = [c for c in (*KEYS, "order_ts", LABEL, SCORE) if c in df.columns]
    return df.select(*wanted).withColumn("predicted_binary", decision(F.col(SCORE), threshold))


def save(ensemble: Ensemble, features: Sequence[str], metrics: dict[str, float], path: str, spark: SparkSession) -> None:
    """Members below ``path/members``, and one row describing them."""
    root = path.rstrip("/")
    for name, model in ensemble.members.items():
        model.write().overwrite().save(f"{root}/members/{name}")
    described = [(json.dumps(list(features)), json.dumps(ensemble.weights), json.dumps(metrics))]
    card = spark.createDataFrame(described, "features string, weights string, metrics string")
    card.write.mode("overwrite").json(f"{root}/card")


def load(path: str, spark: SparkSession) -> tuple[Ensemble, list[str], dict[str, float]]:
    root = path.rstrip("/")
    card = spark.read.json(f"{root}/card").first()
    weights = json.loads(card["weights"])
    members = {name: PipelineModel.load(f"{root}/members/{name}") for name in weights}
    return Ensemble(members, weights), json.loads(card["features"]), json.loads(card["metrics"])


def run_record(
    method: str, train: DataFrame, valid: DataFrame, feature_count: int, ranked: DataFrame, run_ts: str | None = None
) -> DataFrame:
    """The tall metrics rows of one run: data volumes and the overall evaluation."""
    when = F.to_timestamp(F.lit(run_ts)) if run_ts else F.current_timestamp()
    volumes = []
    for name, frame in (("train", train), ("valid", valid)):
        counted = frame.agg(
            F.count(F.lit(1)).cast("double").alias(f"{name}_samples"), F.sum(LABEL).cast("double").alias(f"{name}_positives"),
            F.avg(F.col(LABEL).cast("double")).alias(f"{name}_positive_ratio"),
        )
        pairs = [x for c in counted.columns for x in (F.lit(c), F.col(c))]
        volumes.append(counted.select(F.explode(F.create_map(*pairs)).alias("metric", "value")))
    size = train.sparkSession.createDataFrame([("n_features", float(feature_count))], "metric string, value double")
    rows = volumes[0].unionByName(volumes[1]).unionByName(size).unionByName(ranked.select("metric", "value"))
    return rows.select(
        when.cast("timestamp_ntz").alias("run_ts"), F.lit(method).alias("method"), F.lit("overall").alias("scope"),
        F.lit(None).cast("string").alias("ticker"), "metric", "value",
    )


def learning_curve(
    make: Estimator, train: DataFrame, valid: DataFrame, shares: Sequence[float], ids: Sequence[str] = KEYS, seed: int = 42
) -> DataFrame:
    """Validation quality by share of the training rows; smaller shares are subsets of larger ones.

    One fit per share, as the curve requires; the rows of a share are those whose hash falls below it.
    """
    lot = F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(1_000_000))
    points = None
    for share in shares:
        part = train.where(lot < int(share * 1_000_000))
        quality = ranking_quality(scored(fit(make, part), valid))
        size = part.agg(F.count(F.lit(1)).alias("train_rows")).withColumn("share", F.lit(float(share)))
        point = quality.withColumn("share", F.lit(float(share))).join(F.broadcast(size), "share")
        points = point if points is None else points.unionByName(point)
    return points


def train_and_evaluate(
    table: DataFrame,
    features: Sequence[str],
    estimators: dict[str, Estimator],
    sampling: str = "stratified",
    class_weight: bool = False,
    method: str = "ensemble",
    fill_absent: bool = False,
) -> tuple[Ensemble, DataFrame, DataFrame]:
    """Fit on the train split, evaluate on the valid split.

    ``table`` has a ``split`` column. Sampling touches training rows only: ``under``, ``stratified``
    (per ticker) or ``none``. Returns the ensemble, the scored validation rows and the metrics.
    """
    train = table.where(F.col("split") == "train")
    valid = table.where(F.col("split") == "valid")
    if sampling == "under":
        train = under_sample(train)
    elif sampling == "stratified":
        train = under_sample(train, by=["ticker"])
    if class_weight:
        train = with_class_weight(train)
    keep = (*KEYS, "order_ts")
    # tree learners pass over their input many times; it may spill
    fitted_on = model_input(train, features, fill_absent=fill_absent).persist()
    judged_on = staged(model_input(valid, features, keep, fill_absent=fill_absent))
    ensemble = fit_ensemble(estimators, fitted_on, judged_on)
    # every metric passes over the scores; members are asked once
    result = staged(ensemble.score(judged_on).drop("features"))
    metrics = staged(run_record(method, fitted_on, judged_on, len(features), evaluation(result, KEYS)))
    fitted_on.unpersist()
    return ensemble, predictions(result), metrics
