"""Learning and scoring. MLlib's trees have no SQL counterpart; small settings keep the fits short, but for the parameter search."""

from pyspark.sql import functions as F

from queries import bindings as b
from queries.registry import query, rounded
from tapewatch.operators import selection as sel
from tapewatch.operators.leakage import training_columns
from tapewatch.plans import models, stages
from tapewatch.schemas import KEYS
from tapewatch.session import scratch_path, staged

TRAIN, VALID = "2024010|2024011", "2024012|2024013"
ROUNDS, TREES = 5, 10


def training_table(spark, sf):
    """Features joined to labels, with split and target."""
    flow = b.tk(spark, sf)
    joined = sel.features_with_labels(stages.features(flow), stages.labels(flow))
    target = sel.with_target(joined, "enhanced_combined")
    return staged(sel.with_split(target, TRAIN, VALID))


def prepared(table):
    """Feature names and the vectors of both splits, each written once: learners pass over them many times."""
    features = training_columns(table)
    train, valid = (staged(models.model_input(table.where(F.col("split") == split), features)) for split in ("train", "valid"))
    return features, train, valid


def inputs(spark, sf):
    return prepared(training_table(spark, sf))


def scored_by(spark, sf, estimator, prepare=lambda df: df):
    _, train, valid = inputs(spark, sf)
    return models.predictions(models.scored(models.fit(estimator, prepare(train)), valid))


@query("ML1_boosted_trees")
def ml1(spark, sf):
    booster = models.boosted_trees(ROUNDS, validationIndicatorCol=models.VALIDATION_FLAG)
    return scored_by(spark, sf, booster, models.with_held_out)


@query("ML2_random_forest")
def ml2(spark, sf):
    return scored_by(spark, sf, models.random_forest(TREES))


@query("ML3_second_booster")
def ml3(spark, sf):
    return scored_by(spark, sf, models.second_boosted_trees(ROUNDS))


@query("ML3_linear_member")
def ml3_linear(spark, sf):
    return scored_by(spark, sf, models.linear_member())


def small_members():
    return {"boosted": models.boosted_trees(ROUNDS), "forest": models.random_forest(TREES), "linear": models.linear_member()}


@query("ML4_weighted_ensemble")
def ml4(spark, sf):
    _, train, valid = inputs(spark, sf)
    return models.predictions(models.fit_ensemble(small_members(), train, valid).score(valid))


@query("ML5_class_weighted_fit")
def ml5(spark, sf):
    booster = models.boosted_trees(ROUNDS, weightCol=models.WEIGHT)
    return scored_by(spark, sf, booster, models.with_class_weight)


@query("ML6_parameter_search")
def ml6(spark, sf):
    _, train, valid = inputs(spark, sf)
    grid = {"maxDepth": [3, 5], "stepSize": [0.05, 0.1]}
    # every trial has all rounds of the learner
    best = models.search(models.boosted_trees(), grid, train, valid)
    return models.predictions(models.scored(best, valid))


@query("ML7_ML8_saved_model_scoring")
def ml7(spark, sf):
    table = training_table(spark, sf)
    features, train, valid = prepared(table)
    path = scratch_path(spark, "model")
    models.save(models.fit_ensemble(small_members(), train, valid), features, {}, path, spark)
    from tapewatch.plans.scoring import score_table

    return score_table(spark, path, table.where("split = 'valid'"))


@query("ML9_train_and_evaluate")
def ml9(spark, sf):
    table = training_table(spark, sf)
    _, _, metrics = models.train_and_evaluate(table, training_columns(table), small_members())
    return metrics.select("method", "scope", "metric", "value")


@query("T6_feature_importance")
def t6(spark, sf):
    features, train, _ = inputs(spark, sf)
    return models.importances(models.fit(models.random_forest(TREES), train), features, spark)


@query("A20_learning_curve")
def a20(spark, sf):
    _, train, valid = inputs(spark, sf)
    return rounded(models.learning_curve(models.random_forest(TREES), train, valid, [0.25, 1.0]))


@query("ML_split_sizes", """
, y AS (SELECT trade_date, CASE WHEN regexp_matches(trade_date, '2024010|2024011') THEN 'train' WHEN regexp_matches(trade_date, '2024012|2024013') THEN 'valid' END AS split FROM tk)
SELECT split, count(*) AS rows, count(DISTINCT trade_date) AS days FROM y WHERE split IS NOT NULL GROUP BY split
""")
def split_sizes(spark, sf):
    table = training_table(spark, sf)
    assert set(KEYS) <= set(table.columns)
    return table.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("trade_date").alias("days"))
