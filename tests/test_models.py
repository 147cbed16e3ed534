"""Learners, ensembles and their storage."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewatch.functions.numbers import sigmoid
from tapewatch.operators import metrics as m
from tapewatch.plans import models


@pytest.fixture(scope="module")
def table(spark):
    n = F.col("id")
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    df = spark.range(1200).select(
        F.lit("20250303").alias("trade_date"), F.concat(F.lit("T"), (n % 3).cast("string")).alias("ticker"), n.cast("string").alias("order_id"),
        F.timestamp_micros(n * 1000).cast("timestamp_ntz").alias("order_ts"),
        noise.alias("signal"), (n % 17 / 17.0).alias("other"),
        F.when(noise > 0.9, 1).otherwise(0).alias("y_label"), F.when(n % 4 == 0, "valid").otherwise("train").alias("split"),
    )
    return df


FEATURES = ["signal", "other", "absent"]


def test_ensemble_learns_and_survives_storage(spark, table, tmp_path):
    members = {"boosted": models.boosted_trees(4), "forest": models.random_forest(8, leaf_rows=2), "linear": models.linear_member()}
    ensemble, scored, metrics = models.train_and_evaluate(table, FEATURES, members, sampling="under", class_weight=True, fill_absent=True)
    assert sum(ensemble.weights.values()) == pytest.approx(1.0)
    values = {r.metric: r.value for r in metrics.collect()}
    assert values["PR-AUC"] > 0.9 and values["ROC-AUC"] > 0.95
    assert values["valid_samples"] == 300 and values["n_features"] == 3
    models.save(ensemble, FEATURES, {"PR-AUC": values["PR-AUC"]}, str(tmp_path / "model"), spark)
    again, features, kept = models.load(str(tmp_path / "model"), spark)
    assert features == FEATURES and kept["PR-AUC"] == values["PR-AUC"]
    data = models.model_input(table.where("split = 'valid'"), features, fill_absent=True)
    both = models.predictions(again.score(data)).join(scored.select("order_id", F.col("predicted_proba").alias("before")), "order_id")
    assert both.where(F.abs(F.col("predicted_proba") - F.col("before")) > 1e-9).count() == 0 and both.count() == 300


def test_weights_follow_quality():
    assert models.quality_weights({"a": 0.3, "b": 0.1}) == pytest.approx({"a": 0.75, "b": 0.25})
    assert models.quality_weights({"a": None, "b": 0.0}) == {"a": 0.5, "b": 0.5}


def test_search_prefers_average_precision(spark, table):
    data = models.model_input(table, FEATURES, fill_absent=True)
    best = models.search(models.boosted_trees(2), {"maxDepth": [1, 3]}, data, data, trials=2)
    assert models.AveragePrecision().evaluate(best.transform(data)) > 0.9


def test_importance_names_the_signal(spark, table):
    data = models.model_input(table, FEATURES, fill_absent=True)
    top = models.importances(models.fit(models.random_forest(5, leaf_rows=2), data), FEATURES, spark).first()
    assert top.feature == "signal"


def test_early_stopping_rows_are_repeatable(table):
    once, twice = (models.with_held_out(table).where(models.VALIDATION_FLAG).count() for _ in range(2))
    assert once == twice and 60 < once < 180


def test_learning_curve_grows(spark, table):
    data = models.model_input(table, FEATURES, fill_absent=True)
    curve = models.learning_curve(models.random_forest(3, leaf_rows=2), data, data, [0.3, 1.0]).orderBy("share").collect()
    assert curve[0].train_rows < curve[1].train_rows == 1200


def test_focal_loss_of_certain_scores(spark):
    df = spark.createDataFrame(pd.DataFrame({"predicted_proba": [1.0, 0.0, 0.5], "y_label": [1, 0, 1]}))
    assert models.mean_focal_loss(df).first().focal_loss == pytest.approx(0.25 * 0.25 * 0.693147 / 3, rel=1e-4)
    assert df.select(sigmoid(F.lit(0.0)).alias("x")).first().x == 0.5
    assert m.confusion(df).first().asDict() == {"tn": 1, "fp": 0, "fn": 1, "tp": 1}


def test_absent_features_are_not_filled_silently(table):
    with pytest.raises(ValueError, match="absent"):
        models.model_input(table, FEATURES)


def test_training_and_scoring_share_the_enrichment(spark, tmp_path):
    from tapewatch.plans import stages, training
    from tapewatch.plans.scoring import run_scoring
    from tapewatch.sources import tables
    from tests.test_properties import flow, to_spark

    frames = []
    for day, seed in (("20250303", 1), ("20250304", 2), ("20250502", 3)):
        frame = flow(seed, 90)
        frame["trade_date"] = day
        for c in ("bid1", "ask1", "prev_close"):
            frame[c] = frame.order_price + {"bid1": -0.1, "ask1": 0.1, "prev_close": 0.5}[c]
        frame["bid_vol1"], frame["ask_vol1"], frame["survival_ms"] = 100.0, 200.0, 20.0
        frames.append(frame.drop(columns=["mid_price", "spread", "log_qty"]))
    stream = to_spark(spark, pd.concat(frames, ignore_index=True)).withColumn("order_type", F.lit("0"))
    root = str(tmp_path)
    tables.write_daily(stream, f"{root}/stream")
    tables.write_daily(stages.features(stream), f"{root}/features")
    large = F.when(F.col("order_qty") > 400, 1).otherwise(0)
    tables.write_daily(stages.labels(stream).withColumn("y_label", large), f"{root}/labels")
    members = {"forest": models.random_forest(3, leaf_rows=1), "boosted": models.boosted_trees(2)}
    found = training.run_training(spark, root, f"{root}/out", members, f"{root}/stream", sampling="none")
    scopes = {r["scope"] for r in tables.read_metrics(spark, f"{root}/out/metrics").collect()}
    assert scopes == {"overall", "ticker"} and found["importances"].select("member").distinct().count() == 2
    named = {r["feature"] for r in found["importances"].collect()}
    assert {"orders_cancels_ratio", "log_qty_rank", "hist_spread_mean"} <= named
    scored = run_scoring(spark, f"{root}/out/model", root, f"{root}/scored", dates=["20250502"], stream_path=f"{root}/stream")
    assert scored["summary"].count() > 0
    both = tables.read_predictions(spark, f"{root}/scored").select("order_id", F.col("predicted_proba").alias("again"))
    pairs = found["predictions"].join(both, "order_id")
    assert pairs.count() == 90 and pairs.where("abs(predicted_proba - again) > 1e-9").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_are_made_once_for_all_metrics(table):
    members = {"boosted": models.boosted_trees(1), "linear": models.linear_member()}
    _, scored, _ = models.train_and_evaluate(table, FEATURES, members, sampling="none", fill_absent=True)
    assert "UDF" not in plan_of(scored) and scored.count() == 300


def test_training_queries_build_table_and_vectors_once(spark, table, monkeypatch):
    from queries import training

    built = []
    monkeypatch.setattr(training, "training_table", lambda *_: built.append(1) or table)
    monkeypatch.setattr(training, "training_columns", lambda _: FEATURES[:2])
    monkeypatch.setattr(training, "small_members", lambda: {"boosted": models.boosted_trees(1), "linear": models.linear_member()})
    _, train, valid = training.inputs(spark, "")
    assert "UDF" not in plan_of(train) + plan_of(valid) and (train.count(), valid.count()) == (900, 300)
    built.clear()
    assert training.ml7(spark, "").count() == 300 and len(built) == 1


def test_search_query_fits_all_rounds(spark, table, monkeypatch):
    """Every option of the grid is fitted with the rounds that are the learner's own."""
    from queries import training

    fitted, fit = [], models.fit
    monkeypatch.setattr(training, "inputs", lambda *_: (FEATURES[:2], *(models.model_input(table.where(F.col("split") == s), FEATURES[:2]) for s in ("train", "valid"))))
    monkeypatch.setattr(models, "fit", lambda e, data: fitted.append((e.getMaxIter(), e.getMaxDepth(), e.getStepSize())) or fit(e.copy({e.maxIter: 1}), data))
    assert training.ml6(spark, "").count() == 300
    assert sorted(fitted) == [(100, depth, rate) for depth in (3, 5) for rate in (0.05, 0.1)]


def test_trials_at_once_change_nothing(spark, table):
    """The best trial is kept, of equal ones the first, whichever ends first."""
    data = models.model_input(table, FEATURES, fill_absent=True)
    grid = {"maxDepth": [1, 3], "maxIter": [1, 2]}
    found = [models.search(models.boosted_trees(2), grid, data, data, at_once=n).stages[-1].toDebugString.partition("\n")[2] for n in (1, 4)]
    assert found[0] == found[1]
