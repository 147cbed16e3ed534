"""From stored features and labels to a stored ensemble with its metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.operators import metrics as m
from tapewatch.operators.leakage import training_columns
from tapewatch.operators.selection import features_with_labels, with_split, with_target, with_tickers
from tapewatch.plans import models, stages
from tapewatch.schemas import ENRICHED_FEATURES, KEYS
from tapewatch.session import configure, staged
from tapewatch.sources import tables

MODEL_FEATURES = tuple(c for c in ENRICHED_FEATURES if c != "between_quotes")


def model_table(features: DataFrame, stream: DataFrame | None, by: Sequence[str], within: Sequence[str] | None = None) -> DataFrame:
    """Stored features as a model sees them, in training and in scoring: recent cancels and enrichment."""
    counted = stages.with_recent_cancels(features, stream) if stream is not None else features
    return stages.enriched(counted, by, within)


def run_training(
    spark: SparkSession,
    data_root: str,
    out: str,
    estimators: dict[str, Estimator],
    stream_path: str | None = None,
    label: str = "y_label",
    train: str = "202503|202504",
    valid: str = "202505",
    tickers: DataFrame | None = None,
    sampling: str = "stratified",
    method: str = "ensemble",
    within: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Fit on the training days and evaluate on the validation days, overall and per ticker.

    History features never cross the split. Ranks and standard scores compare the rows of a split's ticker, or of ``within``:
    a model for daily scoring is trained with ticker-days. Below ``out``: the model, the predictions and the metrics of
    all runs. Returns the metrics of this run, the predictions, and the importances of tree members.
    """
    configure(spark)
    joined = features_with_labels(tables.read_features(spark, data_root), tables.read_labels(spark, data_root))
    chosen = with_tickers(joined, tickers) if tickers is not None else joined
    table = with_split(with_target(chosen, label), train, valid)
    stream = tables.read_table(spark, stream_path) if stream_path else None
    table = staged(model_table(table, stream, ["split", "ticker"], within))
    features = training_columns(table, more=[c for c in MODEL_FEATURES if c in table.columns])

    ensemble, predictions, metrics = models.train_and_evaluate(table, features, estimators, sampling, method=method)
    predictions = staged(predictions)
    metrics = staged(metrics)
    by_ticker = m.evaluation(predictions, KEYS, ["ticker"]).select(
        F.lit(metrics.first()["run_ts"]).alias("run_ts"),
        F.lit(method).alias("method"), F.lit("ticker").alias("scope"), "ticker", "metric", "value",
    )
    root = out.rstrip("/")
    overall = {r["metric"]: r["value"] for r in metrics.collect()}
    models.save(ensemble, features, overall, f"{root}/model", spark)
    tables.write_daily(predictions, f"{root}/predictions")
    for rows in (metrics, by_ticker):
        tables.append_metrics(rows, f"{root}/metrics")
    trees = {n: x for n, x in ensemble.members.items() if hasattr(x.stages[-1], "featureImportances")}
    listed = [models.importances(x, features, spark, len(features)).withColumn("member", F.lit(n)) for n, x in trees.items()]
    found = {"metrics": tables.latest_run(tables.read_metrics(spark, f"{root}/metrics")), "predictions": predictions}
    for rows in listed:
        found["importances"] = found["importances"].unionByName(rows) if "importances" in found else rows
    return found
