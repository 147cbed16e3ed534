"""Score stored features with a stored model and summarise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.operators.selection import features_with_labels, with_target
from tapewatch.plans import models, reports, stages
from tapewatch.plans.training import model_table
from tapewatch.schemas import KEYS, TICKER_DAY
from tapewatch.session import configure, staged
from tapewatch.sources import tables


def score_table(
    spark: SparkSession, model_path: str, table: DataFrame, threshold: float = 0.5, fill_absent: bool = False
) -> DataFrame:
    """Scores of a table that has all features of the model; with ``fill_absent`` missing ones count as 0."""
    ensemble, features, _ = models.load(model_path, spark)
    data = models.model_input(table, features, (*KEYS, "order_ts"), fill_absent)
    return models.predictions(ensemble.score(data), threshold)


def run_scoring(
    spark: SparkSession,
    model_path: str,
    data_root: str,
    out: str,
    dates: Sequence[str] = (),
    label: str = "y_label",
    stream_path: str | None = None,
) -> dict[str, DataFrame]:
    """Features are enriched as in training. Predictions are written once; the summaries read them back."""
    configure(spark)
    features = tables.read_features(spark, data_root, dates=dates)
    labels = tables.read_labels(spark, data_root, dates=dates)
    stream = tables.read_table(spark, stream_path, dates=dates) if stream_path else None
    table = model_table(with_target(features_with_labels(features, labels), label), stream, ["ticker"])
    tables.write_daily(score_table(spark, model_path, table), out)
    return summaries(tables.read_predictions(spark, out, dates=dates))


def summaries(done: DataFrame) -> dict[str, DataFrame]:
    return {
        "summary": reports.prediction_summary(done),
        "by_ticker": reports.prediction_summary_by_ticker(done),
        "daily": reports.daily_summary(done),
        "monthly": reports.monthly_summary(done),
        "alerts": reports.alert_counts(done),
    }


def run_daily_scoring(
    spark: SparkSession,
    model_path: str,
    data_root: str,
    out: str,
    state_path: str,
    dates: Sequence[str],
    label: str = "y_label",
    stream_path: str | None = None,
    replace_later: bool = False,
) -> dict[str, DataFrame]:
    """Score ``dates`` with the tickers' whole histories, reading no day before the stored state.

    ``state_path`` holds one table of one row per ticker for each run, as of its last day. A run continues from the newest one
    before its first day, carries every stored day since, scores those asked for, and writes the state as of its
    last day. Without an earlier state the whole history is read once. A run repeated after a failure, or because its
    days changed, gives the same files; if states of later days exist, they rest on what is being replaced, so it needs
    ``replace_later``, takes them away, and the later days are to be scored anew. Ranks and standard scores compare the orders of
    a ticker-day: those of longer spans would change with every new day.
    """
    configure(spark)
    first, last = min(dates), max(dates)
    known = tables.state_days(spark, state_path)
    if known and max(known) > last and not replace_later:
        raise ValueError(f"states after {last} rest on the days to be scored; they need replace_later")
    earlier = max((day for day in known if day < first), default=None)
    state = tables.read_state(spark, state_path, earlier) if earlier else None

    def since(frame: DataFrame) -> DataFrame:
        after = frame.where(F.col("trade_date") <= last)
        return after.where(F.col("trade_date") > earlier) if earlier else after

    features, labels = since(tables.read_features(spark, data_root)), since(tables.read_labels(spark, data_root))
    joined = with_target(features_with_labels(features, labels), label)
    if stream_path:
        joined = stages.with_recent_cancels(joined, since(tables.read_table(spark, stream_path)))
    # counted, summarised and windowed below: written once
    table, history = stages.enriched_from(staged(joined), state, ["ticker"], TICKER_DAY)
    tables.write_daily(score_table(spark, model_path, table.where(F.col("trade_date").isin(list(dates)))), out)
    tables.write_state(history.state(), state_path, last, stale=[day for day in known if day >= first and day != last])
    return summaries(tables.read_predictions(spark, out, dates=dates))
