"""Summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions import times
from tapewatch.operators.metrics import LABEL, SCORE, ranking_quality, scope_of, with_rates
from tapewatch.operators.ordered import exact_quantiles, small_side


def row_count() -> Column:
    return F.count(F.lit(1))


def rate(part: Column, whole: Column, scale: float = 1.0) -> Column:
    return F.try_divide(part * scale, whole)


def event_stream_summary(stream: DataFrame) -> DataFrame:
    """Tickers, orders and rows per day."""
    return stream.groupBy("trade_date").agg(
        F.count_distinct("ticker").alias("tickers"),
        F.count_distinct("order_id").alias("orders"),
        row_count().alias("rows"),
    )


def label_summary(labels: DataFrame, label: str = LABEL) -> DataFrame:
    """Samples, positives and their rate per day and in total; ``scope`` tells the total from a null day."""
    return labels.rollup("trade_date").agg(
        scope_of("trade_date"),
        row_count().alias("samples"),
        F.sum(label).alias("positives"),
        rate(F.sum(label), row_count()).alias("positive_rate"),
    )


def ticker_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(
        row_count().alias("samples"),
        F.sum(LABEL).alias("positives"),
        rate(F.sum(LABEL), row_count(), 100.0).alias("positive_pct"),
    )


def ticker_statistics_summary(df: DataFrame) -> DataFrame:
    """Means over tickers, for when there are too many to list."""
    return ticker_statistics(df).agg(
        row_count().alias("tickers"),
        F.avg("samples").alias("mean_samples"),
        F.avg("positives").alias("mean_positives"),
        F.avg("positive_pct").alias("mean_positive_pct"),
    )


def class_distribution(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    return df.groupBy(*by, LABEL).agg(row_count().alias("rows"))


def ticker_inventory(df: DataFrame, min_samples: int = 0) -> DataFrame:
    """Samples and share per ticker with at least ``min_samples`` rows."""
    counted = df.groupBy("ticker").agg(row_count().alias("samples")).where(F.col("samples") >= min_samples)
    total = counted.agg(F.sum("samples").alias("_total")).withColumn("_one", F.lit(1))
    shared = counted.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return shared.select("ticker", "samples", rate(F.col("samples"), F.col("_total"), 100.0).alias("share_pct"))


def inventory_summary(df: DataFrame, min_samples: int = 0) -> DataFrame:
    inventory = small_side(ticker_inventory(df, min_samples))
    middle = exact_quantiles(inventory, [], "samples", {"median_samples": 0.5}).withColumn("_one", F.lit(1))
    totals = inventory.agg(
        row_count().alias("tickers"), F.sum("samples").alias("rows"), F.avg("samples").alias("mean_samples")
    )
    return totals.withColumn("_one", F.lit(1)).join(F.broadcast(middle), "_one").drop("_one")


def with_time_parts(df: DataFrame, ts: str = "order_ts") -> DataFrame:
    at = F.col(ts)
    return df.withColumns({"hour": F.hour(at), "minute": F.minute(at), "period": times.trading_period(at)})


def _label_sums(labels: Sequence[str]) -> list[Column]:
    sums = [F.sum(c).alias(f"{c}_sum") for c in labels]
    return sums + [F.round(F.avg(c), 4).alias(f"{c}_mean") for c in labels]


def label_time_distribution(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows, sums and means of the labels by period and by hour, from one pass over the table.

    Hours are nested in periods only partly, so (period, hour) is counted once and both reports are
    read off that small table.
    """
    fine = with_time_parts(df).groupBy("period", "hour").agg(
        F.count("order_ts").alias("rows"),
        *[F.sum(c).alias(f"{c}_sum") for c in labels],
        *[F.count(c).alias(f"_{c}_known") for c in labels],
    )
    cells = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("period").alias("part")),
        F.struct(F.lit("hour").alias("kind"), F.col("hour").cast("string").alias("part")),
    )
    tall = fine.withColumn("_cell", F.explode(cells))
    return tall.groupBy(F.col("_cell.kind").alias("kind"), F.col("_cell.part").alias("part")).agg(
        F.sum("rows").alias("rows"),
        *[F.sum(f"{c}_sum").alias(f"{c}_sum") for c in labels],
        *[F.round(rate(F.sum(f"{c}_sum"), F.sum(f"_{c}_known")), 4).alias(f"{c}_mean") for c in labels],
    )


def window_rates(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows, positives and rate (%) in opening and in abnormal periods."""
    period = times.trading_period(F.col("order_ts"))
    kind = F.when(period.isin(*times.OPENING_PERIODS), "opening").when(
        period.isin(*times.ABNORMAL_PERIODS), "abnormal"
    )
    return (
        df.withColumn("window", kind)
        .where(F.col("window").isNotNull())
        .groupBy("window")
        .agg(
            row_count().alias("rows"),
            F.sum(label).alias("positives"),
            rate(F.sum(label), row_count(), 100.0).alias("positive_pct"),
        )
    )


def label_totals(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Time range of the table and positives per label, one row per label."""
    wide = df.agg(
        row_count().alias("samples"),
        F.min("order_ts").alias("first_order"),
        F.max("order_ts").alias("last_order"),
        *[F.sum(c).alias(c) for c in labels],
    )
    each = F.explode(F.create_map(*[x for c in labels for x in (F.lit(c), F.col(c))])).alias("label", "positives")
    tall = wide.select("samples", "first_order", "last_order", each)
    return tall.withColumn("positive_pct", rate(F.col("positives"), F.col("samples"), 100.0))


def positives_by_period(df: DataFrame, label: str = LABEL) -> DataFrame:
    marked = with_time_parts(df).where(F.col(label) == 1)
    return marked.groupBy("period").agg(row_count().alias("positives"))


def hourly_positive_rate(df: DataFrame, label: str = LABEL) -> DataFrame:
    hour = F.hour("order_ts").alias("hour")
    return df.groupBy(hour).agg((F.avg(label) * 100).alias("positive_pct"))


def ticker_metric_summary(metrics: DataFrame) -> DataFrame:
    """Per metric over tickers: mean, best and worst ticker, sample deviation. ``metrics`` is tall."""
    return metrics.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.max("value").alias("best"),
        F.min_by("ticker", F.struct(-F.col("value"), F.col("ticker"))).alias("best_ticker"),
        F.min("value").alias("worst"),
        F.min_by("ticker", F.struct(F.col("value"), F.col("ticker"))).alias("worst_ticker"),
        F.stddev_samp("value").alias("std"),
    )


def ticker_rates(confusion: DataFrame) -> DataFrame:
    return with_rates(confusion).drop("f1")


def prediction_summary(df: DataFrame, score: str = SCORE) -> DataFrame:
    """One row: counts, share of predicted positives and the spread of scores."""
    middle = exact_quantiles(df, [], score, {"median_proba": 0.5}).withColumn("_one", F.lit(1))
    totals = df.agg(
        row_count().alias("rows"),
        F.sum(LABEL).alias("positives"),
        F.sum("predicted_binary").alias("predicted_positives"),
        rate(F.sum("predicted_binary"), row_count(), 100.0).alias("predicted_pct"),
        F.min(score).alias("min_proba"),
        F.max(score).alias("max_proba"),
        F.avg(score).alias("mean_proba"),
        F.stddev_samp(score).alias("std_proba"),
    )
    return totals.withColumn("_one", F.lit(1)).join(F.broadcast(middle), "_one").drop("_one")


def prediction_summary_by_ticker(df: DataFrame, score: str = SCORE) -> DataFrame:
    return df.groupBy("ticker").agg(
        row_count().alias("rows"),
        F.sum(LABEL).alias("positives"),
        F.round(F.avg(score), 4).alias("mean_proba"),
        F.round(F.max(score), 4).alias("max_proba"),
        F.sum("predicted_binary").alias("predicted_positives"),
    )


def daily_summary(df: DataFrame, score: str = SCORE) -> DataFrame:
    """Counts, scores and anomaly rates per day."""
    return df.groupBy("trade_date").agg(
        row_count().alias("rows"),
        F.sum(LABEL).alias("positives"),
        F.round(F.avg(score), 4).alias("mean_proba"),
        F.round(F.max(score), 4).alias("max_proba"),
        F.round(F.stddev_samp(score), 4).alias("std_proba"),
        F.sum("predicted_binary").alias("predicted_positives"),
        rate(F.sum(LABEL), row_count()).alias("anomaly_rate"),
        rate(F.sum("predicted_binary"), row_count()).alias("pred_anomaly_rate"),
    )


def monthly_summary(df: DataFrame, score: str = SCORE) -> DataFrame:
    """Totals per month with averages and extremes over its days."""
    month = F.substring("trade_date", 1, 6)
    days = df.groupBy(month.alias("month"), "trade_date").agg(
        row_count().alias("rows"), F.sum(LABEL).alias("positives"), F.sum("predicted_binary").alias("predicted")
    )
    by_day = days.groupBy("month").agg(
        F.sum("rows").alias("rows"),
        F.sum("positives").alias("positives"),
        rate(F.sum("positives"), F.sum("rows"), 100.0).alias("anomaly_pct"),
        F.sum("predicted").alias("predicted_positives"),
        row_count().alias("trading_days"),
        F.avg("rows").alias("mean_daily_rows"),
        F.avg("positives").alias("mean_daily_positives"),
        F.max("positives").alias("max_daily_positives"),
        F.min("positives").alias("min_daily_positives"),
    )
    scores = df.groupBy(month.alias("month")).agg(
        F.avg(score).alias("mean_proba"), F.max(score).alias("max_proba"), F.stddev_samp(score).alias("std_proba")
    )
    return by_day.join(scores, "month")


def alert_counts(df: DataFrame, threshold: float = 0.5, score: str = SCORE) -> DataFrame:
    """True positives and scores above the threshold per ticker and day."""
    return df.groupBy("ticker", "trade_date").agg(
        row_count().alias("rows"),
        F.sum(LABEL).alias("positives"),
        F.count_if(F.col(score) > threshold).alias("alerts"),
    )


def quality_by_month(df: DataFrame, score: str = SCORE) -> DataFrame:
    """Samples, share of positives, PR-AUC and ROC-AUC per month."""
    monthly = df.withColumn("month", F.substring("trade_date", 1, 6))
    out = ranking_quality(monthly, ["month"], score)
    return out.withColumn("positive_pct", rate(F.col("positives"), F.col("samples"), 100.0))


def first_rows(df: DataFrame, columns: Sequence[str], order: Sequence[str], n: int = 1000) -> DataFrame:
    """The first n rows by ``order``: a readable sample for a report."""
    return df.select(*columns).orderBy(*order).limit(n)
