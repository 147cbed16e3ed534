"""Counts that tell whether a table can be trusted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.times import in_trading_hours, micros
from tapewatch.operators.features import sanitised
from tapewatch.operators.leakage import require_columns, risk_table
from tapewatch.operators.ordered import quantiles_of_columns, running_totals
from tapewatch.schemas import FEATURE_THEMES, KEYS, TICKER_DAY

LOT = 100
STRONG_CORRELATION = 0.8
WHISKER = 1.5


def _pair_counts(orders: DataFrame, events: DataFrame) -> DataFrame:
    """Per key: (order, event) pairs, those with the event first, those with the order in trading hours.

    Pairs are counted, never produced. Keys with one order, the rule, meet each event once. Keys with
    several orders are counted along their common timeline.
    """
    in_hours = F.when(in_trading_hours(F.col("order_ts")), 1).otherwise(0)
    per_key = orders.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(in_hours).alias("orders_in_hours"), F.min("order_ts").alias("order_ts")
    )
    early = F.when(F.col("event_ts") < F.col("order_ts"), 1).otherwise(0)
    counted = events.join(per_key, list(KEYS), "inner").groupBy(*KEYS, "orders", "orders_in_hours").agg(
        F.count(F.lit(1)).alias("events"), F.sum(early).alias("early")
    )
    several = per_key.where(F.col("orders") > 1).select(*KEYS)
    marks = [
        orders.select(*KEYS, micros(F.col("order_ts")).alias("us"), F.lit(0).alias("turn")),
        events.select(*KEYS, micros(F.col("event_ts")).alias("us"), F.lit(1).alias("turn")),
    ]
    line = (
        marks[0].unionByName(marks[1]).join(several, list(KEYS), "left_semi")
        .groupBy(*KEYS, "us", "turn").agg(F.count(F.lit(1)).alias("n"))
    )
    ahead = running_totals(
        line, KEYS, [F.col("us"), F.col("turn")], {"events_ahead": F.when(F.col("turn") == 1, F.col("n")).otherwise(0)}
    )
    early_pairs = ahead.where("turn = 0").groupBy(*KEYS).agg(F.sum(F.col("n") * F.col("events_ahead")).alias("early_pairs"))
    return counted.join(early_pairs, list(KEYS), "left").select(
        *KEYS,
        (F.col("orders") * F.col("events")).alias("pairs"),
        F.coalesce("early_pairs", "early").alias("negative"),
        (F.col("orders_in_hours") * F.col("events")).alias("in_hours"),
    )


def stream_counters(orders: DataFrame, events: DataFrame) -> DataFrame:
    """Per ticker-day: joined rows, negative survivals, duplicate rows, share in trading hours, and
    events without an order."""
    valid_events = events.where(F.col("event_ts").isNotNull())
    valid_orders = orders.where(F.col("order_ts").isNotNull())
    joined = _pair_counts(valid_orders, valid_events).groupBy(*TICKER_DAY).agg(
        F.sum("pairs").alias("joined_rows"),
        F.sum("negative").alias("negative_survival"),
        F.sum(F.col("pairs") - 1).alias("duplicate_rows"),
        F.sum("in_hours").alias("rows_in_hours"),
    )
    known = orders.select(*KEYS).distinct()
    unmatched = (
        events.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("events"))
        .join(known, list(KEYS), "left_anti")
        .groupBy(*TICKER_DAY)
        .agg(F.sum("events").alias("unmatched_events"))
    )
    out = joined.unionByName(unmatched, allowMissingColumns=True)
    counters = ("joined_rows", "negative_survival", "duplicate_rows", "rows_in_hours", "unmatched_events")
    filled = out.groupBy(*TICKER_DAY).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])
    return filled.withColumn("kept_share", F.try_divide(F.col("rows_in_hours"), F.col("joined_rows")))


def date_mismatches(raw_orders: DataFrame) -> DataFrame:
    """Rows whose own date differs from their folder's, per ticker-day."""
    differs = ~F.col("date").eqNullSafe(F.col("trade_date"))
    return raw_orders.groupBy(*TICKER_DAY).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(differs).alias("mismatched_rows")
    )


def order_checks(df: DataFrame, lot: int = LOT) -> DataFrame:
    """Implausible prices and odd lots per ticker-day."""
    bad_price = F.col("order_price").isNull() | (F.col("order_price") <= 0)
    odd_lot = F.col("order_qty").isNull() | (F.pmod(F.col("order_qty"), F.lit(float(lot))) != 0)
    return df.groupBy(*TICKER_DAY).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad_price).alias("bad_prices"),
        F.count_if(odd_lot).alias("odd_lots"),
    )


def plausible_orders(df: DataFrame, lot: int = LOT) -> DataFrame:
    """Orders with a positive price and a quantity in whole lots."""
    return df.where((F.col("order_price") > 0) & (F.pmod(F.col("order_qty"), F.lit(float(lot))) == 0))


def undecodable_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and, per column, values holding the replacement character of a failed decoding."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.contains(F.col(c), F.lit("�"))).alias(c) for c in columns],
    )


def checked_input(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, columns)
    if df.isEmpty():
        raise ValueError("no rows")
    return df


def feature_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: rows, missing share, outlier share (outside 1.5 interquartile ranges), leakage risk.

    All features are measured row by row: nothing but their quartiles' neighbourhoods is told apart or sorted.
    """
    quartiles = {r["feature"]: r for r in quantiles_of_columns(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}).collect()}
    measures = []
    for c in columns:
        value, found = F.col(c).cast("double"), quartiles.get(c)
        outside = F.lit(False)
        if found is not None:
            reach = WHISKER * (found["q3"] - found["q1"])
            outside = (value < found["q1"] - reach) | (value > found["q3"] + reach)
        measures.append(F.struct(
            F.lit(c).alias("feature"),
            F.count(F.lit(1)).alias("rows"),
            F.try_divide(F.count_if(value.isNull()) * 100.0, F.count(F.lit(1))).alias("missing_pct"),
            F.try_divide(F.count_if(outside) * 100.0, F.count(F.lit(1))).alias("outlier_pct"),
            F.lit(found["median"] if found is not None else None).cast("double").alias("median"),
        ))
    counted = df.agg(F.array(*measures).alias("_measures")).select(F.explode("_measures").alias("_m")).select("_m.*")
    return counted.join(F.broadcast(risk_table(df.sparkSession, columns)), "feature", "left")


def theme_profile(df: DataFrame, themes: dict[str, Sequence[str]] = FEATURE_THEMES) -> DataFrame:
    """Per theme of features: how many of them the table has, and the share of their values that is missing."""
    present = {theme: [c for c in columns if c in df.columns] for theme, columns in themes.items()}
    measures = [
        F.struct(
            F.lit(theme).alias("theme"),
            F.lit(len(columns)).cast("long").alias("features"),
            F.try_divide(sum((F.count_if(F.col(c).isNull()) for c in columns[1:]), F.count_if(F.col(columns[0]).isNull())) * 100.0, F.count(F.lit(1)) * len(columns)).alias("missing_pct"),
        )
        for theme, columns in present.items()
        if columns
    ]
    return df.agg(F.array(*measures).alias("_measures")).select(F.explode("_measures").alias("_m")).select("_m.*")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of features (missing values count as 0)."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(sanitised(df.select(*columns)))
    matrix = Correlation.corr(vectors, "_v").first()[0].toArray()
    pairs = [(a, b, float(matrix[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return df.sparkSession.createDataFrame(pairs, "feature string, other string, correlation double")


def strong_correlations(df: DataFrame, columns: Sequence[str], above: float = STRONG_CORRELATION) -> DataFrame:
    return correlations(df, columns).where(F.abs("correlation") > above)


def daily_stability(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, deviation and missing share of each feature per day."""
    tall = df.select("trade_date", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "value"))
    return tall.groupBy("trade_date", "feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        (F.count_if(F.col("value").isNull()) * 100.0 / F.count(F.lit(1))).alias("missing_pct"),
    )
