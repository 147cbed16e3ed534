"""Choosing tickers, dates, targets and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.operators.ordered import join_on, running_totals, small_side
from tapewatch.schemas import KEYS, TARGET_LABELS
from tapewatch.session import staged

# Fixed value: negatives kept per positive.
NEGATIVES_PER_POSITIVE = 10


def with_tickers(df: DataFrame, tickers: DataFrame) -> DataFrame:
    """Rows whose ticker is listed; ``tickers`` has a ``ticker`` column."""
    return join_on(df, small_side(tickers.select("ticker").distinct()), ["ticker"], "left_semi")


def without_tickers(df: DataFrame, tickers: DataFrame) -> DataFrame:
    return join_on(df, small_side(tickers.select("ticker").distinct()), ["ticker"], "left_anti")


def not_found(wanted: DataFrame, df: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Requested keys without any row."""
    return wanted.select(*keys).distinct().join(df.select(*keys).distinct(), list(keys), "left_anti")


def top_tickers(df: DataFrame, n: int, by: str = "volume") -> DataFrame:
    """The n tickers with the largest volume, most rows, or most positives; ties by name."""
    rows = df.where(F.col("y_label") == 1) if by == "positives" else df
    measure = F.sum("log_qty") if by == "volume" else F.count(F.lit(1))
    ranked = rows.groupBy("ticker").agg(measure.alias("measure"))
    return ranked.orderBy(F.col("measure").desc(), "ticker").limit(n)


def random_tickers(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n tickers in hash order: random with respect to the data, the same on every run."""
    names = df.select("ticker").distinct()
    return names.orderBy(F.xxhash64("ticker", F.lit(seed)), "ticker").limit(n)


def with_split(df: DataFrame, train: str = "202503|202504", valid: str = "202505") -> DataFrame:
    """``split``: train or valid by date pattern; rows of neither are dropped."""
    split = F.when(F.col("trade_date").rlike(train), "train").when(F.col("trade_date").rlike(valid), "valid")
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def with_target(df: DataFrame, label: str = "y_label") -> DataFrame:
    if label not in df.columns:
        known = [c for c in TARGET_LABELS if c in df.columns]
        raise ValueError(f"no label column {label}; available: {', '.join(known)}")
    return df if label == "y_label" else df.withColumn("y_label", F.col(label))


def features_with_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Equi-join on the keys; of columns on both sides the feature table's are kept."""
    extra = [c for c in labels.columns if c not in features.columns]
    return features.join(labels.select(*KEYS, *extra), list(KEYS), "inner")


def class_weights(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Counts per class and the weight of positives, negatives per positive."""
    positives = F.sum(F.when(F.col("y_label") == 1, 1).otherwise(0))
    counted = df.groupBy(*groups).agg(positives.alias("positives"), F.count(F.lit(1)).alias("samples"))
    negatives = F.col("samples") - F.col("positives")
    return counted.withColumns(
        {"negatives": negatives, "positive_weight": F.try_divide(negatives.cast("double"), F.col("positives"))}
    )


def under_sample(
    df: DataFrame,
    ratio: int = NEGATIVES_PER_POSITIVE,
    by: Sequence[str] = (),
    seed: int = 42,
    ids: Sequence[str] = KEYS,
) -> DataFrame:
    """All positives and exactly ``ratio`` negatives per positive (or all, if fewer), without replacement.

    With ``by`` the quota holds per group, and groups lacking a class are dropped. Negatives are
    taken in order of a hash of their ids. The hash value of the last one taken is found first, so
    the table itself is only filtered, never sorted or shuffled.
    """
    if not by:
        whole = df.withColumn("_all", F.lit(0))
        return _sampled(whole, ratio, ["_all"], seed, ids, drop_one_sided=False).drop("_all")
    return _sampled(df, ratio, list(by), seed, ids, drop_one_sided=True)


def _sampled(
    df: DataFrame, ratio: int, by: list[str], seed: int, ids: Sequence[str], drop_one_sided: bool
) -> DataFrame:
    is_positive = F.coalesce(F.col("y_label") == 1, F.lit(False))
    lot = F.xxhash64(*ids, F.lit(seed))
    # 4096 equal slices of the hash range, in the order of the (signed) hash
    slot = F.shiftright(lot, 52)

    histogram = df.groupBy(*by, F.when(~is_positive, slot).alias("_slot")).agg(F.count(F.lit(1)).alias("_rows"))
    histogram = staged(histogram)
    counts = histogram.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("_slot").isNull(), F.col("_rows"))), F.lit(0)).alias("_positives"),
        F.coalesce(F.sum(F.when(F.col("_slot").isNotNull(), F.col("_rows"))), F.lit(0)).alias("_negatives"),
    )
    if drop_one_sided:
        counts = counts.where((F.col("_positives") > 0) & (F.col("_negatives") > 0))
    quotas = counts.withColumn("_quota", F.least(F.col("_positives") * ratio, F.col("_negatives")))

    upto = F.sum("_rows").over(
        Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    slots = histogram.where(F.col("_slot").isNotNull()).withColumn("_upto", upto)
    reached = join_on(slots, quotas, by, "inner").where(
        (F.col("_quota") > 0) & (F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_rows") < F.col("_quota"))
    )
    edges = small_side(
        reached.select(*by, F.col("_slot").alias("_edge"), (F.col("_quota") - F.col("_upto") + F.col("_rows")).alias("_take"))
    )
    edge_rows = join_on(
        df.where(~is_positive).select(*by, *[c for c in ids if c not in by], lot.alias("_lot"), slot.alias("_slot")),
        edges,
        by,
        "inner",
    ).where(F.col("_slot") == F.col("_edge"))
    place = [F.col("_lot"), *[F.col(c) for c in ids if c not in by]]
    last_taken = running_totals(edge_rows, by, place, {"_place": F.lit(1)}).where(F.col("_place") == F.col("_take"))
    drawn = F.struct(F.col("_lot"), *[F.col(c) for c in ids])
    limits = last_taken.select(*by, drawn.alias("_last"))
    decided = small_side(join_on(quotas.select(*by, "_quota"), limits, by, "left"))

    mine = F.struct(lot.alias("_lot"), *[F.col(c) for c in ids])
    kept = join_on(df, decided, by, "inner").where(
        is_positive | ((F.col("_quota") > 0) & F.coalesce(mine <= F.col("_last"), F.lit(False)))
    )
    return kept.select(*df.columns)


def approximate_under_sample(df: DataFrame, ratio: int = NEGATIVES_PER_POSITIVE, seed: int = 42) -> DataFrame:
    """About ``ratio`` negatives per positive in one pass without any ordering."""
    row = class_weights(df).first()
    weight = row["positive_weight"] or 0.0
    share = min(1.0, ratio / weight) if weight else 0.0
    return df.where((F.col("y_label") == 1) | (F.rand(seed) < share))


def text_list(df: DataFrame, column: str = "value") -> DataFrame:
    """Non-empty trimmed lines as tickers."""
    name: Column = F.trim(F.col(column))
    return df.select(name.alias("ticker")).where(F.length("ticker") > 0)
