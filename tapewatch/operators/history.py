"""Features from earlier rows of the same ticker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions.numbers import ratio
from tapewatch.functions.times import micros
from tapewatch.operators.ordered import (
    Groups,
    earlier_moments,
    join_on,
    last_known,
    measure_groups,
    running_totals,
    small_side,
    with_lookback,
)
from tapewatch.schemas import ROW_ORDER, TICKER_DAY

# Fixed value: keeps the reference's denominators away from zero.
TINY = 1e-8
HISTORY_ORDER = ("trade_date", *ROW_ORDER)


def arrival_gap_score(
    df: DataFrame, keys: Sequence[str] = TICKER_DAY, order: Sequence[str] = ROW_ORDER, groups: Groups | None = None
) -> DataFrame:
    """``z_survival``: the gap to the previous order against the gaps seen before it."""
    groups = groups or measure_groups(df, keys)

    def gaps(frame: DataFrame, partition: list[str]) -> DataFrame:
        us = micros(F.col("order_ts"))
        previous = F.lag(us).over(Window.partitionBy(*partition).orderBy(*order))
        return frame.withColumn("_gap", F.coalesce((us - previous) / F.lit(1000.0), F.lit(0.0)))

    with_gap = with_lookback(df, keys, order, 1, gaps, groups)
    stats = earlier_moments(with_gap, keys, order, {"_g": F.col("_gap")}, groups)
    z = (F.col("_gap") - F.coalesce("_g_mean", F.lit(0.0))) / (F.coalesce("_g_std", F.lit(1.0)) + TINY)
    return stats.withColumn("z_survival", z).select(*df.columns, "z_survival")


def row_changes(
    df: DataFrame, keys: Sequence[str] = TICKER_DAY, order: Sequence[str] = ROW_ORDER, groups: Groups | None = None
) -> DataFrame:
    """``price_momentum_100ms`` and ``spread_change``: relative change since the previous order."""

    def changes(frame: DataFrame, partition: list[str]) -> DataFrame:
        window = Window.partitionBy(*partition).orderBy(*order)

        def change(name: str) -> Column:
            before = F.lag(name).over(window)
            return ratio(F.col(name) - before, before + TINY)

        return frame.withColumns({"price_momentum_100ms": change("mid_price"), "spread_change": change("spread")})

    return with_lookback(df, keys, order, 1, changes, groups)


def trailing_deviation(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, tuple[str, int]] | None = None,
    order: Sequence[str] = HISTORY_ORDER,
    groups: Groups | None = None,
) -> DataFrame:
    """Sample deviation over the last rows including the current one; ``{out: (column, rows)}``."""
    columns = columns or {"price_volatility": ("mid_price", 100), "spread_volatility": ("spread", 50)}

    def deviations(frame: DataFrame, partition: list[str]) -> DataFrame:
        window = Window.partitionBy(*partition).orderBy(*order)
        return frame.withColumns(
            {out: F.stddev_samp(c).over(window.rowsBetween(1 - rows, 0)) for out, (c, rows) in columns.items()}
        )

    return with_lookback(df, keys, order, max(n for _, n in columns.values()) - 1, deviations, groups)


def momentum(
    df: DataFrame,
    keys: Sequence[str],
    rows: int = 5,
    order: Sequence[str] = HISTORY_ORDER,
    groups: Groups | None = None,
) -> DataFrame:
    """``price_momentum``: relative change of the mid price over ``rows`` rows, gaps filled forward."""
    groups = groups or measure_groups(df, keys)
    filled = last_known(df, keys, order, {"_mid": F.col("mid_price")}, groups)

    def change(frame: DataFrame, partition: list[str]) -> DataFrame:
        before = F.lag("_mid", rows).over(Window.partitionBy(*partition).orderBy(*order))
        return frame.withColumn("price_momentum", ratio(F.col("_mid"), before) - 1)

    return with_lookback(filled, keys, order, rows, change, groups).drop("_mid")


def earlier_means(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = HISTORY_ORDER, groups: Groups | None = None
) -> DataFrame:
    """``hist_order_size_mean`` and ``hist_spread_mean``: means over all earlier rows of the ticker."""
    named = {"hist_order_size": F.col("log_qty"), "hist_spread": F.col("spread")}
    return earlier_moments(df, keys, order, named, groups).drop("hist_order_size_std", "hist_spread_std")


def ranks(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("log_qty", "spread", "delta_mid"),
    groups: Groups | None = None,
) -> DataFrame:
    """``<column>_rank``: average rank within the group as a share of its non-null rows; null stays null."""
    groups = groups or measure_groups(df, keys)
    names = [f"{c}_rank" for c in columns]

    def plain(frame: DataFrame) -> DataFrame:
        added = {}
        for c in columns:
            by_value = Window.partitionBy(*keys).orderBy(F.col(c).asc_nulls_last())
            upto = F.count(c).over(by_value.rangeBetween(Window.unboundedPreceding, Window.currentRow))
            size = F.count(c).over(Window.partitionBy(*keys))
            added[f"{c}_rank"] = F.when(F.col(c).isNotNull(), (F.rank().over(by_value) + upto) / 2.0 / size)
        return frame.withColumns(added).select(*df.columns, *names)

    def large(frame: DataFrame) -> DataFrame:
        # ranks depend on the value only: count equal values, accumulate, look the rank up
        for c in columns:
            counted = frame.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_times"))
            upto = running_totals(counted, keys, [F.col(c)], {"_upto": F.col("_times")}, {"_size": "_upto"})
            mean_rank = F.col("_upto") - (F.col("_times") - 1) / 2.0
            shares = upto.select(*keys, c, (mean_rank / F.col("_size")).alias(f"{c}_rank"))
            frame = join_on(frame, shares, [*keys, c], "left")
        return frame.select(*df.columns, *names)

    return groups.each(df, plain, large)


def standard_scores(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("log_qty", "spread", "delta_mid")
) -> DataFrame:
    """``<column>_zscore``: distance from the group mean in sample deviations."""
    stats = df.groupBy(*keys).agg(
        *[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("std", F.stddev_samp))]
    )
    joined = join_on(df, small_side(stats), keys, "left")
    scores = {f"{c}_zscore": (F.col(c) - F.col(f"_avg_{c}")) / (F.col(f"_std_{c}") + TINY) for c in columns}
    return joined.withColumns(scores).select(*df.columns, *scores)
