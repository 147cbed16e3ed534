"""Rules that mark suspicious orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.times import flag, in_opening, in_volatile_period
from tapewatch.operators.ordered import exact_quantiles, join_on, small_side
from tapewatch.schemas import PATTERN_LABELS, TICKER_DAY

# Default thresholds of the rules.
FAST_CANCEL_MS = 50
DISPLACED_MS = 1000
DISPLACED_SPREADS = 4.0
OPENING_SPREADS = 0.5
SIZE_QUANTILES = {"p90": 0.90, "p95": 0.95, "p98": 0.98}


def fast_cancel(limit_ms: float = FAST_CANCEL_MS) -> Column:
    met = (F.col("survival_ms") < limit_ms) & (F.col("event_type") == "cancel")
    return F.coalesce(met, F.lit(False))


def displaced_price(limit_ms: float = DISPLACED_MS, spreads: float = DISPLACED_SPREADS) -> Column:
    """Short-lived and far from the middle; never with an unknown or zero spread."""
    far = (F.col("spread") != 0) & (F.abs("delta_mid") >= F.lit(spreads) * F.col("spread"))
    return F.coalesce((F.col("survival_ms") < limit_ms) & far, F.lit(False))


def with_base_labels(
    df: DataFrame,
    r1_ms: float = FAST_CANCEL_MS,
    r2_ms: float = DISPLACED_MS,
    r2_mult: float = DISPLACED_SPREADS,
) -> DataFrame:
    """Both basic rules and their conjunction; without book columns the first rule stands alone."""
    flagged = df.withColumn("flag_R1", fast_cancel(r1_ms))
    if {"delta_mid", "spread"} <= set(df.columns):
        flagged = flagged.withColumn("flag_R2", displaced_price(r2_ms, r2_mult))
        return flagged.withColumn("y_label", flag(F.col("flag_R1") & F.col("flag_R2")))
    return flagged.withColumns({"flag_R2": F.lit(False), "y_label": flag(F.col("flag_R1"))})


def size_quantiles(df: DataFrame, keys=TICKER_DAY) -> DataFrame:
    """Exact order-size quantiles per ticker and day, all in one pass."""
    return exact_quantiles(df, list(keys), "order_qty", SIZE_QUANTILES)


def with_size_quantiles(df: DataFrame, keys=TICKER_DAY) -> DataFrame:
    return join_on(df, small_side(size_quantiles(df, keys)), list(keys), "left")


def outsized() -> Column:
    return flag(F.col("order_qty") > F.col("p90"))


def aggressive(timed: bool = True) -> Column:
    """Buying above the ask or selling below the bid, by a margin during the opening."""
    price, bid, ask = F.col("order_price"), F.col("bid1"), F.col("ask1")
    margin = F.lit(OPENING_SPREADS) * F.col("spread")
    buying, selling = F.col("side") == "B", F.col("side") == "S"
    crossing = (buying & (price > ask)) | (selling & (price < bid))
    if not timed:
        return flag(crossing)
    clearly = (buying & (price > ask + margin)) | (selling & (price < bid - margin))
    return F.when(in_opening(F.col("order_ts")), flag(clearly)).otherwise(flag(crossing))


def large_outside_opening(timed: bool = True) -> Column:
    if not timed:
        return flag(F.col("order_qty") > F.col("p98"))
    return flag(~in_opening(F.col("order_ts")) & (F.col("order_qty") > F.col("p95")))


def large_in_volatile_period() -> Column:
    return flag(in_volatile_period(F.col("order_ts")) & (F.col("order_qty") > F.col("p90")))


def composite_labels(with_y: bool = True) -> dict[str, Column]:
    """Labels by how many of the four patterns an order shows."""
    shown = sum((F.col(c) for c in PATTERN_LABELS[1:]), F.col(PATTERN_LABELS[0]))
    labelled = F.col("y_label") == 1 if with_y else F.lit(False)
    return {
        "enhanced_spoofing_conservative": flag(shown >= 2),
        "enhanced_spoofing_moderate": flag(shown >= 2),
        "enhanced_spoofing_liberal": flag(labelled | (shown >= 2)) if with_y else flag(shown >= 1),
        "enhanced_spoofing_strict": flag(shown >= 3),
        "enhanced_combined": flag(labelled | (shown >= 2)),
    }


def with_extended_labels(df: DataFrame, keys=TICKER_DAY) -> DataFrame:
    timed = "order_ts" in df.columns
    sized = with_size_quantiles(df, keys)
    patterns = {
        "extreme_price_deviation": outsized(),
        "aggressive_pricing": aggressive(timed),
        "abnormal_large_order": large_outside_opening(timed),
        "volatile_period_anomaly": large_in_volatile_period() if timed else F.lit(0),
    }
    return sized.withColumns(patterns).withColumns(composite_labels("y_label" in df.columns)).drop(*SIZE_QUANTILES)


def label_orders(
    df: DataFrame,
    r1_ms: float = FAST_CANCEL_MS,
    r2_ms: float = DISPLACED_MS,
    r2_mult: float = DISPLACED_SPREADS,
    extended: bool = True,
    tickers: list[str] | None = None,
) -> DataFrame:
    """Basic and, on request, extended labels of typed orders with their book columns."""
    if tickers:
        df = df.where(F.col("ticker").isin(tickers))
    base = with_base_labels(df, r1_ms, r2_ms, r2_mult)
    return with_extended_labels(base) if extended else base
