"""Price lines of a ticker-day and the orders marked on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.times import tick_time
from tapewatch.operators.asof import with_latest
from tapewatch.operators.ordered import first_per_key
from tapewatch.schemas import TICKER_DAY

# Words that name a price column, and those that name a trade price.
PRICE_WORDS = ("价格", "price", "成交价", "中间价", "最新价")
TRADE_WORDS = ("成交", "trade")


def resolved_order_time(columns: Sequence[str]) -> Column:
    """Order time, else event time, else date and time text."""
    ways = [F.col(c) for c in ("order_ts", "event_ts") if c in columns]
    if "time" in columns:
        ways.append(tick_time(F.col("trade_date"), F.col("time")))
    return F.coalesce(*ways)


def line_time(date: Column, time: Column) -> Column:
    """Market file times: HHMMSS and a fraction of two digits or more, leading zeros possibly lost.

    Eight digits are HHMMSS and hundredths, unless that hour does not exist: then they are
    nine-digit milliseconds without their leading zero.
    """
    padded = F.lpad(time, F.greatest(F.lit(8), F.length(time)), F.lit("0"))
    whole = F.when((F.length(padded) == 8) & (F.substring(padded, 1, 2) > "23"), F.lpad(padded, 9, "0")).otherwise(padded)
    return tick_time(date, F.rpad(whole, F.greatest(F.lit(12), F.length(whole)), F.lit("0")))


def price_line(
    df: DataFrame, price: str | None = None, keys: Sequence[str] = TICKER_DAY, order: Sequence[str] = ()
) -> DataFrame:
    """(keys, quote_ts, price): one row per instant; rows without a valid time are dropped.

    ``df`` has text columns ``date`` and ``time``. The price column is chosen unless named.
    """
    chosen = price or price_column(df)
    timed = df.select(
        *keys, *order, line_time(F.col("date"), F.col("time")).alias("quote_ts"), F.col(chosen).cast("double").alias("price")
    )
    valid = timed.where(F.col("quote_ts").isNotNull())
    return first_per_key(valid, [*keys, "quote_ts"], [F.col(c) for c in order]).drop(*order)


def price_column(df: DataFrame) -> str:
    """The column to draw: a numeric one named like a price with a positive total, trade prices first,
    else the fifth column."""
    numeric = {"double", "float", "int", "bigint", "smallint"}
    candidates = [c for c, kind in df.dtypes if kind in numeric and any(w in c.lower() for w in PRICE_WORDS)]
    if candidates:
        totals = df.agg(*[F.sum(c).alias(c) for c in candidates]).first()
        candidates = [c for c in candidates if (totals[c] or 0) > 0]
    traded = [c for c in candidates if any(w in c.lower() for w in TRADE_WORDS)]
    if traded or candidates:
        return (traded or candidates)[0]
    if len(df.columns) > 4:
        return df.columns[4]
    raise ValueError("no price column")


def marked_orders(predictions: DataFrame, line: DataFrame, tolerance_us: int) -> DataFrame:
    """Predictions with the price at their time (the last one at most ``tolerance_us`` old)."""
    return with_latest(predictions, line, ("price",), tolerance_us)
