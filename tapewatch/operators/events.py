"""Stage 1: order and trade ticks to one row per order with its first event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions import times
from tapewatch.functions.numbers import log_of, number, ratio
from tapewatch.operators.ordered import first_per_key
from tapewatch.schemas import BUY_CODES, CANCEL_CODES, CANCEL_TRADE_CODE, KEYS, NO_ORDER, SELL_CODES, TRADE_CODES


def plain_order_id(col: Column) -> Column:
    return F.ltrim(col, F.lit("0"))


def plain_side(col: Column) -> Column:
    """Both codings of a side as B or S."""
    return F.when(col.isin(*BUY_CODES), "B").when(col.isin(*SELL_CODES), "S").otherwise(col)


def plain_event_type(col: Column) -> Column:
    return F.when(col.isin(*CANCEL_CODES), "cancel").when(col.isin(*TRADE_CODES), "trade").otherwise(col)


def event_kind(trade_code: Column) -> Column:
    return F.when(trade_code == CANCEL_TRADE_CODE, "cancel").otherwise("trade")


def timed_orders(raw: DataFrame) -> DataFrame:
    """Typed orders; text columns that are not numbers become null, malformed times too."""
    return raw.withColumns(
        {
            "order_id": plain_order_id(F.col("order_id")),
            "side": plain_side(F.col("side")),
            "order_price": number(F.col("order_price")),
            "order_qty": number(F.col("order_qty")),
            "order_ts": times.tick_time(F.col("date"), F.col("time")),
        }
    ).drop("date", "time")


def side_events(raw: DataFrame) -> DataFrame:
    """One event per order number a trade row names: its buyer's, its seller's, or both."""
    sides = F.array(
        F.struct(F.lit("B").alias("event_side"), F.col("buy_no").alias("order_id")),
        F.struct(F.lit("S").alias("event_side"), F.col("sell_no").alias("order_id")),
    )
    kept = raw.withColumn("_side", F.explode(sides)).where(F.col("_side.order_id") != NO_ORDER)
    return kept.select(
        "trade_date",
        "ticker",
        plain_order_id(F.col("_side.order_id")).alias("order_id"),
        F.col("_side.event_side").alias("event_side"),
        event_kind(F.col("trade_code")).alias("event_type"),
        "trade_code",
        number(F.col("trade_price")).alias("trade_price"),
        number(F.col("trade_qty")).alias("trade_qty"),
        times.tick_time(F.col("date"), F.col("time")).alias("event_ts"),
    )


def _named(df: DataFrame) -> DataFrame:
    """Rows with a whole key: others match nothing, and could share one key by the million."""
    return df.where(" AND ".join(f"{k} IS NOT NULL" for k in KEYS))


def first_orders(orders: DataFrame, few: bool = True) -> DataFrame:
    return first_per_key(orders.where(F.col("order_ts").isNotNull()), KEYS, [F.col("order_ts")], few)


def first_events(events: DataFrame, few: bool = True) -> DataFrame:
    """The earliest event of each order. At equal times the buy side and then the smaller trade code,
    with cancels ahead of fills, decide."""
    is_fill = F.when(F.col("event_type") == "cancel", 0).otherwise(1)
    order = [F.col("event_ts"), F.col("event_side"), is_fill]
    return first_per_key(events.where(F.col("event_ts").isNotNull()), KEYS, order, few)


def orders_with_events(orders: DataFrame, events: DataFrame, few: bool = True) -> DataFrame:
    """Orders joined to their events, one row per key.

    Both sides are reduced to one row per key first. That equals joining all pairs and keeping the
    first of each key, but no key can multiply. An order has as many events as it has lots at most, so each side is
    shuffled and sorted once and joined in that order; ``few=False`` is for ids that millions of rows may share.
    """
    return first_orders(_named(orders), few).join(first_events(_named(events), few), list(KEYS), "inner")


def all_order_events(orders: DataFrame, events: DataFrame) -> DataFrame:
    """Every valid (order, event) pair, before one is chosen per key."""
    valid_orders = orders.where(F.col("order_ts").isNotNull())
    valid_events = events.where(F.col("event_ts").isNotNull())
    return valid_orders.join(valid_events, list(KEYS), "inner")


def survival_gap_ms(order_ts: Column, event_ts: Column) -> Column:
    return (times.micros(event_ts) - times.micros(order_ts)) / F.lit(1000.0)


def survival_ms(order_ts: Column, event_ts: Column) -> Column:
    """Milliseconds from order to event; events stamped before their order count as 0."""
    return F.greatest(F.lit(0.0), survival_gap_ms(order_ts, event_ts))


def quote_based_columns() -> dict[str, Column]:
    """Order amount, size and distance from the middle of the book."""
    price, qty = F.col("order_price"), F.col("order_qty")
    bid, ask = F.col("bid1"), F.col("ask1")
    mid, spread = (bid + ask) / 2, ask - bid
    return {
        "order_amount": price * qty,
        "is_buy": times.flag(F.col("side") == "B"),
        "log_qty": log_of(qty),
        "mid_price": mid,
        "spread": spread,
        "spread_bps": ratio(spread, mid) * 10000,
        "price_vs_mid": price - mid,
        "price_vs_mid_bps": ratio(price - mid, mid) * 10000,
    }


def with_order_features(df: DataFrame) -> DataFrame:
    return df.withColumns(quote_based_columns())


def in_hours(df: DataFrame) -> DataFrame:
    return df.where(times.in_trading_hours(F.col("order_ts")))


def with_session_features(df: DataFrame) -> DataFrame:
    return df.withColumns(times.session_columns(F.col("order_ts")))


def restrict(df: DataFrame, dates: list[str] | None = None, tickers: list[str] | None = None) -> DataFrame:
    """Date and ticker allow-lists; literal lists reach the scan as partition and row-group filters."""
    if dates:
        df = df.where(F.col("trade_date").isin(dates))
    if tickers:
        df = df.where(F.col("ticker").isin(tickers))
    return df
