"""Row-level features of an order and the book it met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions import times
from tapewatch.functions.numbers import finite, log_of, number, ratio, zero_if_null
from tapewatch.operators.events import plain_event_type, plain_side
from tapewatch.schemas import QUOTE_VALUES

# Epsilons of the published feature definitions and the clip of pct_spread.
SPREAD_EPS = 1e-8
CLUSTER_EPS = 1e-6
PCT_SPREAD_CLIP = 500.0

LOG_SOURCES = {
    "log_qty": "order_qty",
    "log_order_price": "order_price",
    "log_bid1": "bid1",
    "log_ask1": "ask1",
    "log_bid_vol": "bid_vol1",
    "log_ask_vol": "ask_vol1",
}


def typed_events(df: DataFrame, required: bool = True) -> DataFrame:
    """Text columns of an imported event stream as times and numbers.

    With ``required`` rows whose order or event time cannot be read are dropped.
    """
    kinds = dict(df.dtypes)
    changes = {c: times.text_time(F.col(c)) for c in ("order_ts", "event_ts") if kinds.get(c) == "string"}
    numeric = ("order_price", "order_qty", "order_amount", "trade_price", "trade_qty", "survival_ms", *QUOTE_VALUES)
    changes |= {c: number(F.col(c)) for c in numeric if kinds.get(c) == "string"}
    if "side" in kinds:
        changes["side"] = plain_side(F.col("side"))
    if "event_type" in kinds:
        changes["event_type"] = plain_event_type(F.col("event_type"))
    typed = df.withColumns(changes)
    return typed.dropna(subset=[c for c in ("order_ts", "event_ts") if c in kinds]) if required else typed


def with_book(df: DataFrame) -> DataFrame:
    """Quote columns as doubles, absent ones as nulls; unknown volumes count as 0."""
    present = set(df.columns)
    book = {c: number(F.col(c)) if c in present else F.lit(None).cast("double") for c in QUOTE_VALUES}
    for volume in ("bid_vol1", "ask_vol1"):
        book[volume] = zero_if_null(book[volume])
    return df.withColumns(book)


def with_mid(df: DataFrame) -> DataFrame:
    mid = (F.col("bid1") + F.col("ask1")) / 2
    return df.withColumns(
        {"mid_price": mid, "spread": F.col("ask1") - F.col("bid1"), "delta_mid": F.col("order_price") - mid}
    )


def pct_spread() -> Column:
    raw = zero_if_null(ratio(F.abs("delta_mid"), F.col("mid_price")) * 100)
    return F.greatest(F.lit(-PCT_SPREAD_CLIP), F.least(F.lit(PCT_SPREAD_CLIP), raw))


def log_columns() -> dict[str, Column]:
    logs = {name: log_of(F.col(source)) for name, source in LOG_SOURCES.items()}
    return logs | {"log_order_amount": log_of(F.col("order_price") * F.col("order_qty"))}


def book_position_flags() -> dict[str, Column]:
    price, bid, ask = F.col("order_price"), F.col("bid1"), F.col("ask1")
    return {
        "at_bid": times.flag(price <= bid),
        "at_ask": times.flag(price >= ask),
        "inside_spread": times.flag((price > bid) & (price < ask)),
    }


def price_dev_prevclose_bps() -> Column:
    close = F.col("prev_close")
    return zero_if_null(ratio(F.col("order_price") - close, close) * 10000)


def price_aggressiveness() -> Column:
    width = F.col("spread") + SPREAD_EPS
    price = F.col("order_price")
    buying, selling = ratio(price - F.col("bid1"), width), ratio(F.col("ask1") - price, width)
    return zero_if_null(F.when(F.col("is_buy") == 1, buying).otherwise(selling))


def cluster_score() -> Column:
    return F.lit(1.0) / (F.abs(F.col("order_price") - F.col("mid_price")) + CLUSTER_EPS)


def book_imbalance() -> Column:
    bid, ask = F.col("bid_vol1"), F.col("ask_vol1")
    return zero_if_null(ratio(bid - ask, bid + ask + SPREAD_EPS))


def with_base_features(df: DataFrame) -> DataFrame:
    """All features that need the order's own row only (book columns and side already present)."""
    known = with_mid(df).withColumn("is_buy", times.flag(F.col("side") == "B"))
    return known.withColumns(
        {
            "pct_spread": pct_spread(),
            **log_columns(),
            **book_position_flags(),
            **times.session_columns(F.col("order_ts")),
            "price_dev_prevclose_bps": price_dev_prevclose_bps(),
            "price_aggressiveness": price_aggressiveness(),
            "cluster_score": cluster_score(),
            "book_imbalance": book_imbalance(),
        }
    )


def with_order_density(df: DataFrame) -> DataFrame:
    return df.withColumn("order_density", F.col("orders_100ms").cast("double"))


def relative_spread() -> Column:
    return ratio(F.col("spread"), F.col("mid_price"))


def with_safe_market_features(df: DataFrame) -> DataFrame:
    """The subset of features known for certain at the moment of the order."""
    logs = {name: log_of(F.col(source)) for name, source in LOG_SOURCES.items()}
    session = times.session_columns(F.col("order_ts"))
    wanted = ("seconds_since_market_open", "time_sin", "time_cos", "in_auction")
    return with_mid(df).withColumns(
        {
            "relative_spread": relative_spread(),
            "price_distance_pct": ratio(F.abs("delta_mid"), F.col("mid_price")) * 100,
            "book_imbalance": book_imbalance(),
            **{name: session[name] for name in wanted},
            **logs,
        }
    )


def order_imbalance(columns: list[str]) -> Column:
    if "bid1" not in columns or "ask1" not in columns:
        return F.lit(0.0)
    return ratio(F.col("bid1") - F.col("ask1"), F.col("bid1") + F.col("ask1"))


def quote_level_flags() -> dict[str, Column]:
    """Where the price stands between the quotes, told from its distance to the middle."""
    offset, half = F.col("delta_mid"), F.col("spread") / 2
    return {
        "at_bid": times.flag(offset <= -half),
        "at_ask": times.flag(offset >= half),
        "between_quotes": times.flag((offset > -half) & (offset < half)),
    }


def interaction_columns() -> dict[str, Column]:
    return {
        "qty_spread_interaction": F.col("log_qty") * F.col("relative_spread"),
        "time_qty_interaction": F.col("time_cos") * F.col("log_qty"),
        "direction_spread_interaction": F.col("is_buy") * F.col("pct_spread"),
        "price_time_interaction": F.col("price_dev_prevclose_bps") * F.col("time_sin"),
        "orders_cancels_ratio": F.col("orders_100ms") / (F.col("cancels_5s") + 1),
        "activity_spread_interaction": F.col("orders_100ms") * F.col("relative_spread"),
    }


def add_missing(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are not there yet; existing ones win."""
    return df.withColumns({name: value for name, value in columns.items() if name not in df.columns})


def sanitised(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric columns without NaN, infinity or null (all become 0)."""
    kinds = dict(df.dtypes)
    chosen = columns or df.columns
    fixed = {c: zero_if_null(finite(F.col(c))) for c in chosen if kinds[c] in ("double", "float")}
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in chosen if kinds[c] in ("int", "bigint", "smallint", "tinyint")}
    return df.withColumns(fixed | counts)
