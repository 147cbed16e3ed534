"""Table layouts and column catalogues."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the exchange's files and their names here.
RAW_NAMES = {
    "自然日": "date",
    "时间": "time",
    "交易所委托号": "order_id",
    "委托代码": "side",
    "委托价格": "order_price",
    "委托数量": "order_qty",
    "委托类型": "order_type",
    "委托编号": "order_no",
    "万得代码": "wind_code",
    "交易所代码": "exchange_code",
    "成交代码": "trade_code",
    "成交价格": "trade_price",
    "成交数量": "trade_qty",
    "叫买序号": "buy_no",
    "叫卖序号": "sell_no",
    "申买价1": "bid1",
    "申卖价1": "ask1",
    "申买量1": "bid_vol1",
    "申卖量1": "ask_vol1",
    "前收盘": "prev_close",
}

# Column names of an exported event stream that differ from the raw files.
EVENT_STREAM_NAMES = {
    "自然日": "trade_date",
    "ticker": "ticker",
    "交易所委托号": "order_id",
    "委托_datetime": "order_ts",
    "事件_datetime": "event_ts",
    "方向_委托": "side",
    "方向_事件": "event_side",
    "事件类型": "event_type",
    "委托价格": "order_price",
    "委托数量": "order_qty",
    "委托类型": "order_type",
    "委托金额": "order_amount",
    "成交价格": "trade_price",
    "成交数量": "trade_qty",
    "成交代码": "trade_code",
    "存活时间_ms": "survival_ms",
    "申买价1": "bid1",
    "申卖价1": "ask1",
    "申买量1": "bid_vol1",
    "申卖量1": "ask_vol1",
    "前收盘": "prev_close",
}

# File names of the three raw tables and of an exported event stream.
ORDER_FILE = "逐笔委托.csv"
TRADE_FILE = "逐笔成交.csv"
QUOTE_FILE = "行情.csv"
EVENT_STREAM_FILE = "委托事件流.csv"

# Codings of sides and event kinds.
BUY_CODES = ("B", "买")
SELL_CODES = ("S", "卖")
CANCEL_CODES = ("cancel", "撤单")
TRADE_CODES = ("trade", "成交")
CANCEL_TRADE_CODE = "C"
NO_ORDER = "0"

ORDER_COLUMNS = ("date", "time", "order_id", "side", "order_price", "order_qty", "order_type")
TRADE_COLUMNS = ("date", "time", "trade_code", "trade_price", "trade_qty", "buy_no", "sell_no")
QUOTE_COLUMNS = ("date", "time", "bid1", "ask1", "bid_vol1", "ask_vol1", "prev_close")
QUOTE_VALUES = ("bid1", "ask1", "bid_vol1", "ask_vol1", "prev_close")

KEYS = ("trade_date", "ticker", "order_id")
TICKER_DAY = ("trade_date", "ticker")
ROW_ORDER = ("order_ts", "order_id")

# Names of label, raw and derived columns.
TIME_COLUMNS = ("order_ts", "event_ts")
LABEL_METADATA = ("order_qty", "side", "order_price", "event_type", "survival_ms")
BASE_LABELS = ("flag_R1", "flag_R2", "y_label")
PATTERN_LABELS = (
    "extreme_price_deviation",
    "aggressive_pricing",
    "abnormal_large_order",
    "volatile_period_anomaly",
)
COMPOSITE_LABELS = (
    "enhanced_spoofing_conservative",
    "enhanced_spoofing_moderate",
    "enhanced_spoofing_liberal",
    "enhanced_spoofing_strict",
    "enhanced_combined",
)
EXTENDED_LABELS = PATTERN_LABELS + COMPOSITE_LABELS
TARGET_LABELS = (
    "y_label",
    "enhanced_spoofing_conservative",
    "enhanced_spoofing_moderate",
    "enhanced_combined",
)

# Book levels, and the base, extended and enriched feature sets.
BOOK_LEVELS = tuple(f"{c}{level}" for level in range(2, 6) for c in ("bid", "ask", "bid_vol", "ask_vol"))
RAW_FEATURE_COLUMNS = ("order_price", "order_qty", "side", "order_type") + QUOTE_VALUES + BOOK_LEVELS
BASE_FEATURES = (
    "mid_price", "spread", "pct_spread", "delta_mid", "price_dev_prevclose_bps",
    "log_qty", "is_buy",
    "time_sin", "time_cos", "in_auction", "seconds_since_market_open",
    "orders_100ms", "orders_1s",
    "book_imbalance", "price_aggressiveness", "cluster_score",
    "at_bid", "at_ask", "inside_spread",
    "log_order_price", "log_bid1", "log_ask1", "log_bid_vol", "log_ask_vol", "log_order_amount",
)
EXTENDED_FEATURES = ("z_survival", "price_momentum_100ms", "spread_change", "order_density")
ENRICHED_FEATURES = (
    "price_volatility", "price_momentum", "relative_spread", "spread_volatility", "order_imbalance",
    "between_quotes",
    "log_qty_rank", "log_qty_zscore", "spread_rank", "spread_zscore", "delta_mid_rank", "delta_mid_zscore",
    "hist_order_size_mean", "hist_spread_mean",
    "qty_spread_interaction", "time_qty_interaction", "direction_spread_interaction",
    "price_time_interaction", "orders_cancels_ratio", "activity_spread_interaction",
)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_TEXT, _REAL, _INT, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampNTZType()

EVENT_STREAM = _schema(
    trade_date=_TEXT, ticker=_TEXT, order_id=_TEXT, order_ts=_TS, event_ts=_TS,
    side=_TEXT, order_price=_REAL, order_qty=_REAL, order_type=_TEXT,
    event_side=_TEXT, event_type=_TEXT, trade_code=_TEXT, trade_price=_REAL, trade_qty=_REAL,
    quote_ts=_TS, bid1=_REAL, ask1=_REAL, bid_vol1=_REAL, ask_vol1=_REAL, prev_close=_REAL,
    survival_ms=_REAL, order_amount=_REAL, is_buy=_INT, log_qty=_REAL,
    mid_price=_REAL, spread=_REAL, spread_bps=_REAL, price_vs_mid=_REAL, price_vs_mid_bps=_REAL,
    in_auction=_INT, in_morning=_INT, in_afternoon=_INT,
    seconds_since_market_open=_REAL, time_sin=_REAL, time_cos=_REAL,
)
PREDICTIONS = _schema(
    trade_date=_TEXT, ticker=_TEXT, order_id=_TEXT, order_ts=_TS,
    y_label=_INT, predicted_proba=_REAL, predicted_binary=_INT,
)
METRICS = _schema(run_ts=_TS, method=_TEXT, scope=_TEXT, ticker=_TEXT, metric=_TEXT, value=_REAL)


def label_columns(extended: bool = True) -> list[str]:
    return list(BASE_LABELS + (EXTENDED_LABELS if extended else ()))


def feature_columns(extended: bool = True) -> list[str]:
    return list(BASE_FEATURES + (EXTENDED_FEATURES if extended else ()))


# Named feature sets for models, for reading, and by theme.
MODEL_FEATURES = (
    "ticker", "trade_date", "order_id",
    "log_qty", "log_order_price", "log_bid1", "log_ask1", "log_bid_vol", "log_ask_vol", "log_order_amount",
    "is_buy", "mid_price", "spread", "delta_mid", "pct_spread", "price_aggressiveness", "book_imbalance",
    "time_sin", "time_cos", "in_auction", "seconds_since_market_open",
    "orders_100ms", "orders_1s",
    "cluster_score", "price_dev_prevclose_bps",
)
READABLE_FEATURES = (
    "ticker", "trade_date", "order_id", "event_type", "side",
    "order_price", "order_qty", "bid1", "ask1", "bid_vol1", "ask_vol1", "prev_close",
    "is_buy", "mid_price", "spread", "survival_ms", "order_amount",
)
FEATURE_THEMES = {
    "price": ("order_price", "bid1", "ask1", "prev_close", "mid_price", "log_order_price", "log_bid1", "log_ask1"),
    "quantity": ("order_qty", "bid_vol1", "ask_vol1", "log_qty", "log_bid_vol", "log_ask_vol"),
    "amount": ("order_amount", "log_order_amount"),
    "time": ("time_sin", "time_cos", "in_auction", "seconds_since_market_open", "survival_ms"),
    "technical": ("spread", "pct_spread", "delta_mid", "price_aggressiveness", "book_imbalance", "cluster_score"),
    "statistical": ("orders_100ms", "orders_1s", "at_bid", "at_ask", "inside_spread"),
}
