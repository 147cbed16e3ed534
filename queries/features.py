"""Row-level and history features."""

from pyspark.sql import functions as F

from queries import bindings as b
from queries.registry import query, r, rounded
from queries.stage1 import SESSION_SQL
from tapewatch.functions import times
from tapewatch.operators import features as fx
from tapewatch.operators import history, rolling
from tapewatch.plans import stages
from tapewatch.schemas import BASE_FEATURES

HOURS = {"100ms": times.HOUR, "1s": 6 * times.HOUR, "5s": 24 * times.HOUR}


def booked(spark, sf):
    return fx.with_mid(fx.with_book(b.tk(spark, sf))).withColumn("is_buy", times.flag(F.col("side") == "B"))


@query("P12_event_typing", """
SELECT order_id, order_ts, order_price, order_qty, side, event_type FROM tk
""")
def p12(spark, sf):
    text = b.tk(spark, sf).select(
        "order_id",
        F.date_format("order_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("order_ts"),
        F.col("order_price").cast("string").alias("order_price"),
        F.col("order_qty").cast("string").alias("order_qty"),
        F.when(F.col("side") == "B", "买").otherwise("卖").alias("side"),
        F.when(F.col("event_type") == "cancel", "撤单").otherwise("成交").alias("event_type"),
    )
    return fx.typed_events(text)


@query("P13_P14_book_and_mid", """
SELECT order_id, round(bid1, 6) + 0.0 AS bid1, round(ask1, 6) + 0.0 AS ask1, coalesce(bid_vol1, 0) AS bid_vol1,
  coalesce(ask_vol1, 0) AS ask_vol1, prev_close, round(mid_price, 6) + 0.0 AS mid_price,
  round(spread, 6) + 0.0 AS spread, round(delta_mid, 6) + 0.0 AS delta_mid FROM tkm
""")
def p13(spark, sf):
    return rounded(
        booked(spark, sf).select(
            "order_id", "bid1", "ask1", "bid_vol1", "ask_vol1", "prev_close", "mid_price", "spread", "delta_mid"
        )
    )


@query("P15_is_buy", "SELECT is_buy, side, count(*) AS n FROM tkm GROUP BY ALL")
def p15(spark, sf):
    return booked(spark, sf).groupBy("is_buy", "side").agg(F.count(F.lit(1)).alias("n"))


PRICE_SQL = """
round(greatest(-500, least(500, coalesce(abs(delta_mid) / nullif(mid_price, 0) * 100, 0))), 5) + 0.0 AS pct_spread,
round(coalesce((order_price - prev_close) / prev_close * 10000, 0), 5) + 0.0 AS price_dev_prevclose_bps,
round(coalesce(CASE WHEN side = 'B' THEN (order_price - bid1) / (spread + 1e-8) ELSE (ask1 - order_price) / (spread + 1e-8) END, 0), 6) + 0.0 AS price_aggressiveness,
round(1 / (abs(order_price - mid_price) + 1e-6), 5) + 0.0 AS cluster_score,
round(coalesce((coalesce(bid_vol1, 0) - coalesce(ask_vol1, 0)) / (coalesce(bid_vol1, 0) + coalesce(ask_vol1, 0) + 1e-8), 0), 6) + 0.0 AS book_imbalance
"""


@query("P16_P19_P20_P21_P22_price_features", f"SELECT order_id, {PRICE_SQL} FROM tkm")
def p16(spark, sf):
    return booked(spark, sf).select(
        "order_id",
        r(fx.pct_spread(), 5).alias("pct_spread"),
        r(fx.price_dev_prevclose_bps(), 5).alias("price_dev_prevclose_bps"),
        r(fx.price_aggressiveness()).alias("price_aggressiveness"),
        r(fx.cluster_score(), 5).alias("cluster_score"),
        r(fx.book_imbalance()).alias("book_imbalance"),
    )


LOG_SQL = """
round(ln(1 + coalesce(order_qty, 0)), 6) + 0.0 AS log_qty, round(ln(1 + coalesce(order_price, 0)), 6) + 0.0 AS log_order_price,
round(ln(1 + abs(coalesce(bid1, 0))), 6) + 0.0 AS log_bid1, round(ln(1 + abs(coalesce(ask1, 0))), 6) + 0.0 AS log_ask1,
round(ln(1 + coalesce(bid_vol1, 0)), 6) + 0.0 AS log_bid_vol, round(ln(1 + coalesce(ask_vol1, 0)), 6) + 0.0 AS log_ask_vol,
round(ln(1 + coalesce(order_price * order_qty, 0)), 6) + 0.0 AS log_order_amount
"""


@query("P17_log_transforms", f"SELECT order_id, {LOG_SQL} FROM tkm")
def p17(spark, sf):
    # the synthetic book can be below zero, where a logarithm is undefined; a real one cannot
    up = booked(spark, sf).withColumns({c: F.abs(c) for c in ("bid1", "ask1")})
    return up.select("order_id", *[r(c).alias(n) for n, c in fx.log_columns().items()])


@query("P18_price_position", """
SELECT order_id, CASE WHEN order_price <= bid1 THEN 1 ELSE 0 END AS at_bid, CASE WHEN order_price >= ask1 THEN 1 ELSE 0 END AS at_ask,
  CASE WHEN order_price > bid1 AND order_price < ask1 THEN 1 ELSE 0 END AS inside_spread FROM tkm
""")
def p18(spark, sf):
    return booked(spark, sf).select("order_id", *[c.alias(n) for n, c in fx.book_position_flags().items()])


@query("P25_safe_market_features", """
SELECT order_id, round(spread / nullif(mid_price, 0), 6) + 0.0 AS relative_spread,
  round(abs(delta_mid) / nullif(mid_price, 0) * 100, 5) + 0.0 AS price_distance_pct FROM tkm
""")
def p25(spark, sf):
    out = fx.with_safe_market_features(fx.with_book(b.tk(spark, sf)))
    return out.select("order_id", r("relative_spread").alias("relative_spread"), r("price_distance_pct", 5).alias("price_distance_pct"))


@query("P26_P27_P28_quote_level", """
SELECT order_id, round(spread / nullif(mid_price, 0), 6) + 0.0 AS relative_spread,
  round((bid1 - ask1) / nullif(bid1 + ask1, 0), 6) + 0.0 AS order_imbalance,
  CASE WHEN delta_mid <= -(spread / 2) THEN 1 ELSE 0 END AS at_bid, CASE WHEN delta_mid >= spread / 2 THEN 1 ELSE 0 END AS at_ask,
  CASE WHEN delta_mid > -(spread / 2) AND delta_mid < spread / 2 THEN 1 ELSE 0 END AS between_quotes FROM tkm
""")
def p26(spark, sf):
    df = booked(spark, sf)
    return df.select(
        "order_id",
        r(fx.relative_spread()).alias("relative_spread"),
        r(fx.order_imbalance(df.columns)).alias("order_imbalance"),
        *[c.alias(n) for n, c in fx.quote_level_flags().items()],
    )


@query("P29_interactions", f"""
, f AS (SELECT tkm.*, {SESSION_SQL.replace('round(', '(').replace(', 6)', ')')}, {PRICE_SQL.replace('round(', '(').replace(', 6)', ')').replace(', 5)', ')')},
  spread / nullif(mid_price, 0) AS relative_spread,
  count(*) OVER p - 1 AS orders_100ms, (event_type = 'cancel')::INT AS cancels_5s
  FROM tkm WINDOW p AS (PARTITION BY trade_date, ticker))
SELECT order_id, round(log_qty * relative_spread, 5) + 0.0 AS qty_spread_interaction,
  round(time_cos * log_qty, 6) + 0.0 AS time_qty_interaction, round(is_buy * pct_spread, 5) + 0.0 AS direction_spread_interaction,
  round(price_dev_prevclose_bps * time_sin, 4) + 0.0 AS price_time_interaction,
  round(orders_100ms / (cancels_5s + 1), 6) + 0.0 AS orders_cancels_ratio,
  round(orders_100ms * relative_spread, 5) + 0.0 AS activity_spread_interaction FROM f
""")
def p29(spark, sf):
    df = fx.with_base_features(fx.with_book(b.tk(spark, sf)))
    per_day = df.groupBy("trade_date", "ticker").agg((F.count(F.lit(1)) - 1).alias("orders_100ms"))
    df = df.join(per_day, ["trade_date", "ticker"]).withColumns(
        {"relative_spread": fx.relative_spread(), "cancels_5s": times.flag(F.col("event_type") == "cancel")}
    )
    digits = {"time_qty_interaction": 6, "orders_cancels_ratio": 6, "price_time_interaction": 4}
    return df.select("order_id", *[r(c, digits.get(n, 5)).alias(n) for n, c in fx.interaction_columns().items()])


@query("P30_sanitise", """
SELECT order_id, round(coalesce(bid1, 0), 6) + 0.0 AS bid1, round(coalesce(ask1, 0), 6) + 0.0 AS ask1,
  CASE WHEN CAST(order_id AS BIGINT) % 5 IN (0, 1) THEN 0 ELSE round(order_price, 6) + 0.0 END AS order_price FROM tk
""")
def p30(spark, sf):
    n = F.col("order_id").cast("bigint") % 5
    odd = F.when(n == 0, F.lit(float("nan"))).when(n == 1, F.lit(float("-inf"))).otherwise(F.col("order_price"))
    df = b.tk(spark, sf).select("order_id", "bid1", "ask1", odd.alias("order_price"))
    return rounded(fx.sanitised(df))


@query("P33_P34_P35_scores_and_focal_loss", """
, s AS (SELECT order_id, order_price - 10 AS z, CASE WHEN event_type = 'cancel' THEN 1 ELSE 0 END AS y FROM tk),
p AS (SELECT *, 1 / (1 + exp(-z)) AS p FROM s),
t AS (SELECT *, p * y + (1 - p) * (1 - y) AS pt, CAST(0.25 AS DOUBLE) * y + CAST(0.75 AS DOUBLE) * (1 - y) AS a FROM p),
w AS (SELECT *, a * pow(1 - pt, 2) AS w FROM t)
SELECT order_id, round(p, 6) + 0.0 AS probability, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS predicted, round(w, 6) + 0.0 AS focal_weight,
  round(w * (-y * ln(p + 1e-8) - (1 - y) * ln(1 - p + 1e-8)), 6) + 0.0 AS focal_loss,
  round(w * (p - y), 6) + 0.0 AS focal_gradient, round(w * p * (1 - p) * (2 * (y - p) + 1), 6) + 0.0 AS focal_hessian FROM w
""")
def p33(spark, sf):
    from tapewatch.functions.numbers import decision, focal_terms, sigmoid

    z = F.col("order_price") - 10
    y = times.flag(F.col("event_type") == "cancel")
    terms = focal_terms(z, y, 0.25, 2.0)
    return b.tk(spark, sf).select(
        "order_id", r(sigmoid(z)).alias("probability"), decision(sigmoid(z)).alias("predicted"),
        *[r(c).alias(n) for n, c in terms.items()],
    )


@query("P36_order_time", """
SELECT order_id, CASE WHEN CAST(order_id AS BIGINT) % 3 = 0 THEN order_ts WHEN CAST(order_id AS BIGINT) % 3 = 1 THEN event_ts
  ELSE date_trunc('day', order_ts) + INTERVAL '9 hours 30 minutes' END AS resolved FROM tk
""")
def p36(spark, sf):
    from tapewatch.sources.market import resolved_order_time

    n = F.col("order_id").cast("bigint") % 3
    df = b.tk(spark, sf).select(
        "order_id", "trade_date", F.when(n == 0, F.col("order_ts")).alias("order_ts"),
        F.when(n == 1, F.col("event_ts")).alias("event_ts"), F.lit("93000000").alias("time"),
    )
    return df.select("order_id", resolved_order_time(df.columns).alias("resolved"))


@query("P38_price_column_choice", """
SELECT 'trade_price' AS chosen, round(sum(order_price), 3) AS total FROM tk
""")
def p38(spark, sf):
    from tapewatch.sources.market import price_column

    df = b.tk(spark, sf).select(
        "trade_date", "ticker", "order_id", F.lit(0.0).alias("last_price"), "order_price",
        F.col("order_price").alias("trade_price"),
    )
    name = price_column(df)
    return df.agg(F.lit(name).alias("chosen"), F.round(F.sum(name), 3).alias("total"))


# ------------------------------------------------------------------ windows

def count_sql(name: str, hours: int, keys: str, what: str = "count(*)") -> str:
    return f"""{what} OVER (PARTITION BY {keys} ORDER BY us
  RANGE BETWEEN {hours * 3_600_000_000} PRECEDING AND 1 PRECEDING) AS {name}"""


@query("W1_order_counts", f"""
SELECT order_id, {count_sql('orders_100ms', 1, 'trade_date, ticker')}, {count_sql('orders_1s', 6, 'trade_date, ticker')} FROM tkm
""")
def w1(spark, sf):
    hours = {w: HOURS[w] for w in ("100ms", "1s")}
    return rolling.order_counts(b.tk(spark, sf), hours).select("order_id", "orders_100ms", "orders_1s")


REPEATED = "CAST(order_id AS BIGINT) % 50"


@query("W1_order_counts_repeated_ids", f"""
, f AS (SELECT * REPLACE (CAST({REPEATED} AS VARCHAR) AS order_id) FROM tkm)
SELECT order_id, order_ts, {count_sql('orders_100ms', 1, 'trade_date, ticker')}, {count_sql('orders_1s', 6, 'trade_date, ticker')} FROM f
""")
def w1_repeated(spark, sf):
    """An order id names many rows of a ticker-day, as imported event streams may have it."""
    hours = {w: HOURS[w] for w in ("100ms", "1s")}
    repeated = b.tk(spark, sf).withColumn("order_id", F.expr(REPEATED).cast("string"))
    return rolling.order_counts(repeated, hours).select("order_id", "order_ts", "orders_100ms", "orders_1s")


@query("W1_order_counts_across_tickers", f"""
SELECT order_id, {count_sql('orders_100ms', 1, 'trade_date')}, {count_sql('orders_1s', 6, 'trade_date')} FROM tkm
""")
def w1_day(spark, sf):
    hours = {w: HOURS[w] for w in ("100ms", "1s")}
    return rolling.order_counts(b.tk(spark, sf), hours, ["trade_date"]).select("order_id", "orders_100ms", "orders_1s")


@query("W2_orders_5s", f"SELECT order_id, {count_sql('orders_5s', 24, 'trade_date, ticker')} FROM tkm")
def w2(spark, sf):
    return rolling.order_counts(b.tk(spark, sf), {"5s": HOURS["5s"]}).select("order_id", "orders_5s")


@query("W2b_history_counts_by_order_time", f"""
, c AS (SELECT order_id, {count_sql('orders_1s', 6, 'trade_date, ticker')}, {count_sql('orders_5s', 24, 'trade_date, ticker')},
  {count_sql('c1', 6, 'trade_date, ticker', "sum((event_type = 'cancel')::INT)")}, {count_sql('c5', 24, 'trade_date, ticker', "sum((event_type = 'cancel')::INT)")},
  {count_sql('t1', 6, 'trade_date, ticker', "sum((event_type = 'trade')::INT)")} FROM tkm)
SELECT order_id, orders_1s, orders_5s, CAST(coalesce(c1, 0) AS BIGINT) AS cancels_1s, CAST(coalesce(c5, 0) AS BIGINT) AS cancels_5s,
  CAST(coalesce(t1, 0) AS BIGINT) AS trades_1s, round(coalesce(c1, 0) / (orders_1s + 1e-8), 6) + 0.0 AS cancel_ratio_1s,
  round(coalesce(c5, 0) / (orders_5s + 1e-8), 6) + 0.0 AS cancel_ratio_5s FROM c
""")
def w2b_order(spark, sf):
    hours = {w: HOURS[w] for w in ("1s", "5s")}
    out = rolling.history_counts(b.tk(spark, sf), hours, event_time="order")
    return rounded(
        out.select("order_id", "orders_1s", "orders_5s", "cancels_1s", "cancels_5s", "trades_1s", "cancel_ratio_1s", "cancel_ratio_5s")
    )


@query("W2b_history_counts_by_event_time", """
, ev AS (SELECT trade_date, ticker, event_type, us + CAST(survival_ms AS BIGINT) * 1000 AS eus FROM tkm)
SELECT o.order_id, CAST(count(*) FILTER (event_type = 'cancel' AND eus >= us - 3600000000) AS BIGINT) AS cancels_100ms,
  CAST(count(*) FILTER (event_type = 'cancel') AS BIGINT) AS cancels_1s,
  CAST(count(*) FILTER (event_type = 'trade') AS BIGINT) AS trades_1s
FROM (SELECT order_id, trade_date, ticker, us FROM tkm) o
LEFT JOIN ev e ON o.trade_date = e.trade_date AND o.ticker = e.ticker AND eus < us AND eus >= us - 21600000000
GROUP BY o.order_id
""")
def w2b_event(spark, sf):
    hours = {w: HOURS[w] for w in ("100ms", "1s")}
    out = rolling.history_counts(b.tk(spark, sf), hours)
    return out.select("order_id", "cancels_100ms", "cancels_1s", "trades_1s")


@query("W3_arrival_gap_score", """
, g AS (SELECT *, coalesce(CAST(us - lag(us) OVER (PARTITION BY trade_date, ticker ORDER BY order_ts, order_id) AS DOUBLE) / 1000, 0) AS gap FROM tkm),
s AS (SELECT order_id, gap, avg(gap) OVER w AS m, stddev_samp(gap) OVER w AS sd FROM g
  WINDOW w AS (PARTITION BY trade_date, ticker ORDER BY order_ts, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT order_id, round((gap - coalesce(m, 0)) / (coalesce(sd, 1) + 1e-8), 5) + 0.0 AS z_survival FROM s
""")
def w3(spark, sf):
    out = history.arrival_gap_score(b.tk(spark, sf).select("trade_date", "ticker", "order_id", "order_ts"))
    return out.select("order_id", r("z_survival", 5).alias("z_survival"))


@query("W4_W5_row_changes", """
, l AS (SELECT *, lag(mid_price) OVER w AS m0, lag(spread) OVER w AS s0 FROM tkm
  WINDOW w AS (PARTITION BY trade_date, ticker ORDER BY order_ts, order_id))
SELECT order_id, round((mid_price - m0) / (m0 + 1e-8), 5) + 0.0 AS price_momentum_100ms,
  round((spread - s0) / (s0 + 1e-8), 5) + 0.0 AS spread_change FROM l
""")
def w4(spark, sf):
    out = history.row_changes(b.tkm(spark, sf))
    return out.select("order_id", r("price_momentum_100ms", 5).alias("price_momentum_100ms"), r("spread_change", 5).alias("spread_change"))


@query("W6_trailing_deviation", """
SELECT order_id, round(stddev_samp(mid_price) OVER (w ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 5) + 0.0 AS price_volatility,
  round(stddev_samp(spread) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 5) + 0.0 AS spread_volatility
FROM tkm WINDOW w AS (PARTITION BY ticker ORDER BY trade_date, order_ts, order_id)
""")
def w6(spark, sf):
    out = history.trailing_deviation(b.tkm(spark, sf), ["ticker"])
    return out.select("order_id", r("price_volatility", 5).alias("price_volatility"), r("spread_volatility", 5).alias("spread_volatility"))


@query("W7_momentum", """
, f AS (SELECT *, last_value(mid_price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY trade_date, order_ts, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM tkm),
l AS (SELECT *, lag(m, 5) OVER (PARTITION BY ticker ORDER BY trade_date, order_ts, order_id) AS m5 FROM f)
SELECT order_id, round(m / nullif(m5, 0) - 1, 5) + 0.0 AS price_momentum FROM l
""")
def w7(spark, sf):
    out = history.momentum(b.tkm(spark, sf), ["ticker"])
    return out.select("order_id", r("price_momentum", 5).alias("price_momentum"))


@query("W8_earlier_means", """
SELECT order_id, round(avg(log_qty) OVER w, 5) + 0.0 AS hist_order_size_mean, round(avg(spread) OVER w, 5) + 0.0 AS hist_spread_mean FROM tkm
WINDOW w AS (PARTITION BY ticker ORDER BY trade_date, order_ts, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def w8(spark, sf):
    out = history.earlier_means(b.tkm(spark, sf), ["ticker"])
    return out.select("order_id", r("hist_order_size_mean", 5).alias("hist_order_size_mean"), r("hist_spread_mean", 5).alias("hist_spread_mean"))


def rank_sql(column: str) -> str:
    return f"""CASE WHEN {column} IS NOT NULL THEN round((rank() OVER (PARTITION BY ticker ORDER BY {column} NULLS LAST)
  + (count(*) OVER (PARTITION BY ticker, {column}) - 1) / 2) / count({column}) OVER (PARTITION BY ticker), 6) + 0.0 END AS {column}_rank"""


@query("W9_ranks", f"SELECT order_id, {rank_sql('log_qty')}, {rank_sql('spread')} FROM tkm0".replace("tkm0", "(SELECT * REPLACE (round(spread, 6) AS spread) FROM tkm)"))
def w9(spark, sf):
    df = b.tkm(spark, sf).withColumn("spread", F.round("spread", 6))
    return rounded(history.ranks(df, ["ticker"], ["log_qty", "spread"]).select("order_id", "log_qty_rank", "spread_rank"))


@query("A19_standard_scores", """
SELECT order_id, round((log_qty - avg(log_qty) OVER p) / (stddev_samp(log_qty) OVER p + 1e-8), 5) + 0.0 AS log_qty_zscore,
  round((spread - avg(spread) OVER p) / (stddev_samp(spread) OVER p + 1e-8), 5) + 0.0 AS spread_zscore,
  round((delta_mid - avg(delta_mid) OVER p) / (stddev_samp(delta_mid) OVER p + 1e-8), 5) + 0.0 AS delta_mid_zscore
FROM tkm WINDOW p AS (PARTITION BY ticker)
""")
def a19(spark, sf):
    out = history.standard_scores(b.tkm(spark, sf), ["ticker"])
    return rounded(out.select("order_id", "log_qty_zscore", "spread_zscore", "delta_mid_zscore"), 5)


@query("B2_P24_feature_table", f"""
, g AS (SELECT *, coalesce(CAST(us - lag(us) OVER (PARTITION BY trade_date, ticker ORDER BY order_ts, order_id) AS DOUBLE) / 1000, 0) AS gap FROM tkm),
s AS (SELECT *, avg(gap) OVER w AS m, stddev_samp(gap) OVER w AS sd,
  CAST(count(*) OVER (PARTITION BY trade_date, ticker ORDER BY us RANGE BETWEEN 100000 PRECEDING AND 1 PRECEDING) AS BIGINT) AS orders_100ms,
  CAST(count(*) OVER (PARTITION BY trade_date, ticker ORDER BY us RANGE BETWEEN 1000000 PRECEDING AND 1 PRECEDING) AS BIGINT) AS orders_1s FROM g
  WINDOW w AS (PARTITION BY trade_date, ticker ORDER BY order_ts, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT trade_date, ticker, order_id, order_ts, side, order_price, order_qty, prev_close,
  is_buy, orders_100ms, orders_1s, CAST(orders_100ms AS DOUBLE) AS order_density,
  round((gap - coalesce(m, 0)) / (coalesce(sd, 1) + 1e-8), 5) + 0.0 AS z_survival,
  round(mid_price, 6) + 0.0 AS mid_price, round(delta_mid, 6) + 0.0 AS delta_mid FROM s
""")
def b2(spark, sf):
    out = stages.features(b.tk(spark, sf))
    return out.select(
        "trade_date", "ticker", "order_id", "order_ts", "side", "order_price", "order_qty", "prev_close",
        "is_buy", "orders_100ms", "orders_1s", "order_density",
        r("z_survival", 5).alias("z_survival"), r("mid_price").alias("mid_price"), r("delta_mid").alias("delta_mid"),
    )


def history_sql(by: str) -> str:
    """History columns over all days, and what compares the rows of ``by``."""
    ranked = ", ".join(
        f"""coalesce(CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {c} NULLS LAST)
  + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2) / count({c}) OVER (PARTITION BY {by}) END, 0) AS {c}_rank,
  coalesce(({c} - avg({c}) OVER (PARTITION BY {by})) / (stddev_samp({c}) OVER (PARTITION BY {by}) + 1e-8), 0) AS {c}_zscore"""
        for c in ("log_qty", "spread", "delta_mid")
    )
    return f""", k AS (SELECT *, last_value(mid_price IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known
  FROM tkr WINDOW w AS (PARTITION BY ticker ORDER BY trade_date, order_ts, order_id)),
hs AS (SELECT *, coalesce(stddev_samp(mid_price) OVER (w ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 0) AS price_volatility,
  coalesce(stddev_samp(spread) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS spread_volatility,
  coalesce(known / nullif(lag(known, 5) OVER w, 0) - 1, 0) AS price_momentum,
  coalesce(avg(log_qty) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hist_order_size_mean,
  coalesce(avg(spread) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hist_spread_mean, {ranked}
  FROM k WINDOW w AS (PARTITION BY ticker ORDER BY trade_date, order_ts, order_id))"""


#: The middle, the spread and their distances on a grid that both engines hit exactly, so that ranks see the same ties.
ON_GRID = ("mid_price", "spread", "delta_mid")
GRID_SQL = ", tkr AS (SELECT * REPLACE (" + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ON_GRID) + ") FROM tkm)"
HISTORY_COLUMNS = (
    "price_volatility", "spread_volatility", "price_momentum", "hist_order_size_mean", "hist_spread_mean",
    "log_qty_rank", "spread_rank", "delta_mid_rank", "log_qty_zscore", "spread_zscore", "delta_mid_zscore",
)


def model_rows(spark, sf):
    """Base features with the columns that histories are made of on a grid."""
    based = rolling.order_counts(fx.with_base_features(fx.with_book(b.tk(spark, sf))))
    assert set(BASE_FEATURES) <= set(based.columns)
    return based.withColumns({c: r(c) for c in ON_GRID})


@query("U3_enriched_features", GRID_SQL + history_sql("ticker") + """
SELECT order_id, round(coalesce(spread / nullif(mid_price, 0), 0), 6) + 0.0 AS relative_spread,
  round(coalesce((bid1 - ask1) / nullif(bid1 + ask1, 0), 0), 6) + 0.0 AS order_imbalance,
  CASE WHEN delta_mid > -(spread / 2) AND delta_mid < spread / 2 THEN 1 ELSE 0 END AS between_quotes, """ + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in HISTORY_COLUMNS) + " FROM hs")
def u3(spark, sf):
    out = stages.enriched(model_rows(spark, sf), ["ticker"])
    return out.select(
        "order_id", r("relative_spread").alias("relative_spread"), r("order_imbalance").alias("order_imbalance"), "between_quotes", *[r(c, 5).alias(c) for c in HISTORY_COLUMNS]
    )


@query("U3_ML7_histories_carried_by_run", GRID_SQL + history_sql("trade_date, ticker") + "SELECT order_id, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in HISTORY_COLUMNS) + " FROM hs")
def u3_by_run(spark, sf):
    """Runs of several days, then days one by one; each continues from the state that the run before stored."""
    from tapewatch.schemas import TICKER_DAY
    from tapewatch.session import scratch_path
    from tapewatch.sources import tables

    root = scratch_path(spark, "by-run")
    tables.write_daily(model_rows(spark, sf), f"{root}/features")
    ends = ["20240112", "20240127", "20240128", "20240129", "20240131"]
    before, done = None, None
    for last in ends:
        rows = tables.read_features(spark, root).where(F.col("trade_date") <= last)
        state = tables.read_state(spark, f"{root}/state", before) if before else None
        if before:
            rows = rows.where(F.col("trade_date") > before)
        wide, history_of_run = stages.enriched_from(rows, state, ["ticker"], TICKER_DAY)
        part = wide.select("order_id", *[r(c, 5).alias(c) for c in HISTORY_COLUMNS])
        tables.write_state(history_of_run.state(), f"{root}/state", last)
        done = part if done is None else done.unionByName(part)
        before = last
    return done
