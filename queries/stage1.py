"""Ticks to event stream."""

from pyspark.sql import functions as F

from queries import bindings as b
from queries.registry import query, r, rounded
from tapewatch.functions import times
from tapewatch.operators import asof, events as ev
from tapewatch.plans.stages import event_stream
from tapewatch.schemas import KEYS


@query("P1_order_id_normalisation", """
SELECT trade_date, ticker, ltrim(order_id, '0') AS order_id, order_id AS raw_id FROM raw_orders
""")
def p1(spark, sf):
    return b.raw_orders(spark, sf).select(
        "trade_date", "ticker", ev.plain_order_id(F.col("order_id")).alias("order_id"), F.col("order_id").alias("raw_id")
    )


@query("P2_U1_side_events", """
SELECT trade_date, ticker, order_id, event_side, event_type, trade_code, trade_price, trade_qty, event_ts FROM st_events
""")
def p2(spark, sf):
    return ev.side_events(b.raw_trades(spark, sf)).select(
        "trade_date", "ticker", "order_id", "event_side", "event_type", "trade_code", "trade_price", "trade_qty", "event_ts"
    )


@query("P3_event_type", """
SELECT event_type, trade_code, count(*) AS n FROM st_events GROUP BY ALL
""")
def p3(spark, sf):
    return ev.side_events(b.raw_trades(spark, sf)).groupBy("event_type", "trade_code").agg(F.count(F.lit(1)).alias("n"))


@query("P4_tick_time", """
SELECT trade_date, ticker, date, time, try_strptime(date || lpad(time, 9, '0') || '000', '%Y%m%d%H%M%S%f') AS event_ts,
  trade_code, buy_no, sell_no FROM raw_trades
""")
def p4(spark, sf):
    return b.raw_trades(spark, sf).select(
        "trade_date", "ticker", "date", "time", times.tick_time(F.col("date"), F.col("time")).alias("event_ts"),
        "trade_code", "buy_no", "sell_no",
    )


@query("P5_valid_pairs", """
SELECT trade_date, ticker, order_id, order_ts, event_ts, event_side, event_type, trade_price FROM st
""")
def p5(spark, sf):
    pairs = ev.all_order_events(ev.timed_orders(b.raw_orders(spark, sf)), ev.side_events(b.raw_trades(spark, sf)))
    return pairs.select(
        "trade_date", "ticker", "order_id", "order_ts", "event_ts", "event_side", "event_type", "trade_price"
    )


@query("J1_orders_with_events", """
SELECT trade_date, ticker, order_id, order_ts, event_ts, side, event_side, event_type, trade_code,
  round(trade_price, 6) + 0.0 AS trade_price, trade_qty FROM oe
""")
def j1(spark, sf):
    joined = ev.orders_with_events(b.oe_orders(spark, sf), b.oe_events(spark, sf))
    return joined.select(
        "trade_date", "ticker", "order_id", "order_ts", "event_ts", "side", "event_side", "event_type", "trade_code",
        r("trade_price").alias("trade_price"), "trade_qty",
    )


@query("P6_survival", """
SELECT o.order_id, event_ts, count(*) AS n,
  greatest(CAST(0 AS DOUBLE), CAST(date_diff('microsecond', order_ts, event_ts) AS DOUBLE) / 1000) AS survival_ms
FROM oe_orders o JOIN oe_events e USING (trade_date, ticker, order_id) GROUP BY o.order_id, event_ts, order_ts
""")
def p6(spark, sf):
    pairs = ev.all_order_events(b.oe_orders(spark, sf), b.oe_events(spark, sf))
    timed = pairs.withColumn("survival_ms", ev.survival_ms(F.col("order_ts"), F.col("event_ts")))
    return timed.groupBy("order_id", "event_ts", "survival_ms").agg(F.count(F.lit(1)).alias("n"))


@query("DD1_first_event_per_key", """
SELECT trade_date, ticker, order_id, event_ts, event_side, event_type,
  trade_code, round(trade_price, 6) + 0.0 AS trade_price, trade_qty
FROM oe_events
QUALIFY row_number() OVER (PARTITION BY trade_date, ticker, order_id
  ORDER BY event_ts, event_side, CASE WHEN event_type = 'cancel' THEN 0 ELSE 1 END, event_type, trade_code, oe_events.trade_price, trade_qty) = 1
""")
def dd1(spark, sf):
    first = ev.first_events(b.oe_events(spark, sf))
    return rounded(
        first.select(*KEYS, "event_ts", "event_side", "event_type", "trade_code", "trade_price", "trade_qty")
    )


@query("DD2_first_quote_per_instant", """
SELECT trade_date, ticker, date_trunc('hour', quote_ts) AS quote_ts,
  min(bid1) AS bid1 FROM qt GROUP BY ALL
""")
def dd2(spark, sf):
    # view events never share an instant; whole hours do
    hourly = b.qt(spark, sf).withColumn("quote_ts", F.date_trunc("hour", "quote_ts").cast("timestamp_ntz"))
    return asof.first_quotes(hourly).select("trade_date", "ticker", "quote_ts", "bid1")


@query("P7_order_features", """
SELECT order_id, round(order_price * order_qty, 6) + 0.0 AS order_amount, is_buy, round(log_qty, 6) + 0.0 AS log_qty,
  round(mid_price, 6) + 0.0 AS mid_price, round(spread, 6) + 0.0 AS spread,
  round(spread / nullif(mid_price, 0) * 10000, 4) + 0.0 AS spread_bps,
  round(order_price - mid_price, 6) + 0.0 AS price_vs_mid,
  round((order_price - mid_price) / nullif(mid_price, 0) * 10000, 4) + 0.0 AS price_vs_mid_bps FROM tkm
""")
def p7(spark, sf):
    out = ev.with_order_features(b.tk(spark, sf)).select(
        "order_id", "order_amount", "is_buy", "log_qty", "mid_price", "spread", "spread_bps", "price_vs_mid", "price_vs_mid_bps"
    )
    return out.withColumns({c: r(c, 4 if c.endswith("bps") else 6) for c, k in out.dtypes if k == "double"})


@query("P8_trading_hours", """
SELECT order_id, order_ts FROM tkm
WHERE tod BETWEEN 34200000000 AND 41400000000 OR tod BETWEEN 46800000000 AND 53820000000
""")
def p8(spark, sf):
    return ev.in_hours(b.tk(spark, sf)).select("order_id", "order_ts")


SESSION_SQL = """
CASE WHEN (tod >= 33300000000 AND tod < 34200000000) OR tod BETWEEN 53820000000 AND 54000000000 THEN 1 ELSE 0 END AS in_auction,
CASE WHEN tod BETWEEN 34200000000 AND 41400000000 THEN 1 ELSE 0 END AS in_morning,
CASE WHEN tod BETWEEN 46800000000 AND 53820000000 THEN 1 ELSE 0 END AS in_afternoon,
round(CAST(tod - 34200000000 AS DOUBLE) / 1000000, 6) + 0.0 AS seconds_since_market_open,
round(sin(2 * pi() * (CAST(tod - 34200000000 AS DOUBLE) / 1000000) / 16200), 6) + 0.0 AS time_sin,
round(cos(2 * pi() * (CAST(tod - 34200000000 AS DOUBLE) / 1000000) / 16200), 6) + 0.0 AS time_cos
"""


@query("P9_P23_session_features", f"SELECT order_id, {SESSION_SQL} FROM tkm")
def p9(spark, sf):
    out = ev.with_session_features(b.tk(spark, sf))
    return rounded(
        out.select(
            "order_id", "in_auction", "in_morning", "in_afternoon", "seconds_since_market_open", "time_sin", "time_cos"
        )
    )


@query("P11_allow_lists", """
SELECT trade_date, ticker, count(*) AS n FROM tk
WHERE trade_date IN ('20240105', '20240106') AND ticker IN ('T1', 'T4', 'T7') GROUP BY ALL
""")
def p11(spark, sf):
    kept = ev.restrict(b.tk(spark, sf), ["20240105", "20240106"], ["T1", "T4", "T7"])
    return kept.groupBy("trade_date", "ticker").agg(F.count(F.lit(1)).alias("n"))


def asof_sql(orders: str, grid: int, tolerance: int) -> str:
    return f"""
qa AS (SELECT *, CAST(date_diff('microsecond', CAST('1970-01-01' AS TIMESTAMP), quote_ts) AS BIGINT) AS qus FROM qt),
span AS (SELECT trade_date, ticker, min(qus) - min(qus) % {grid} AS gmin, max(qus) - max(qus) % {grid} AS gmax FROM qa GROUP BY ALL),
oa AS (SELECT *, CAST(date_diff('microsecond', CAST('1970-01-01' AS TIMESTAMP), order_ts) AS BIGINT) AS ous FROM {orders}),
ob AS (SELECT oa.*, gmin, gmax, least(ous - ous % {grid}, gmax) AS probe FROM oa LEFT JOIN span USING (trade_date, ticker)),
oc AS (SELECT *, coalesce(probe >= gmin AND ous - probe <= {tolerance}, false) AS ok FROM ob),
matched AS (
  SELECT o.*, CASE WHEN ok THEN make_timestamp(probe) END AS quote_ts, CASE WHEN ok THEN q.bid1 END AS qbid1,
    CASE WHEN ok THEN q.ask1 END AS qask1, CASE WHEN ok THEN q.bid_vol1 END AS qbid_vol1,
    CASE WHEN ok THEN q.ask_vol1 END AS qask_vol1, CASE WHEN ok THEN q.prev_close END AS qprev_close
  FROM oc o ASOF LEFT JOIN qa q ON o.trade_date = q.trade_date AND o.ticker = q.ticker AND o.probe >= q.qus)
"""


@query("J2_J3_asof_quotes", ", " + asof_sql("tk", 600_000_000, 7_200_000_000) + """
SELECT order_id, quote_ts, round(qbid1, 6) + 0.0 AS bid1, round(qask1, 6) + 0.0 AS ask1,
  qbid_vol1 AS bid_vol1, qask_vol1 AS ask_vol1, qprev_close AS prev_close FROM matched
""")
def j2(spark, sf):
    orders = b.tk(spark, sf).select("trade_date", "ticker", "order_id", "order_ts")
    quotes = asof.first_quotes(b.qt(spark, sf))
    out = asof.with_quotes(orders, quotes, grid_us=10 * times.MINUTE, tolerance_us=2 * times.HOUR)
    return rounded(out.select("order_id", "quote_ts", "bid1", "ask1", "bid_vol1", "ask_vol1", "prev_close"))


@query("P10_event_stream", """
, joined AS (SELECT * FROM st WHERE CAST(order_ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '11:30:00'
    OR CAST(order_ts AS TIME) BETWEEN TIME '13:00:00' AND TIME '14:57:00'
  QUALIFY row_number() OVER (PARTITION BY trade_date, ticker, order_id
    ORDER BY order_ts, event_ts, event_side, CASE WHEN event_type = 'cancel' THEN 0 ELSE 1 END, event_type, trade_code, trade_price, trade_qty) = 1),
""" + asof_sql("joined", 100_000, 3_600_000_000) + """
SELECT trade_date, ticker, order_id, order_ts, event_ts, side, order_price, order_qty, event_side, event_type, trade_code,
  trade_price, trade_qty, quote_ts, round(qbid1, 6) + 0.0 AS bid1, round(qask1, 6) + 0.0 AS ask1,
  greatest(CAST(0 AS DOUBLE), CAST(date_diff('microsecond', order_ts, event_ts) AS DOUBLE) / 1000) AS survival_ms,
  round(ln(1 + coalesce(order_qty, 0)), 6) + 0.0 AS log_qty, round((qbid1 + qask1) / 2, 6) + 0.0 AS mid_price
FROM matched
""")
def p10(spark, sf):
    orders, trades = ev.timed_orders(b.raw_orders(spark, sf)), ev.side_events(b.raw_trades(spark, sf))
    stream = event_stream(orders, trades, asof.first_quotes(b.qt(spark, sf)), tolerance_us=times.HOUR)
    return rounded(
        stream.select(
            "trade_date", "ticker", "order_id", "order_ts", "event_ts", "side", "order_price", "order_qty",
            "event_side", "event_type", "trade_code", "trade_price", "trade_qty", "quote_ts", "bid1", "ask1",
            "survival_ms", "log_qty", "mid_price",
        )
    )


@query("P37_price_line", """
SELECT trade_date, ticker, date_trunc('minute', quote_ts) AS quote_ts, min(bid1) AS price FROM qt GROUP BY ALL
""")
def p37(spark, sf):
    from tapewatch.sources.market import price_line

    lines = b.qt(spark, sf).select(
        "trade_date",
        "ticker",
        F.date_format("quote_ts", "yyyyMMdd").alias("date"),
        F.date_format("quote_ts", "HHmm'0000'").cast("int").cast("string").alias("time"),
        F.col("bid1").alias("trade_price"),
    )
    return price_line(lines, "trade_price")


@query("T1_sorted_orders", """
SELECT trade_date, ticker, order_id, row_number() OVER (PARTITION BY trade_date, ticker ORDER BY order_ts, order_id) AS place FROM tk
""")
def t1(spark, sf):
    from pyspark.sql import Window

    from tapewatch.operators.ordered import measure_groups, running_totals

    orders = b.tk(spark, sf).select("trade_date", "ticker", "order_id", "order_ts")
    keys = ["trade_date", "ticker"]
    by_time = Window.partitionBy(*keys).orderBy("order_ts", "order_id")
    placed = measure_groups(orders, keys).each(
        orders,
        lambda df: df.withColumn("place", F.row_number().over(by_time).cast("bigint")),
        lambda df: running_totals(df, keys, [F.col("order_ts"), F.col("order_id")], {"place": F.lit(1)}),
    )
    return placed.drop("order_ts")
