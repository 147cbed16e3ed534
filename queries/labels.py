"""Labelling rules and quantiles."""

from pyspark.sql import functions as F

from queries import bindings as b
from queries.registry import query, r, rounded
from tapewatch.operators import events as ev
from tapewatch.operators import features as fx
from tapewatch.operators import labels as lb
from tapewatch.operators.ordered import exact_quantiles
from tapewatch.plans import reports, stages

MONTH_MS = 30 * 24 * 3600 * 1000


def oe(spark, sf):
    joined = ev.orders_with_events(b.oe_orders(spark, sf), b.oe_events(spark, sf))
    return joined.withColumns(
        {
            "survival_ms": ev.survival_ms(F.col("order_ts"), F.col("event_ts")),
            "order_qty": F.col("trade_qty"),
            "order_price": F.col("trade_price"),
        }
    )


def booked(spark, sf):
    return fx.with_mid(fx.with_book(b.tk(spark, sf)))


@query("R1_fast_cancel", f"""
SELECT order_id, survival_ms < {MONTH_MS} AND event_type = 'cancel' AS "flag_R1" FROM oe
""")
def r1(spark, sf):
    return oe(spark, sf).select("order_id", lb.fast_cancel(MONTH_MS).alias("flag_R1"))


BASE_RULES = """
, rules AS (SELECT *, survival_ms < 50 AND event_type = 'cancel' AS r1,
  coalesce(survival_ms < 1000 AND spread <> 0 AND abs(delta_mid) >= 4 * spread, false) AS r2 FROM tkm)
"""


@query("R2_R3_base_labels", BASE_RULES + """
SELECT order_id, r1 AS "flag_R1", r2 AS "flag_R2", CASE WHEN r1 AND r2 THEN 1 ELSE 0 END AS y_label FROM rules
""")
def r2(spark, sf):
    return lb.with_base_labels(booked(spark, sf)).select("order_id", "flag_R1", "flag_R2", "y_label")


@query("A2_label_summary", f"""
SELECT CASE WHEN grouping(trade_date) = 1 THEN 'total' ELSE 'trade_date' END AS scope, trade_date, count(*) AS samples, CAST(sum((survival_ms < {MONTH_MS} AND event_type = 'cancel')::INT) AS BIGINT) AS positives,
  round(avg((survival_ms < {MONTH_MS} AND event_type = 'cancel')::INT), 6) AS positive_rate
FROM oe GROUP BY ROLLUP (trade_date)
""")
def a2(spark, sf):
    labelled = lb.with_base_labels(oe(spark, sf), r1_ms=MONTH_MS)
    return rounded(reports.label_summary(labelled))


@query("A1_event_stream_summary", """
SELECT trade_date, count(DISTINCT ticker) AS tickers, count(DISTINCT order_id) AS orders, count(*) AS rows FROM oe GROUP BY trade_date
""")
def a1(spark, sf):
    return reports.event_stream_summary(oe(spark, sf))


@query("A3_size_quantiles", """
SELECT trade_date, ticker, round(quantile_cont(order_qty, 0.9), 6) AS p90, round(quantile_cont(order_qty, 0.95), 6) AS p95,
  round(quantile_cont(order_qty, 0.98), 6) AS p98 FROM tk GROUP BY ALL
""")
def a3(spark, sf):
    return rounded(lb.size_quantiles(b.tk(spark, sf)))


@query("A3_size_quantiles_by_ticker", """
SELECT ticker, round(quantile_cont(order_price, 0.9), 6) AS p90, round(quantile_cont(order_price, 0.95), 6) AS p95 FROM oe GROUP BY ALL
""")
def a3_ticker(spark, sf):
    return rounded(exact_quantiles(oe(spark, sf), ["ticker"], "order_price", {"p90": 0.9, "p95": 0.95}))


PATTERNS = BASE_RULES + """
, sized AS (SELECT *, quantile_cont(order_qty, 0.9) OVER p AS p90, quantile_cont(order_qty, 0.95) OVER p AS p95,
    tod BETWEEN 34200000000 AND 36000000000 OR tod BETWEEN 46800000000 AND 47700000000 AS opening
  FROM rules WINDOW p AS (PARTITION BY trade_date, ticker)),
pats AS (SELECT trade_date, ticker, order_id, order_ts, event_ts, order_qty, side, order_price, event_type, survival_ms, r1 AS "flag_R1", r2 AS "flag_R2",
  CASE WHEN r1 AND r2 THEN 1 ELSE 0 END AS y_label,
  CASE WHEN order_qty > p90 THEN 1 ELSE 0 END AS extreme_price_deviation,
  CASE WHEN opening THEN CASE WHEN (side = 'B' AND order_price > ask1 + 0.5 * spread) OR (side = 'S' AND order_price < bid1 - 0.5 * spread) THEN 1 ELSE 0 END
    WHEN (side = 'B' AND order_price > ask1) OR (side = 'S' AND order_price < bid1) THEN 1 ELSE 0 END AS aggressive_pricing,
  CASE WHEN NOT opening AND order_qty > p95 THEN 1 ELSE 0 END AS abnormal_large_order,
  CASE WHEN ((tod >= 33900000000 AND tod < 34200000000) OR (tod >= 41400000000 AND tod < 46800000000)) AND order_qty > p90 THEN 1 ELSE 0 END AS volatile_period_anomaly
  FROM sized),
counted AS (SELECT *, extreme_price_deviation + aggressive_pricing + abnormal_large_order + volatile_period_anomaly AS n FROM pats)
"""


@query("R4_R5_R6_R7_patterns", PATTERNS + """
SELECT order_id, extreme_price_deviation, aggressive_pricing, abnormal_large_order, volatile_period_anomaly FROM pats
""")
def r4(spark, sf):
    out = lb.label_orders(booked(spark, sf))
    return out.select("order_id", "extreme_price_deviation", "aggressive_pricing", "abnormal_large_order", "volatile_period_anomaly")


@query("R8_R9_L1_label_table", PATTERNS + """
SELECT * EXCLUDE (n), CASE WHEN n >= 2 THEN 1 ELSE 0 END AS enhanced_spoofing_conservative,
  CASE WHEN n >= 2 THEN 1 ELSE 0 END AS enhanced_spoofing_moderate,
  CASE WHEN y_label = 1 OR n >= 2 THEN 1 ELSE 0 END AS enhanced_spoofing_liberal,
  CASE WHEN n >= 3 THEN 1 ELSE 0 END AS enhanced_spoofing_strict,
  CASE WHEN y_label = 1 OR n >= 2 THEN 1 ELSE 0 END AS enhanced_combined FROM counted
""")
def r8(spark, sf):
    return stages.labels(b.tk(spark, sf))


@query("J5_group_statistics", """
SELECT order_id, round(order_qty - quantile_cont(order_qty, 0.95) OVER (PARTITION BY trade_date, ticker), 6) + 0.0 AS over_p95 FROM tk
""")
def j5(spark, sf):
    out = lb.with_size_quantiles(b.tk(spark, sf))
    return out.select("order_id", r(F.col("order_qty") - F.col("p95")).alias("over_p95"))
