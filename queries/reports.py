"""Summary tables."""

from pyspark.sql import functions as F

from queries import bindings as b
from queries.registry import query, r, rounded
from tapewatch.functions import times
from tapewatch.plans import reports

PERIOD_SQL = """CASE WHEN tod >= 33300000000 AND tod < 33900000000 THEN 'early_auction' WHEN tod >= 33900000000 AND tod < 34200000000 THEN 'late_auction'
  WHEN tod BETWEEN 34200000000 AND 36000000000 THEN 'morning_opening' WHEN tod > 36000000000 AND tod < 41400000000 THEN 'morning_trading'
  WHEN tod >= 41400000000 AND tod < 46800000000 THEN 'lunch_break' WHEN tod BETWEEN 46800000000 AND 47700000000 THEN 'afternoon_opening'
  WHEN tod > 47700000000 AND tod < 53100000000 THEN 'afternoon_trading' WHEN tod BETWEEN 53100000000 AND 54000000000 THEN 'closing'
  ELSE 'outside_hours' END"""
TIMED = f"""
, timed AS (SELECT pep.*, {PERIOD_SQL} AS period, hour(order_ts) AS hr FROM pep JOIN tkm USING (trade_date, ticker, order_id, order_ts))
"""


@query("A4_ticker_statistics", """
SELECT ticker, count(*) AS samples, CAST(sum(y_label) AS BIGINT) AS positives, round(avg(y_label) * 100, 6) AS positive_pct FROM pep GROUP BY ticker
""")
def a4(spark, sf):
    return rounded(reports.ticker_statistics(b.pe(spark, sf)))


@query("A4_ticker_statistics_summary", """
, t AS (SELECT ticker, count(*) AS n, sum(y_label) AS p FROM pep GROUP BY ticker)
SELECT count(*) AS tickers, round(avg(n), 6) AS mean_samples, round(avg(p), 6) AS mean_positives, round(avg(p * 100 / n), 6) AS mean_positive_pct FROM t
""")
def a4_summary(spark, sf):
    return rounded(reports.ticker_statistics_summary(b.pe(spark, sf)))


@query("A6_ticker_inventory", """
, t AS (SELECT ticker, count(*) AS samples FROM pep GROUP BY ticker HAVING count(*) >= 50)
SELECT ticker, samples, round(samples * 100 / sum(samples) OVER (), 6) AS share_pct FROM t
""")
def a6(spark, sf):
    return rounded(reports.ticker_inventory(b.pe(spark, sf), 50))


@query("A6_inventory_summary", """
, t AS (SELECT ticker, count(*) AS samples FROM pep GROUP BY ticker)
SELECT count(*) AS tickers, CAST(sum(samples) AS BIGINT) AS rows, round(avg(samples), 6) AS mean_samples, round(quantile_cont(samples, 0.5), 6) AS median_samples FROM t
""")
def a6_summary(spark, sf):
    return rounded(reports.inventory_summary(b.pe(spark, sf)))


@query("A7_label_time_distribution", TIMED + """
SELECT 'period' AS kind, period AS part, count(*) AS rows, CAST(sum(y_label) AS BIGINT) AS y_label_sum, CAST(sum(predicted_binary) AS BIGINT) AS predicted_binary_sum,
  round(avg(y_label), 4) AS y_label_mean, round(avg(predicted_binary), 4) AS predicted_binary_mean FROM timed GROUP BY period
UNION ALL SELECT 'hour', CAST(hr AS VARCHAR), count(*), CAST(sum(y_label) AS BIGINT), CAST(sum(predicted_binary) AS BIGINT),
  round(avg(y_label), 4), round(avg(predicted_binary), 4) FROM timed GROUP BY hr
""")
def a7(spark, sf):
    return rounded(reports.label_time_distribution(b.pe(spark, sf), ["y_label", "predicted_binary"]), 4)


@query("A8_window_rates", TIMED + """
SELECT CASE WHEN period IN ('morning_opening', 'afternoon_opening') THEN 'opening' ELSE 'abnormal' END AS window, count(*) AS rows,
  CAST(sum(y_label) AS BIGINT) AS positives, round(avg(y_label) * 100, 6) AS positive_pct FROM timed
WHERE period IN ('morning_opening', 'afternoon_opening', 'late_auction', 'lunch_break', 'outside_hours') GROUP BY 1
""")
def a8(spark, sf):
    return rounded(reports.window_rates(b.pe(spark, sf)))


@query("A9_label_totals", """
SELECT label, count(*) AS samples, min(order_ts) AS first_order, max(order_ts) AS last_order, CAST(sum(v) AS BIGINT) AS positives, round(avg(v) * 100, 6) AS positive_pct
FROM (SELECT 'y_label' AS label, order_ts, y_label AS v FROM pep UNION ALL SELECT 'predicted_binary', order_ts, predicted_binary FROM pep) GROUP BY label
""")
def a9(spark, sf):
    return rounded(reports.label_totals(b.pe(spark, sf), ["y_label", "predicted_binary"]))


@query("A10_positives_by_period", TIMED + "SELECT period, count(*) AS positives FROM timed WHERE y_label = 1 GROUP BY period")
def a10(spark, sf):
    return reports.positives_by_period(b.pe(spark, sf))


@query("A10_hourly_positive_rate", """
SELECT CAST(hour(order_ts) AS INT) AS hour, round(avg(y_label) * 100, 6) AS positive_pct FROM pep GROUP BY 1
""")
def a10_hour(spark, sf):
    return rounded(reports.hourly_positive_rate(b.pe(spark, sf)))


@query("A14_prediction_summary", """
SELECT count(*) AS rows, CAST(sum(y_label) AS BIGINT) AS positives, CAST(sum(predicted_binary) AS BIGINT) AS predicted_positives,
  round(avg(predicted_binary) * 100, 6) AS predicted_pct, round(min(predicted_proba), 6) AS min_proba, round(max(predicted_proba), 6) AS max_proba,
  round(avg(predicted_proba), 6) AS mean_proba, round(quantile_cont(predicted_proba, 0.5), 6) AS median_proba,
  round(stddev_samp(predicted_proba), 6) AS std_proba FROM pep
""")
def a14(spark, sf):
    return rounded(reports.prediction_summary(b.pe(spark, sf)))


@query("A14_prediction_summary_by_ticker", """
SELECT ticker, count(*) AS rows, CAST(sum(y_label) AS BIGINT) AS positives, round(avg(predicted_proba), 4) AS mean_proba,
  round(max(predicted_proba), 4) AS max_proba, CAST(sum(predicted_binary) AS BIGINT) AS predicted_positives FROM pep GROUP BY ticker
""")
def a14_ticker(spark, sf):
    return rounded(reports.prediction_summary_by_ticker(b.pe(spark, sf)), 4)


@query("A15_daily_summary", """
SELECT trade_date, count(*) AS rows, CAST(sum(y_label) AS BIGINT) AS positives, round(avg(predicted_proba), 4) AS mean_proba,
  round(max(predicted_proba), 4) AS max_proba, round(stddev_samp(predicted_proba), 4) AS std_proba, CAST(sum(predicted_binary) AS BIGINT) AS predicted_positives,
  round(avg(y_label), 6) AS anomaly_rate, round(avg(predicted_binary), 6) AS pred_anomaly_rate FROM pep GROUP BY trade_date
""")
def a15(spark, sf):
    return rounded(reports.daily_summary(b.pe(spark, sf)))


@query("A15_monthly_summary", """
, d AS (SELECT trade_date[1:6] AS month, trade_date, count(*) AS n, sum(y_label) AS p, sum(predicted_binary) AS pp FROM pep GROUP BY ALL),
s AS (SELECT trade_date[1:6] AS month, avg(predicted_proba) AS a, max(predicted_proba) AS mx, stddev_samp(predicted_proba) AS sd FROM pep GROUP BY ALL)
SELECT month, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(p) AS BIGINT) AS positives, round(sum(p) * 100 / sum(n), 6) AS anomaly_pct,
  CAST(sum(pp) AS BIGINT) AS predicted_positives, count(*) AS trading_days, round(avg(n), 6) AS mean_daily_rows, round(avg(p), 6) AS mean_daily_positives,
  CAST(max(p) AS BIGINT) AS max_daily_positives, CAST(min(p) AS BIGINT) AS min_daily_positives, round(any_value(a), 6) AS mean_proba,
  round(any_value(mx), 6) AS max_proba, round(any_value(sd), 6) AS std_proba FROM d JOIN s USING (month) GROUP BY month
""")
def a15_month(spark, sf):
    return rounded(reports.monthly_summary(b.pe(spark, sf)))


@query("A16_alert_counts", """
SELECT ticker, trade_date, count(*) AS rows, CAST(sum(y_label) AS BIGINT) AS positives, count(*) FILTER (predicted_proba > 0.8) AS alerts FROM pep GROUP BY ALL
""")
def a16(spark, sf):
    return reports.alert_counts(b.pe(spark, sf), 0.8)


@query("T7_first_rows", """
SELECT trade_date, ticker, order_id, order_ts, y_label FROM pep ORDER BY trade_date, ticker, order_id LIMIT 1000
""")
def t7(spark, sf):
    wanted = ["trade_date", "ticker", "order_id", "order_ts", "y_label"]
    return reports.first_rows(b.pe(spark, sf), wanted, ["trade_date", "ticker", "order_id"])


@query("J7_marked_orders", """
, qp AS (SELECT trade_date, ticker, quote_ts, bid1 AS price FROM qt)
SELECT p.trade_date, p.ticker, p.order_id, p.y_label,
  CASE WHEN date_diff('microsecond', q.quote_ts, p.order_ts) <= 7200000000 THEN q.quote_ts END AS quote_ts,
  CASE WHEN date_diff('microsecond', q.quote_ts, p.order_ts) <= 7200000000 THEN round(q.price, 6) + 0.0 END AS price
FROM pep p
ASOF LEFT JOIN qp q ON p.trade_date = q.trade_date AND p.ticker = q.ticker AND p.order_ts >= q.quote_ts
""")
def j7(spark, sf):
    from tapewatch.operators.asof import first_quotes
    from tapewatch.sources.market import marked_orders

    line = first_quotes(b.qt(spark, sf).select("trade_date", "ticker", "quote_ts", F.col("bid1").alias("price")))
    out = marked_orders(b.pe(spark, sf), line, 2 * times.HOUR)
    return out.select("trade_date", "ticker", "order_id", "y_label", "quote_ts", r("price").alias("price"))
