"""Ranking metrics, curves, sweeps and distributions of scores."""

from pyspark.sql import functions as F

from queries import bindings as b
from queries.registry import query, r, rounded
from tapewatch.operators import metrics as m
from tapewatch.plans import reports

IDS = ["trade_date", "ticker", "order_id"]


def cubed(df):
    """Scores spread towards 0, where the threshold sweep looks."""
    p = F.col("predicted_proba")
    return df.withColumn("predicted_proba", p * p * p)


def steps_sql(table: str, group: str) -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""
, d AS (SELECT {g}predicted_proba AS s, count(*) AS n, CAST(sum(y_label) AS DOUBLE) AS p FROM {table} GROUP BY ALL),
k AS (SELECT *, sum(n) OVER w AS nu, sum(p) OVER w AS pu, sum(n) OVER ({part}) AS nt, sum(p) OVER ({part}) AS pt FROM d
  WINDOW w AS ({part} ORDER BY s DESC))
"""


QUALITY = """
CAST(max(nt) AS BIGINT) AS samples, CAST(max(pt) AS BIGINT) AS positives,
round(sum(p * pu / nu) / nullif(max(pt), 0), 6) + 0.0 AS pr_auc,
round(sum((n - p) * (pu - p / 2)) / nullif(max(pt) * (max(nt) - max(pt)), 0), 6) + 0.0 AS roc_auc
"""


@query("M1_M2_ranking_quality", steps_sql("pr", "") + f"SELECT {QUALITY} FROM k")
def m1(spark, sf):
    return rounded(m.ranking_quality(b.pr(spark, sf)))


@query("M1_M2_M6_ranking_quality_by_ticker", steps_sql("pep", "ticker") + f"SELECT ticker, {QUALITY} FROM k GROUP BY ticker")
def m1_ticker(spark, sf):
    return rounded(m.ranking_quality(b.pe(spark, sf), ["ticker"]))


@query("A21_quality_by_month", steps_sql("(SELECT *, trade_date[1:6] AS month FROM pep)", "month") + f"""
SELECT month, {QUALITY}, round(max(pt) * 100 / max(nt), 6) AS positive_pct FROM k GROUP BY month
""")
def a21(spark, sf):
    return rounded(reports.quality_by_month(b.pe(spark, sf)))


def top_sql(table: str, ids: str, shares: str, group: str = "") -> str:
    part = f"PARTITION BY {group} " if group else ""
    g = f"{group}, " if group else ""
    return f"""
, ranked AS (SELECT *, row_number() OVER ({part} ORDER BY predicted_proba DESC, {ids}) AS rk, count(*) OVER ({part}) AS n,
  sum(y_label) OVER ({part}) AS pos FROM {table}),
ks AS (SELECT *, CAST(greatest(1, floor(n * share)) AS BIGINT) AS k FROM ranked CROSS JOIN (SELECT unnest([{shares}]) AS share)),
agg AS (SELECT {g}share, k, min(predicted_proba) AS score_at_k, sum(y_label) / k AS prec, least(max(pos) / k, 1) AS ceil_p FROM ks WHERE rk <= k GROUP BY {g}share, k)
SELECT {g}share, k, round(score_at_k, 6) + 0.0 AS score_at_k, round(prec, 6) + 0.0 AS precision, round(ceil_p, 6) + 0.0 AS ceiling,
  round(coalesce(prec / nullif(ceil_p, 0), 0), 6) + 0.0 AS achievement FROM agg
"""


def share_list(shares) -> str:
    return ", ".join(f"CAST({s} AS DOUBLE)" for s in shares)


@query("T2_M3_precision_at_top_share", top_sql("pep", "trade_date, ticker, order_id", share_list(m.WIDE_TOP_SHARES)))
def t2(spark, sf):
    return rounded(m.top_share_precision(b.pe(spark, sf), IDS, m.WIDE_TOP_SHARES))


@query("T2_M6_precision_at_top_share_by_language", top_sql("pr", "doc_id", share_list(m.TOP_SHARES), "ticker"))
def t2_group(spark, sf):
    return rounded(m.top_share_precision(b.pr(spark, sf), ["doc_id"], m.TOP_SHARES, ["ticker"]))


@query("M4_W10_curve_points", steps_sql("pr", "") + """
SELECT round(s, 6) AS threshold, round(pu / nu, 6) AS precision, round(pu / pt, 6) AS recall,
  round((nu - pu) / (nt - pt), 6) AS false_positive_rate, round(pt / nt, 6) AS baseline FROM k
UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, round(max(pt) / max(nt), 6) FROM k
""")
def m4(spark, sf):
    return rounded(m.curve_points(b.pr(spark, sf)))


SWEEP = """
, c AS (SELECT *, predicted_proba * predicted_proba * predicted_proba AS s FROM pep),
g AS (SELECT step::INT AS step, pow(10::DOUBLE, -6 + step * (5::DOUBLE / 99)) AS threshold FROM (SELECT unnest(range(100)) AS step)),
t AS (SELECT step, threshold, count(*) FILTER (y_label = 1 AND s >= threshold) AS tp, count(*) FILTER (y_label = 0 AND s >= threshold) AS fp,
  count(*) FILTER (y_label = 1 AND s < threshold) AS fn, count(*) FILTER (y_label = 0 AND s < threshold) AS tn FROM g CROSS JOIN c GROUP BY ALL),
u AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM t),
v AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM u)
SELECT step, tp, fp, fn, tn, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1,
  round(threshold * 1000, 6) AS threshold, CASE WHEN row_number() OVER (ORDER BY f1 DESC, step) = 1 THEN 1 ELSE 0 END AS is_best FROM v
"""


@query("M5_threshold_sweep", SWEEP)
def m5(spark, sf):
    out = m.threshold_sweep(cubed(b.pe(spark, sf)))
    return rounded(out.withColumn("threshold", F.col("threshold") * 1000))


@query("A11_confusion_by_ticker", """
SELECT CASE WHEN grouping(ticker) = 1 THEN 'total' ELSE 'ticker' END AS scope, ticker, count(*) FILTER (predicted_proba <= 0.5 AND y_label = 0) AS tn, count(*) FILTER (predicted_proba > 0.5 AND y_label = 0) AS fp,
  count(*) FILTER (predicted_proba <= 0.5 AND y_label = 1) AS fn, count(*) FILTER (predicted_proba > 0.5 AND y_label = 1) AS tp
FROM pep GROUP BY ROLLUP (ticker)
""")
def a11(spark, sf):
    return m.confusion(b.pe(spark, sf), group="ticker")


@query("A12_classification_report", """
, c AS (SELECT count(*) FILTER (predicted_binary = 0 AND y_label = 0) AS tn, count(*) FILTER (predicted_binary = 1 AND y_label = 0) AS fp,
  count(*) FILTER (predicted_binary = 0 AND y_label = 1) AS fn, count(*) FILTER (predicted_binary = 1 AND y_label = 1) AS tp FROM pep),
k AS (SELECT '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, tn + fp AS support, tn AS hit FROM c
  UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), tp + fn, tp FROM c),
f AS (SELECT *, 2 * p * r / (p + r) AS f FROM k)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
""")
def a12(spark, sf):
    return rounded(m.classification_report(b.pe(spark, sf)))


@query("A13_ticker_metric_summary", steps_sql("pep", "ticker") + """
, q AS (SELECT ticker, sum(p * pu / nu) / max(pt) AS "PR-AUC", sum((n - p) * (pu - p / 2)) / (max(pt) * (max(nt) - max(pt))) AS "ROC-AUC" FROM k GROUP BY ticker HAVING max(pt) > 0),
tall AS (UNPIVOT q ON "PR-AUC", "ROC-AUC" INTO NAME metric VALUE value)
SELECT metric, round(avg(value), 6) AS mean, round(max(value), 6) AS best, arg_min(ticker, (-value, ticker)) AS best_ticker,
  round(min(value), 6) AS worst, arg_min(ticker, (value, ticker)) AS worst_ticker, round(stddev_samp(value), 6) AS std FROM tall GROUP BY metric
""")
def a13(spark, sf):
    tall = m.evaluation(b.pe(spark, sf), IDS, ["ticker"]).where("metric IN ('PR-AUC', 'ROC-AUC')")
    return rounded(reports.ticker_metric_summary(tall))


@query("A13_ticker_rates", """
, c AS (SELECT CASE WHEN grouping(ticker) = 1 THEN 'total' ELSE 'ticker' END AS scope, ticker, count(*) FILTER (predicted_binary = 0 AND y_label = 0) AS tn, count(*) FILTER (predicted_binary = 1 AND y_label = 0) AS fp,
  count(*) FILTER (predicted_binary = 0 AND y_label = 1) AS fn, count(*) FILTER (predicted_binary = 1 AND y_label = 1) AS tp FROM pep GROUP BY ROLLUP (ticker))
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) + 0.0 AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) + 0.0 AS recall FROM c
""")
def a13_rates(spark, sf):
    return rounded(reports.ticker_rates(m.confusion(b.pe(spark, sf), group="ticker")))


@query("M7_evaluation_record", steps_sql("pr", "") + """
SELECT metric, round(value, 6) + 0.0 AS value FROM (
  SELECT 'PR-AUC' AS metric, sum(p * pu / nu) / max(pt) AS value FROM k
  UNION ALL SELECT 'ROC-AUC', sum((n - p) * (pu - p / 2)) / (max(pt) * (max(nt) - max(pt))) FROM k
  UNION ALL SELECT 'samples', CAST(max(nt) AS DOUBLE) FROM k UNION ALL SELECT 'positives', max(pt) FROM k)
""")
def m7(spark, sf):
    tall = m.evaluation(b.pr(spark, sf), ["doc_id"])
    return rounded(tall.where("metric NOT LIKE 'Precision%'"))


@query("A17_score_histogram", """
, e AS (SELECT y_label, min(predicted_proba) AS lo, max(predicted_proba) AS hi, count(*) AS n FROM pr GROUP BY y_label),
x AS (SELECT y_label, lo, (hi - lo) / 50 AS w, n, CAST(least(49, floor((predicted_proba - lo) / ((hi - lo) / 50))) AS INT) AS bin FROM pr JOIN e USING (y_label))
SELECT y_label, bin, round(lo + bin * w, 6) AS bin_from, count(*) AS rows, round(count(*) / (n * w), 4) AS density FROM x GROUP BY y_label, bin, lo, w, n
""")
def a17(spark, sf):
    out = m.score_histogram(b.pr(spark, sf))
    return out.withColumns({"bin_from": r("bin_from"), "density": r("density", 4)})


@query("A17_score_box", """
, q AS (SELECT y_label, quantile_cont(predicted_proba, 0.25) AS q1, quantile_cont(predicted_proba, 0.5) AS median,
  quantile_cont(predicted_proba, 0.75) AS q3 FROM pr GROUP BY y_label)
SELECT y_label, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(predicted_proba) FILTER (predicted_proba >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(predicted_proba) FILTER (predicted_proba <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high FROM pr JOIN q USING (y_label) GROUP BY ALL
""")
def a17_box(spark, sf):
    return rounded(m.score_box(b.pr(spark, sf)))


@query("W11_score_ecdf", """
SELECT y_label, predicted_proba, trade_date, ticker, order_id,
  round(row_number() OVER (PARTITION BY y_label ORDER BY predicted_proba, trade_date, ticker, order_id) / count(*) OVER (PARTITION BY y_label), 6) AS ecdf
FROM (SELECT * REPLACE (round(predicted_proba, 6) + 0.0 AS predicted_proba) FROM pep)
""")
def w11(spark, sf):
    return rounded(m.score_ecdf(rounded(b.pe(spark, sf)), IDS))


@query("W12_best_ranked_rows", """
SELECT trade_date, ticker, order_id, round(predicted_proba, 6) AS predicted_proba, y_label,
  row_number() OVER (ORDER BY predicted_proba DESC, trade_date, ticker, order_id) - 1 AS rank FROM pep
QUALIFY rank < 5000
""")
def w12(spark, sf):
    return rounded(m.best_ranked(b.pe(spark, sf), IDS))


@query("T5_top_share_rows", """
SELECT trade_date, ticker, order_id, y_label, round(predicted_proba, 6) AS predicted_proba FROM pep
QUALIFY predicted_proba >= quantile_cont(predicted_proba, 0.95) OVER (PARTITION BY ticker, trade_date)
""")
def t5(spark, sf):
    out = m.top_share_rows(b.pe(spark, sf), 0.05)
    return rounded(out.select("trade_date", "ticker", "order_id", "y_label", "predicted_proba"))


@query("P35_mean_focal_loss", """
, t AS (SELECT predicted_proba AS p, y_label AS y FROM pep),
w AS (SELECT *, (CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END) * pow(1 - (CASE WHEN y = 1 THEN p ELSE 1 - p END), 2) AS w FROM t)
SELECT round(avg(w * -(CASE WHEN y = 1 THEN ln(p + 1e-8) ELSE ln(1 - p + 1e-8) END)), 6) AS focal_loss FROM w
""")
def p35(spark, sf):
    from tapewatch.plans.models import mean_focal_loss

    return rounded(mean_focal_loss(b.pe(spark, sf)))
