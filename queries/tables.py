"""Sources, sinks and quality checks. Files are written from the given tables first, then read back."""

from pyspark.sql import functions as F

from queries import bindings as b
from queries.registry import query, rounded
from tapewatch.operators import events as ev
from tapewatch.operators import features as fx
from tapewatch.operators import quality as q
from tapewatch.plans import reports, stages
from tapewatch.session import scratch_path
from tapewatch.sources import raw_csv, tables
from tapewatch.schemas import RAW_NAMES

FEATURES = ["order_price", "order_qty", "bid1", "ask1", "spread", "delta_mid"]


def exchange_files(spark, sf):
    """Raw orders as the exchange delivers them: one GBK file per ticker-day, in mixed column orders."""
    base = scratch_path(spark, "exchange")
    back = {name: source for source, name in RAW_NAMES.items()}
    raw = b.raw_orders(spark, sf)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    layouts = {
        "even": ["date", "time", "order_id", "side", "order_price", "order_qty", "order_type"],
        "odd": ["order_id", "date", "time", "order_type", "order_qty", "order_price", "side"],
    }
    for kind, columns in layouts.items():
        rest = 0 if kind == "even" else 1
        part = raw.where(F.col("trade_date").cast("int") % 2 == rest)
        folders = part.select(F.col("trade_date").alias("d"), F.col("ticker").alias("t"), *[F.col(c).alias(back[c]) for c in columns])
        writer = folders.write.mode("append").partitionBy("d", "t").option("header", True).option("encoding", "gbk")
        writer.csv(f"{base}/{kind}")
    return [f"{base}/even/*/*/*.csv", f"{base}/odd/*/*/*.csv"]


@query("SC1_SC2_SC3_raw_csv_scan", """
SELECT date, time, order_id, side, order_price, order_qty, order_type FROM raw_orders
""")
def sc1(spark, sf):
    columns = ["date", "time", "order_id", "side", "order_price", "order_qty", "order_type"]
    return raw_csv.read_named(spark, exchange_files(spark, sf), columns, "gbk", placed=False)


def stored_stream(spark, sf):
    """The scored orders as a table of daily partitions."""
    path = scratch_path(spark, "table")
    tables.write_daily(b.pe(spark, sf), path)
    return path


@query("SC4_SK2_daily_partitions", """
SELECT trade_date, ticker, order_id, y_label FROM pep WHERE trade_date IN ('20240103', '20240117')
""")
def sc4(spark, sf):
    columns = ["trade_date", "ticker", "order_id", "y_label"]
    return tables.read_table(spark, stored_stream(spark, sf), dates=["20240103", "20240117"], columns=columns)


@query("SC5_folder_fallback", """
SELECT ticker, count(*) AS rows, CAST(sum(y_label) AS BIGINT) AS positives FROM pep GROUP BY ticker
""")
def sc5(spark, sf):
    root = scratch_path(spark, "root")
    tables.write_daily(b.pe(spark, sf), f"{root}/labels_select")
    found = tables.read_labels(spark, root)
    return found.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.sum("y_label").alias("positives"))


@query("SC6_column_pruned_scan", "SELECT trade_date, ticker, count(*) AS rows FROM pep GROUP BY ALL")
def sc6(spark, sf):
    pruned = tables.read_table(spark, stored_stream(spark, sf), columns=["trade_date", "ticker"])
    return pruned.groupBy("trade_date", "ticker").agg(F.count(F.lit(1)).alias("rows"))


@query("SC7_SK3_ticker_list_file", """
SELECT p.ticker, count(*) AS rows FROM pep p JOIN (SELECT DISTINCT ticker FROM tk WHERE event_type = 'cancel' AND order_price > 100) USING (ticker) GROUP BY ALL
""")
def sc7(spark, sf):
    from tapewatch.operators.selection import with_tickers

    path = scratch_path(spark, "tickers")
    listed = b.tk(spark, sf).where("event_type = 'cancel' AND order_price > 100").select(F.concat("ticker", F.lit("  ")).alias("t"))
    tables.write_text(listed.distinct().unionByName(listed.limit(1).select(F.lit("").alias("t"))), "t", path)
    kept = with_tickers(b.pe(spark, sf), tables.read_ticker_list(spark, path))
    return kept.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))


@query("SC8_SK4_predictions_table", """
SELECT trade_date, ticker, order_id, order_ts, y_label, round(predicted_proba, 6) + 0.0 AS predicted_proba, predicted_binary FROM pep
""")
def sc8(spark, sf):
    return rounded(tables.read_predictions(spark, stored_stream(spark, sf)))


@query("SC9_price_series_of_ticker_days", """
SELECT trade_date, ticker, quote_ts, round(bid1, 6) AS bid1 FROM qt WHERE trade_date IN ('20240103', '20240104') AND ticker IN ('T2', 'T3')
""")
def sc9(spark, sf):
    path = scratch_path(spark, "quotes")
    tables.write_daily(b.qt(spark, sf), path, ("ticker", "quote_ts"))
    line = tables.read_table(spark, path, ["20240103", "20240104"], ["T2", "T3"], ["trade_date", "ticker", "quote_ts", "bid1"])
    return rounded(line)


@query("SC10_latest_evaluation", """
SELECT 'ensemble' AS method, ticker AS scope, 'samples' AS metric, CAST(count(*) AS DOUBLE) AS value, TIMESTAMP '2025-02-02 00:00:00' AS run_ts FROM pep GROUP BY ticker
""")
def sc10(spark, sf):
    path = scratch_path(spark, "metrics")
    for run_ts, scale in (("2025-01-01 00:00:00", 10.0), ("2025-02-02 00:00:00", 1.0)):
        rows = b.pe(spark, sf).groupBy("ticker").agg((F.count(F.lit(1)) * scale).alias("value"))
        tables.append_metrics(
            rows.select(
                F.lit(run_ts).cast("timestamp_ntz").alias("run_ts"), F.lit("ensemble").alias("method"), F.col("ticker").alias("scope"),
                "ticker", F.lit("samples").alias("metric"), "value",
            ),
            path,
        )
    return tables.latest_run(tables.read_metrics(spark, path)).drop("ticker")


@query("SK1_event_stream_csv_export", """
SELECT trade_date, ticker, order_id, order_ts, event_type, order_price FROM tk
""")
def sk1(spark, sf):
    path = scratch_path(spark, "export")
    tables.export_event_stream_csv(b.tk(spark, sf), path)
    columns = ["trade_date", "ticker", "order_id", "order_ts", "event_ts", "event_type", "order_price"]
    from tapewatch.schemas import EVENT_STREAM_NAMES

    text = raw_csv.read_named(spark, [f"{path}/*/*.csv"], columns, "utf-8", EVENT_STREAM_NAMES, placed=False)
    return fx.typed_events(text).drop("event_ts")


@query("B1_DD3_multi_day_labels", """
SELECT CASE WHEN grouping(trade_date) = 1 THEN 'total' ELSE 'trade_date' END AS scope, trade_date, count(*) AS samples,
  CAST(sum((survival_ms < 50 AND event_type = 'cancel'
  AND coalesce(spread <> 0 AND abs(delta_mid) >= 4 * spread, false))::INT) AS BIGINT) AS positives FROM tkm GROUP BY ROLLUP (trade_date)
""")
def b1(spark, sf):
    source, out = scratch_path(spark, "stream"), scratch_path(spark, "labels")
    tables.write_daily(b.tk(spark, sf), source)
    return stages.run_labels(spark, source, out).drop("positive_rate")


@query("Q1_stream_counters", """
, pairs AS (SELECT trade_date, ticker, count(*) AS joined_rows, count(*) FILTER (event_ts < order_ts) AS negative_survival,
    count(*) - count(DISTINCT order_id) AS duplicate_rows, 
    count(*) FILTER (CAST(order_ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '11:30:00' OR CAST(order_ts AS TIME) BETWEEN TIME '13:00:00' AND TIME '14:57:00') AS rows_in_hours
  FROM st GROUP BY ALL),
un AS (SELECT trade_date, ticker, count(*) AS unmatched_events FROM st_events e
  WHERE NOT EXISTS (SELECT 1 FROM st_orders o WHERE o.trade_date = e.trade_date AND o.ticker = e.ticker AND o.order_id = e.order_id) GROUP BY ALL)
SELECT trade_date, ticker, coalesce(joined_rows, 0) AS joined_rows, coalesce(negative_survival, 0) AS negative_survival, coalesce(duplicate_rows, 0) AS duplicate_rows,
  coalesce(rows_in_hours, 0) AS rows_in_hours, coalesce(unmatched_events, 0) AS unmatched_events, round(rows_in_hours / joined_rows, 6) AS kept_share
FROM pairs FULL JOIN un USING (trade_date, ticker)
""")
def q1(spark, sf):
    orders, events = ev.timed_orders(b.raw_orders(spark, sf)), ev.side_events(b.raw_trades(spark, sf))
    return rounded(q.stream_counters(orders, events))


@query("Q1_repeated_order_counters", """
, o AS (SELECT trade_date, ticker, 'k' || CAST(CAST(order_id AS BIGINT) % 7 AS VARCHAR) AS order_id, order_ts FROM tk),
e AS (SELECT trade_date, ticker, 'k' || CAST(CAST(order_id AS BIGINT) % 7 AS VARCHAR) AS order_id, event_ts FROM tk)
SELECT trade_date, ticker, count(*) AS joined_rows, count(*) FILTER (event_ts < order_ts) AS negative_survival,
  count(*) - count(DISTINCT order_id) AS duplicate_rows FROM o JOIN e USING (trade_date, ticker, order_id) GROUP BY ALL
""")
def q1_repeated(spark, sf):
    repeated = b.tk(spark, sf).withColumn("order_id", F.concat(F.lit("k"), (F.col("order_id").cast("bigint") % 7).cast("string")))
    out = q.stream_counters(
        repeated.select("trade_date", "ticker", "order_id", "order_ts"),
        repeated.select("trade_date", "ticker", "order_id", "event_ts"),
    )
    return out.select("trade_date", "ticker", "joined_rows", "negative_survival", "duplicate_rows")


@query("Q1_date_mismatches", """
SELECT trade_date, ticker, count(*) AS rows, count(*) FILTER (date <> trade_date) AS mismatched_rows FROM raw_trades GROUP BY ALL
""")
def q1_dates(spark, sf):
    return q.date_mismatches(b.raw_trades(spark, sf))


@query("Q2_order_checks", """
SELECT trade_date, ticker, count(*) AS rows, count(*) FILTER (order_price <= 0) AS bad_prices, count(*) FILTER (order_qty % 100 <> 0) AS odd_lots FROM tk GROUP BY ALL
""")
def q2(spark, sf):
    return q.order_checks(b.tk(spark, sf))


@query("Q3_undecodable_text", """
SELECT count(*) AS rows, count(*) FILTER (contains(text, '�')) AS text, count(*) FILTER (contains(source, '�')) AS source FROM documents
""")
def q3(spark, sf):
    docs = b.table(spark, sf, "documents").select("text", "source")
    return q.undecodable_text(q.checked_input(docs, ["text", "source"]), ["text", "source"])


@query("Q4_feature_profile", """
, tall AS (SELECT 'order_price' AS feature, order_price AS value FROM tkm UNION ALL SELECT 'bid1', bid1 FROM tkm UNION ALL SELECT 'spread', spread FROM tkm UNION ALL SELECT 'survival_ms', survival_ms FROM tkm),
qs AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM tall GROUP BY feature)
SELECT feature, count(*) AS rows, round(count(*) FILTER (value IS NULL) * 100 / count(*), 6) AS missing_pct,
  round(count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) * 100 / count(*), 6) AS outlier_pct, round(any_value(med), 6) AS median,
  CASE feature WHEN 'survival_ms' THEN 'future_info' ELSE 'observable' END AS category, CASE feature WHEN 'survival_ms' THEN 'HIGH_LEAKAGE' ELSE 'SAFE' END AS risk_level
FROM tall JOIN qs USING (feature) GROUP BY feature
""")
def q4(spark, sf):
    return rounded(q.feature_profile(b.tkm(spark, sf), ["order_price", "bid1", "spread", "survival_ms"]))


def correlation_sql() -> str:
    pairs = [(x, y) for i, x in enumerate(FEATURES) for y in FEATURES[i + 1:]]
    each = " UNION ALL ".join(
        f"SELECT '{x}' AS feature, '{y}' AS other, round(corr(coalesce({x}, 0), coalesce({y}, 0)), 5) + 0.0 AS correlation FROM tkm" for x, y in pairs
    )
    return f", c AS ({each}) SELECT * FROM c"


@query("Q4_correlations", correlation_sql())
def q4_correlations(spark, sf):
    return rounded(q.correlations(b.tkm(spark, sf), FEATURES), 5)


@query("Q4_strong_correlations", correlation_sql() + " WHERE abs(correlation) > 0.8")
def q4_strong(spark, sf):
    return rounded(q.strong_correlations(b.tkm(spark, sf), FEATURES), 5)


@query("Q4_daily_stability", """
, tall AS (SELECT trade_date, 'order_price' AS feature, order_price AS value FROM tkm UNION ALL SELECT trade_date, 'spread', spread FROM tkm)
SELECT trade_date, feature, count(*) AS rows, round(avg(value), 5) + 0.0 AS mean, round(stddev_samp(value), 5) + 0.0 AS std,
  round(count(*) FILTER (value IS NULL) * 100 / count(*), 5) + 0.0 AS missing_pct FROM tall GROUP BY ALL
""")
def q4_stability(spark, sf):
    return rounded(q.daily_stability(b.tkm(spark, sf), ["order_price", "spread"]), 5)


@query("U2_union_of_days_and_tables", """
SELECT trade_date, count(*) AS rows, count(predicted_proba) AS scored FROM (
  SELECT trade_date, predicted_proba FROM pep UNION ALL SELECT trade_date, NULL FROM tk) GROUP BY trade_date
""")
def u2(spark, sf):
    other = scratch_path(spark, "table")
    tables.write_daily(b.tk(spark, sf).select("trade_date", "ticker", "order_id", "order_ts"), other)
    both = tables.read_table(spark, [stored_stream(spark, sf), other])
    return both.groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"), F.count("predicted_proba").alias("scored"))


@query("W_streaming_day_refresh", """
SELECT trade_date, count(*) AS samples, CAST(sum((survival_ms < 50 AND event_type = 'cancel')::INT) AS BIGINT) AS fast_cancels FROM tk GROUP BY trade_date
""")
def streaming(spark, sf):
    from tapewatch.streaming.incremental import follow_labels

    source, out, state = (scratch_path(spark, name) for name in ("stream", "labels", "state"))
    full = b.tk(spark, sf)
    for half in ("trade_date < '20240116'", "trade_date >= '20240116'"):
        tables.write_daily(full.where(half), source)
        follow_labels(spark, source, out, state, extended=False).awaitTermination()
    done = tables.read_table(spark, out)
    return done.groupBy("trade_date").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.col("flag_R1").cast("int")).alias("fast_cancels"))


TICKER_METRICS = "ticker string, rows long, positives long, mean_proba double, max_proba double, predicted_positives long"
TICKER_METRICS_SQL = """
SELECT ticker, count(*) AS rows, CAST(sum(y_label) AS BIGINT) AS positives, round(avg(predicted_proba), 4) AS mean_proba,
  round(max(predicted_proba), 4) AS max_proba, CAST(sum(predicted_binary) AS BIGINT) AS predicted_positives FROM pep GROUP BY ticker
"""


@query("SK3_ticker_metrics_csv", TICKER_METRICS_SQL)
def sk3_csv(spark, sf):
    path = scratch_path(spark, "metrics-csv")
    tables.write_csv(reports.prediction_summary_by_ticker(b.pe(spark, sf)), path)
    return rounded(spark.read.schema(TICKER_METRICS).option("header", True).csv(path), 4)


@query("SK4_ticker_metrics_json", TICKER_METRICS_SQL)
def sk4_json(spark, sf):
    path = scratch_path(spark, "metrics-json")
    tables.write_json(reports.prediction_summary_by_ticker(b.pe(spark, sf)), path)
    return rounded(spark.read.schema(TICKER_METRICS).json(path), 4)
