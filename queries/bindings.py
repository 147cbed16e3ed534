"""The given tables as order flow.

``tk``  every row of ``events`` as an order with a book: ticker and day from user and time, side by
        parity, a cancel for an error event, and a book around the price that is missing now and then.
``qt``  view events as quotes. ``pe`` scored orders. ``pr`` scored documents.
``oe_orders``/``oe_events``  ``orders`` and ``lineitem`` as orders and their events.
``raw_orders``/``raw_trades``/``raw_quotes``  the same events as the exchange's text columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CTES = """
tk0 AS (
  SELECT *, value - ((event_id % 7) - 3) * CAST(1.5 AS DOUBLE) - (1 + event_id % 3) * CAST(0.25 AS DOUBLE) AS b
  FROM events),
tk AS (
  SELECT strftime(ts, '%Y%m%d') AS trade_date, 'T' || CAST(user_id % 10 AS VARCHAR) AS ticker,
    CAST(event_id AS VARCHAR) AS order_id, ts AS order_ts,
    ts + to_milliseconds(event_id % 200) AS event_ts,
    CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'S' END AS side,
    CASE WHEN event_type = 'error' THEN 'cancel' ELSE 'trade' END AS event_type,
    value AS order_price, round(value * 100) AS order_qty,
    CAST(event_id % 200 AS DOUBLE) AS survival_ms,
    CASE WHEN event_id % 50 <> 0 THEN b END AS bid1,
    CASE WHEN event_id % 50 <> 0 THEN b + (1 + event_id % 3) * CAST(0.5 AS DOUBLE) END AS ask1,
    CASE WHEN event_id % 50 <> 0 THEN CAST(user_id * 10 AS DOUBLE) END AS bid_vol1,
    CASE WHEN event_id % 50 <> 0 THEN CAST((event_id % 97) * 10 AS DOUBLE) END AS ask_vol1,
    CASE WHEN event_id % 50 <> 0 THEN CAST(50 AS DOUBLE) END AS prev_close
  FROM tk0),
tkm AS (
  SELECT *, (bid1 + ask1) / 2 AS mid_price, ask1 - bid1 AS spread, order_price - (bid1 + ask1) / 2 AS delta_mid,
    ln(1 + order_qty) AS log_qty, CAST(date_diff('microsecond', CAST('1970-01-01' AS TIMESTAMP), order_ts) AS BIGINT) AS us,
    CASE WHEN side = 'B' THEN 1 ELSE 0 END AS is_buy,
    CAST(date_diff('microsecond', date_trunc('day', order_ts), order_ts) AS BIGINT) AS tod
  FROM tk),
qt AS (
  SELECT strftime(ts, '%Y%m%d') AS trade_date, 'T' || CAST(user_id % 10 AS VARCHAR) AS ticker, ts AS quote_ts,
    value - 0.5 AS bid1, CASE WHEN event_id % 11 <> 0 THEN value + 0.5 END AS ask1,
    CAST(user_id AS DOUBLE) AS bid_vol1, CAST(event_id % 97 AS DOUBLE) AS ask_vol1, CAST(50 AS DOUBLE) AS prev_close
  FROM events WHERE event_type = 'view'),
pe AS (
  SELECT trade_date, ticker, order_id, order_ts,
    CASE WHEN event_type = 'cancel' AND CAST(order_id AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS y_label,
    CAST((CAST(order_id AS BIGINT) * 37 + CAST(bid_vol1 AS BIGINT)) % 1009 AS DOUBLE) / 1009 AS p0
  FROM tk),
pe1 AS (SELECT *, coalesce(p0, CAST(0.25 AS DOUBLE)) AS predicted_proba FROM pe),
pep AS (SELECT trade_date, ticker, order_id, order_ts, y_label, predicted_proba,
    CASE WHEN predicted_proba > 0.5 THEN 1 ELSE 0 END AS predicted_binary FROM pe1),
pr AS (
  SELECT doc_id, toxic AS y_label, CAST(n_chars AS DOUBLE) / 200000 AS predicted_proba, lang AS ticker
  FROM labels JOIN documents USING (doc_id)),
oe_orders AS (
  SELECT strftime(o_orderdate, '%Y%m%d') AS trade_date, 'T' || CAST(o_custkey % 10 AS VARCHAR) AS ticker,
    CAST(o_orderkey AS VARCHAR) AS order_id, o_orderdate AS order_ts,
    CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'S' END AS side
  FROM orders),
oe_events AS (
  SELECT strftime(o_orderdate, '%Y%m%d') AS trade_date, 'T' || CAST(o_custkey % 10 AS VARCHAR) AS ticker,
    CAST(l_orderkey AS VARCHAR) AS order_id, l_shipdate AS event_ts,
    CASE WHEN l_linenumber % 2 = 0 THEN 'B' ELSE 'S' END AS event_side,
    CASE WHEN l_returnflag = 'R' THEN 'cancel' ELSE 'trade' END AS event_type,
    l_returnflag AS trade_code, l_extendedprice / l_quantity AS trade_price, l_quantity AS trade_qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
oe AS (
  SELECT o.*, e.* EXCLUDE (trade_date, ticker, order_id),
    greatest(0, CAST(date_diff('microsecond', order_ts, event_ts) AS DOUBLE) / 1000) AS survival_ms,
    trade_qty AS order_qty, trade_price AS order_price
  FROM oe_orders o JOIN oe_events e USING (trade_date, ticker, order_id)
  QUALIFY row_number() OVER (PARTITION BY o.trade_date, o.ticker, o.order_id
    ORDER BY event_ts, event_side, CASE WHEN event_type = 'cancel' THEN 0 ELSE 1 END, event_type, trade_code, trade_price, trade_qty) = 1),
raw_orders AS (
  SELECT strftime(ts, '%Y%m%d') AS trade_date, 'T' || CAST(user_id % 10 AS VARCHAR) AS ticker,
    strftime(ts, '%Y%m%d') AS date, CAST(CAST(strftime(ts, '%H%M%S') AS BIGINT) * 1000 + CAST(floor(extract('microsecond' FROM ts) % 1000000 / 1000) AS BIGINT) AS VARCHAR) AS time,
    lpad(CAST(event_id AS VARCHAR), 10, '0') AS order_id,
    CASE WHEN event_id % 4 = 0 THEN 'B' WHEN event_id % 4 = 1 THEN 'S' WHEN event_id % 4 = 2 THEN '买' ELSE '卖' END AS side,
    CAST(event_id % 900 + 100 AS VARCHAR) AS order_price,
    CASE WHEN event_id % 41 = 0 THEN 'n/a' ELSE CAST(event_id % 13 * 100 AS VARCHAR) END AS order_qty, '0' AS order_type, event_id
  FROM events),
raw_trades0 AS (
  SELECT *, ts + to_milliseconds(event_id % 200) AS evt, lpad(CAST(event_id AS VARCHAR), 10, '0') AS mine,
    lpad(CAST(event_id + CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END AS VARCHAR), 10, '0') AS other
  FROM events),
raw_trades AS (
  SELECT strftime(ts, '%Y%m%d') AS trade_date, 'T' || CAST(user_id % 10 AS VARCHAR) AS ticker,
    strftime(evt, '%Y%m%d') AS date,
    CASE WHEN event_id % 83 = 0 THEN 'late' ELSE CAST(CAST(strftime(evt, '%H%M%S') AS BIGINT) * 1000 + CAST(floor(extract('microsecond' FROM evt) % 1000000 / 1000) AS BIGINT) AS VARCHAR) END AS time,
    CASE WHEN event_type = 'error' THEN 'C' ELSE 'F' END AS trade_code,
    CAST(event_id % 900 + 100 AS VARCHAR) AS trade_price, CAST(event_id % 13 * 100 AS VARCHAR) AS trade_qty,
    CASE WHEN event_id % 2 = 0 THEN mine WHEN event_type = 'error' THEN '0' ELSE other END AS buy_no,
    CASE WHEN event_id % 2 = 1 THEN mine WHEN event_type = 'error' THEN '0' ELSE other END AS sell_no
  FROM raw_trades0),
st_orders AS (
  SELECT trade_date, ticker, ltrim(order_id, '0') AS order_id,
    CASE WHEN side IN ('B', '买') THEN 'B' ELSE 'S' END AS side,
    TRY_CAST(order_price AS DOUBLE) AS order_price, TRY_CAST(order_qty AS DOUBLE) AS order_qty, order_type,
    try_strptime(date || lpad(time, 9, '0') || '000', '%Y%m%d%H%M%S%f') AS order_ts
  FROM raw_orders),
st_events AS (
  SELECT trade_date, ticker, ltrim(no, '0') AS order_id, event_side,
    CASE WHEN trade_code = 'C' THEN 'cancel' ELSE 'trade' END AS event_type, trade_code,
    TRY_CAST(trade_price AS DOUBLE) AS trade_price, TRY_CAST(trade_qty AS DOUBLE) AS trade_qty,
    try_strptime(date || lpad(time, 9, '0') || '000', '%Y%m%d%H%M%S%f') AS event_ts
  FROM (SELECT *, 'B' AS event_side, buy_no AS no FROM raw_trades UNION ALL SELECT *, 'S', sell_no FROM raw_trades)
  WHERE no <> '0'),
st AS (
  SELECT o.*, e.* EXCLUDE (trade_date, ticker, order_id)
  FROM st_orders o JOIN st_events e USING (trade_date, ticker, order_id)
  WHERE order_ts IS NOT NULL AND event_ts IS NOT NULL)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(ts: str) -> dict:
    return {
        "trade_date": F.date_format(F.col(ts), "yyyyMMdd"),
        "ticker": F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string")),
    }


def tk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    bid = F.col("value") - ((n % 7) - 3) * F.lit(1.5) - (1 + n % 3) * F.lit(0.25)
    known = n % 50 != 0
    return e.select(
        *[c.alias(k) for k, c in _placed("ts").items()],
        n.cast("string").alias("order_id"),
        F.col("ts").alias("order_ts"),
        F.timestamp_add("MILLISECOND", n % 200, F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("event_ts"),
        F.when(n % 2 == 0, "B").otherwise("S").alias("side"),
        F.when(F.col("event_type") == "error", "cancel").otherwise("trade").alias("event_type"),
        F.col("value").alias("order_price"),
        F.round(F.col("value") * 100).alias("order_qty"),
        (n % 200).cast("double").alias("survival_ms"),
        F.when(known, bid).alias("bid1"),
        F.when(known, bid + (1 + n % 3) * F.lit(0.5)).alias("ask1"),
        F.when(known, (F.col("user_id") * 10).cast("double")).alias("bid_vol1"),
        F.when(known, (n % 97 * 10).cast("double")).alias("ask_vol1"),
        F.when(known, F.lit(50.0)).alias("prev_close"),
    )


def tkm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tk`` with the middle of the book and log size."""
    mid = (F.col("bid1") + F.col("ask1")) / 2
    return tk(spark, sf_dir).withColumns(
        {
            "mid_price": mid,
            "spread": F.col("ask1") - F.col("bid1"),
            "delta_mid": F.col("order_price") - mid,
            "log_qty": F.log1p("order_qty"),
            "is_buy": F.when(F.col("side") == "B", 1).otherwise(0),
        }
    )


def qt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return e.select(
        *[c.alias(k) for k, c in _placed("ts").items()],
        F.col("ts").alias("quote_ts"),
        (F.col("value") - 0.5).alias("bid1"),
        F.when(F.col("event_id") % 11 != 0, F.col("value") + 0.5).alias("ask1"),
        F.col("user_id").cast("double").alias("bid_vol1"),
        (F.col("event_id") % 97).cast("double").alias("ask_vol1"),
        F.lit(50.0).alias("prev_close"),
    )


def pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("order_id").cast("bigint")
    p = ((n * 37 + F.col("bid_vol1").cast("bigint")) % 1009).cast("double") / F.lit(1009.0)
    scored = tk(spark, sf_dir).select(
        "trade_date",
        "ticker",
        "order_id",
        "order_ts",
        F.when((F.col("event_type") == "cancel") & (n % 3 == 0), 1).otherwise(0).alias("y_label"),
        F.coalesce(p, F.lit(0.25)).alias("predicted_proba"),
    )
    return scored.withColumn("predicted_binary", F.when(F.col("predicted_proba") > 0.5, 1).otherwise(0))


def pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id",
        F.col("toxic").alias("y_label"),
        (F.col("n_chars").cast("double") / F.lit(200000.0)).alias("predicted_proba"),
        F.col("lang").alias("ticker"),
    )


def _order_place() -> list:
    return [
        F.date_format("o_orderdate", "yyyyMMdd").alias("trade_date"),
        F.concat(F.lit("T"), (F.col("o_custkey") % 10).cast("string")).alias("ticker"),
        F.col("o_orderkey").cast("string").alias("order_id"),
    ]


def oe_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        *_order_place(),
        F.col("o_orderdate").alias("order_ts"),
        F.when(F.col("o_orderkey") % 2 == 0, "B").otherwise("S").alias("side"),
    )


def oe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *_order_place(),
        F.col("l_shipdate").alias("event_ts"),
        F.when(F.col("l_linenumber") % 2 == 0, "B").otherwise("S").alias("event_side"),
        F.when(F.col("l_returnflag") == "R", "cancel").otherwise("trade").alias("event_type"),
        F.col("l_returnflag").alias("trade_code"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("trade_price"),
        F.col("l_quantity").alias("trade_qty"),
    )


def _tick_text(ts) -> dict:
    """Exchange text of a time; the leading zero of the hour is lost, as in the files."""
    return {
        "date": F.date_format(ts, "yyyyMMdd"),
        "time": F.date_format(ts, "HHmmssSSS").cast("bigint").cast("string"),
    }


def _padded(n):
    return F.lpad(n.cast("string"), 10, "0")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    e = table(spark, sf_dir, "events")
    side = F.when(n % 4 == 0, "B").when(n % 4 == 1, "S").when(n % 4 == 2, "买").otherwise("卖")
    return e.select(
        *[c.alias(k) for k, c in _placed("ts").items()],
        *[c.alias(k) for k, c in _tick_text(F.col("ts")).items()],
        _padded(n).alias("order_id"),
        side.alias("side"),
        (n % 900 + 100).cast("string").alias("order_price"),
        F.when(n % 41 == 0, "n/a").otherwise((n % 13 * 100).cast("string")).alias("order_qty"),
        F.lit("0").alias("order_type"),
    )


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    e = table(spark, sf_dir, "events")
    at = F.timestamp_add("MILLISECOND", n % 200, F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    text = _tick_text(at)
    mine, other = _padded(n), _padded(n + F.when(n % 3 == 0, 1).otherwise(-1))
    counter = F.when(F.col("event_type") == "error", F.lit("0")).otherwise(other)
    return e.select(
        *[c.alias(k) for k, c in _placed("ts").items()],
        text["date"].alias("date"),
        F.when(n % 83 == 0, "late").otherwise(text["time"]).alias("time"),
        F.when(F.col("event_type") == "error", "C").otherwise("F").alias("trade_code"),
        (n % 900 + 100).cast("string").alias("trade_price"),
        (n % 13 * 100).cast("string").alias("trade_qty"),
        F.when(n % 2 == 0, mine).otherwise(counter).alias("buy_no"),
        F.when(n % 2 == 1, mine).otherwise(counter).alias("sell_no"),
    )
