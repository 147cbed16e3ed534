"""Choosing rows: tickers, dates, targets, samples; and leakage-safe projections."""

from pyspark.sql import functions as F

from queries import bindings as b
from queries.registry import query, r, rounded
from tapewatch.operators import features as fx
from tapewatch.operators import leakage as lk
from tapewatch.operators import quality as q
from tapewatch.operators import selection as sel
from tapewatch.plans import reports, stages
from tapewatch.session import scratch_path
from tapewatch.sources import tables

TRAIN, VALID = "2024010|2024011", "2024012|2024013"
SPLIT_SQL = """
, sp AS (SELECT *, CASE WHEN regexp_matches(trade_date, '2024010|2024011') THEN 'train' WHEN regexp_matches(trade_date, '2024012|2024013') THEN 'valid' END AS split FROM pep)
"""


@query("P31_A5_split_class_distribution", SPLIT_SQL + """
SELECT split, y_label, count(*) AS rows FROM sp WHERE split IS NOT NULL GROUP BY ALL
""")
def p31(spark, sf):
    return reports.class_distribution(sel.with_split(b.pe(spark, sf), TRAIN, VALID))


@query("P32_target_selection", """
SELECT order_id, predicted_binary AS enhanced_combined, predicted_binary AS y_label FROM pep
""")
def p32(spark, sf):
    df = b.pe(spark, sf).withColumn("enhanced_combined", F.col("predicted_binary"))
    return sel.with_target(df, "enhanced_combined").select("order_id", "enhanced_combined", "y_label")


@query("J4_features_with_labels", """
SELECT trade_date, ticker, order_id, order_price, y_label FROM tk JOIN pep USING (trade_date, ticker, order_id)
""")
def j4(spark, sf):
    features = b.tk(spark, sf).select("trade_date", "ticker", "order_id", "order_ts", "order_price")
    out = sel.features_with_labels(features, b.pe(spark, sf))
    return out.select("trade_date", "ticker", "order_id", "order_price", "y_label")


@query("J4_J1_bucketed_daily_tables", """
, ev AS (SELECT trade_date, ticker, us + CAST(survival_ms AS BIGINT) * 1000 AS eus FROM tkm WHERE event_type = 'cancel'),
c AS (SELECT o.order_id, CAST(count(eus) AS BIGINT) AS cancels_5s FROM tkm o
  LEFT JOIN ev e ON o.trade_date = e.trade_date AND o.ticker = e.ticker AND eus < us AND eus >= us - 5000000 GROUP BY o.order_id)
SELECT tk.trade_date, tk.ticker, order_id, order_price, y_label, cancels_5s FROM tk JOIN pep USING (trade_date, ticker, order_id) JOIN c USING (order_id)
""")
def j4_bucketed(spark, sf):
    """Tables dealt by ticker when they are written; the joins and the windows between them shuffle nothing."""
    root = scratch_path(spark, "bucketed")
    flow = b.tk(spark, sf)
    parts = {"features": flow.select("trade_date", "ticker", "order_id", "order_ts", "order_price"), "labels": b.pe(spark, sf), "stream": flow}
    for name, rows in parts.items():
        tables.write_bucketed(rows, f"{root}/{name}", 8)
    features, labels, stream = (tables.read_bucketed(spark, f"{root}/{name}") for name in parts)
    out = stages.with_recent_cancels(sel.features_with_labels(features, labels), stream)
    return out.select("trade_date", "ticker", "order_id", "order_price", "y_label", "cancels_5s")


def named_tickers(spark, sf):
    """Tickers numbered like the nations of two regions; some do not exist."""
    nations = b.table(spark, sf, "nation").where("n_regionkey IN (1, 3)")
    return nations.select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("ticker"))


NAMED = """
, wanted AS (SELECT 'T' || CAST(n_nationkey AS VARCHAR) AS ticker FROM nation WHERE n_regionkey IN (1, 3))
"""


@query("J6_ticker_semi_join", NAMED + """
SELECT ticker, count(*) AS rows FROM pep WHERE ticker IN (SELECT ticker FROM wanted) GROUP BY ticker
""")
def j6(spark, sf):
    kept = sel.with_tickers(b.pe(spark, sf), named_tickers(spark, sf))
    return kept.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))


@query("J6_ticker_anti_join", NAMED + """
SELECT ticker, count(*) AS rows FROM pep WHERE ticker NOT IN (SELECT ticker FROM wanted) GROUP BY ticker
""")
def j6_anti(spark, sf):
    kept = sel.without_tickers(b.pe(spark, sf), named_tickers(spark, sf))
    return kept.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))


@query("J8_requested_but_missing", NAMED + "SELECT ticker FROM wanted WHERE ticker NOT IN (SELECT ticker FROM pep)")
def j8(spark, sf):
    return sel.not_found(named_tickers(spark, sf), b.pe(spark, sf))


@query("T3_top_tickers_by_volume", """
SELECT ticker, round(sum(log_qty), 4) AS measure FROM tkm GROUP BY ticker ORDER BY sum(log_qty) DESC, ticker LIMIT 5
""")
def t3(spark, sf):
    return rounded(sel.top_tickers(b.tkm(spark, sf), 5), 4)


@query("T3_top_tickers_by_rows", "SELECT ticker, count(*) AS measure FROM pep GROUP BY ticker ORDER BY 2 DESC, ticker LIMIT 5")
def t3_rows(spark, sf):
    return sel.top_tickers(b.pe(spark, sf), 5, "rows")


@query("T3_top_tickers_by_positives", """
SELECT ticker, count(*) AS measure FROM pep WHERE y_label = 1 GROUP BY ticker ORDER BY 2 DESC, ticker LIMIT 5
""")
def t3_positives(spark, sf):
    return sel.top_tickers(b.pe(spark, sf), 5, "positives")


@query("T4_random_tickers", "SELECT least(4, count(DISTINCT ticker)) AS tickers FROM pep")
def t4(spark, sf):
    return sel.random_tickers(b.pe(spark, sf), 4).agg(F.count(F.lit(1)).alias("tickers"))


@query("A18_class_weight", """
SELECT CAST(sum(y_label) AS BIGINT) AS positives, count(*) AS samples, CAST(count(*) - sum(y_label) AS BIGINT) AS negatives,
  round((count(*) - sum(y_label)) / sum(y_label), 6) AS positive_weight FROM pep
""")
def a18(spark, sf):
    return rounded(sel.class_weights(b.pe(spark, sf)))


@query("SA1_under_sample", """
SELECT y_label, CASE WHEN y_label = 1 THEN count(*) ELSE least(count(*), 5 * (SELECT sum(y_label) FROM pep)) END::BIGINT AS rows FROM pep GROUP BY y_label
""")
def sa1(spark, sf):
    return sel.under_sample(b.pe(spark, sf), 5).groupBy("y_label").agg(F.count(F.lit(1)).alias("rows"))


@query("SA2_stratified_under_sample", """
, c AS (SELECT trade_date, ticker, sum(y_label) AS p, count(*) - sum(y_label) AS n FROM pep GROUP BY ALL)
SELECT trade_date, ticker, 1 AS y_label, CAST(p AS BIGINT) AS rows FROM c WHERE p > 0 AND n > 0
UNION ALL SELECT trade_date, ticker, 0, CAST(least(n, 10 * p) AS BIGINT) FROM c WHERE p > 0 AND n > 0
""")
def sa2(spark, sf):
    strata = ["trade_date", "ticker"]
    kept = sel.under_sample(b.pe(spark, sf), by=strata)
    return kept.groupBy(*strata, "y_label").agg(F.count(F.lit(1)).alias("rows"))


@query("SA3_no_sampling", "SELECT y_label, count(*) AS rows FROM pep GROUP BY y_label")
def sa3(spark, sf):
    return b.pe(spark, sf).groupBy("y_label").agg(F.count(F.lit(1)).alias("rows"))


# ------------------------------------------------------------------ projections

def labelled_features(spark, sf):
    """A feature table that still has everything a careless join would bring along."""
    base = fx.with_base_features(fx.with_book(b.tk(spark, sf)))
    return base.withColumns(
        {
            "y_label": F.when((F.col("event_type") == "cancel") & (F.col("survival_ms") < 50), 1).otherwise(0),
            "flag_R1": F.col("survival_ms") < 50,
            "total_events": F.lit(1),
            "fee_class": F.length("order_id"),
        }
    )


@query("L2_feature_table", """
SELECT trade_date, ticker, order_id, order_ts, order_price, order_qty, side, round(bid1, 6) + 0.0 AS bid1, round(ask1, 6) + 0.0 AS ask1,
  coalesce(bid_vol1, 0) AS bid_vol1, coalesce(ask_vol1, 0) AS ask_vol1, prev_close FROM tk
""")
def l2(spark, sf):
    out = lk.feature_table(b.tk(spark, sf).transform(fx.with_book))
    return rounded(out)


@query("L3_training_projection", """
SELECT round(mid_price, 6) + 0.0 AS mid_price, round(spread, 6) + 0.0 AS spread, round(delta_mid, 6) + 0.0 AS delta_mid, is_buy, count(*) AS rows
FROM tkm GROUP BY ALL
""")
def l3(spark, sf):
    df = fx.with_mid(b.tkm(spark, sf).drop("log_qty")).withColumn("trade_price", F.col("order_price"))
    kept = rounded(df.select(*lk.training_columns(df)))
    return kept.groupBy("mid_price", "spread", "delta_mid", "is_buy").agg(F.count(F.lit(1)).alias("rows"))


TICK_COLUMNS = "trade_date ticker order_id order_ts event_ts side event_type order_price order_qty survival_ms bid1 ask1 bid_vol1 ask_vol1 prev_close".split()


@query("L4_leakage_classes", f"""
, n AS (UNPIVOT (SELECT {", ".join(f"count({c}) AS {c}" for c in TICK_COLUMNS)} FROM tk) ON COLUMNS(*) INTO NAME feature VALUE known)
SELECT feature, CASE WHEN feature IN ('event_ts', 'survival_ms') THEN 'future_info' WHEN feature = 'event_type' THEN 'order_outcome'
    WHEN feature IN ('trade_date', 'ticker', 'order_id') THEN 'other' ELSE 'observable' END AS category,
  CASE WHEN feature IN ('event_ts', 'survival_ms', 'event_type') THEN 'HIGH_LEAKAGE' WHEN feature IN ('trade_date', 'ticker', 'order_id') THEN 'UNKNOWN'
    ELSE 'SAFE' END AS risk_level, known FROM n
""")
def l4(spark, sf):
    """Classes of the columns of the tick table, with the rows that know each of them."""
    ticks = b.tk(spark, sf).select(*TICK_COLUMNS)
    counts = ticks.agg(*[F.count(c).alias(c) for c in TICK_COLUMNS])
    known = counts.unpivot([], TICK_COLUMNS, "feature", "known")
    return lk.risk_table(spark, TICK_COLUMNS).join(known, "feature")


@query("L5_clean_for_training", """
SELECT order_id, order_price, order_qty, is_buy, round(spread, 6) + 0.0 AS spread, CASE WHEN event_type = 'cancel' AND survival_ms < 50 THEN 1 ELSE 0 END AS y_label,
  CAST(length(order_id) AS INT) AS fee_class, 0 AS leaks FROM tkm
""")
def l5(spark, sf):
    out = lk.clean_for_training(labelled_features(spark, sf), also_keep=["order_id"])
    leaks = [c for c in out.columns if c in {*lk.FUTURE_INFO, "flag_R1", "total_events", "event_type", "ticker"}]
    return out.select(
        "order_id", "order_price", "order_qty", "is_buy", r("spread").alias("spread"), "y_label", "fee_class",
        F.lit(len(leaks)).alias("leaks"),
    )


@query("L6_white_listed", """
SELECT trade_date, ticker, order_id, round(spread, 6) + 0.0 AS spread, is_buy, 0 AS dropped_kept,
  CASE WHEN event_type = 'cancel' AND survival_ms < 50 THEN 1 ELSE 0 END AS y_label FROM tkm
""")
def l6(spark, sf):
    out = lk.white_listed(labelled_features(spark, sf))
    wrong = [c for c in out.columns if c in ("prev_close", "total_events", "flag_R1", "order_price")]
    return out.select(
        "trade_date", "ticker", "order_id", r("spread").alias("spread"), "is_buy", F.lit(len(wrong)).alias("dropped_kept"), "y_label"
    )


@query("L7_model_feature_set", """
SELECT ticker, trade_date, order_id, is_buy, round(mid_price, 6) + 0.0 AS mid_price, round(spread, 6) + 0.0 AS spread, round(delta_mid, 6) + 0.0 AS delta_mid FROM tkm
""")
def l7(spark, sf):
    from tapewatch.schemas import MODEL_FEATURES

    df = b.tkm(spark, sf).drop("log_qty")
    return rounded(df.select(*[c for c in MODEL_FEATURES if c in df.columns]))


@query("L8_basic_leakage_drop", """
SELECT trade_date, ticker, order_id, order_ts, side, order_price, order_qty, prev_close FROM tk
""")
def l8(spark, sf):
    out = lk.without_basic_leakage(b.tk(spark, sf))
    return out.drop("bid1", "ask1", "bid_vol1", "ask_vol1")


@query("S_leakage_free_history", """
SELECT order_id, CASE WHEN event_type = 'cancel' THEN 1 ELSE 0 END AS past_cancel_flag, CASE WHEN event_type = 'trade' THEN 1 ELSE 0 END AS past_trade_flag,
  round(coalesce(abs(delta_mid) / nullif(mid_price, 0) * 100, -1), 5) + 0.0 AS price_distance_pct FROM tkm
""")
def safe(spark, sf):
    out = stages.safe_features(b.tk(spark, sf))
    return out.select(
        "order_id", "past_cancel_flag", "past_trade_flag",
        r(F.coalesce("price_distance_pct", F.lit(-1.0)), 5).alias("price_distance_pct"),
    )


@query("L7_readable_features", """
SELECT ticker, trade_date, order_id, event_type, side, order_price, order_qty, round(bid1, 6) + 0.0 AS bid1, round(ask1, 6) + 0.0 AS ask1, bid_vol1, ask_vol1, prev_close,
  is_buy, round(mid_price, 6) + 0.0 AS mid_price, round(spread, 6) + 0.0 AS spread, survival_ms, round(order_price * order_qty, 4) + 0.0 AS order_amount FROM tkm
""")
def l7_readable(spark, sf):
    whole = b.tkm(spark, sf).withColumn("order_amount", F.col("order_price") * F.col("order_qty"))
    out = lk.readable_table(whole.withColumn("survival_rank", F.lit(1)))
    digits = {"bid1": 6, "ask1": 6, "mid_price": 6, "spread": 6, "order_amount": 4}
    return out.select(*[r(c, digits[c]).alias(c) if c in digits else c for c in out.columns])


@query("L7_feature_themes", """
, t AS (SELECT * FROM (VALUES ('price', 'order_price'), ('price', 'bid1'), ('price', 'ask1'), ('price', 'prev_close'), ('price', 'mid_price'), ('quantity', 'order_qty'),
  ('quantity', 'bid_vol1'), ('quantity', 'ask_vol1'), ('quantity', 'log_qty'), ('time', 'survival_ms'), ('technical', 'spread'), ('technical', 'delta_mid')) AS v(theme, feature)),
n AS (UNPIVOT (SELECT count(*) - count(order_price) AS order_price, count(*) - count(bid1) AS bid1, count(*) - count(ask1) AS ask1, count(*) - count(prev_close) AS prev_close,
  count(*) - count(mid_price) AS mid_price, count(*) - count(order_qty) AS order_qty, count(*) - count(bid_vol1) AS bid_vol1, count(*) - count(ask_vol1) AS ask_vol1,
  count(*) - count(log_qty) AS log_qty, count(*) - count(survival_ms) AS survival_ms, count(*) - count(spread) AS spread, count(*) - count(delta_mid) AS delta_mid FROM tkm)
  ON COLUMNS(*) INTO NAME feature VALUE missing)
SELECT theme, count(*) AS features, round(sum(missing) * 100 / (count(*) * (SELECT count(*) FROM tkm)), 6) AS missing_pct FROM t JOIN n USING (feature) GROUP BY theme
""")
def l7_themes(spark, sf):
    return rounded(q.theme_profile(b.tkm(spark, sf)))
