"""Hand-computed rows at both sides of every boundary."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tapewatch.functions import times
from tapewatch.operators import asof, events as ev, features as fx, history, labels as lb, metrics as m, rolling
from tapewatch.operators import leakage as lk
from tapewatch.operators import selection as sel
from tapewatch.operators.ordered import exact_quantiles

DAY = "2025-03-03 "


def ts(text):
    return datetime.fromisoformat(DAY + text)


def values(df, *columns):
    return [tuple(row) if len(columns) > 1 else row[0] for row in df.select(*columns).collect()]


def test_tick_time(spark):
    rows = [(1, "20250303", "93000010"), (2, "20250303", "093000010"), (3, "20250303", "xx"), (4, "2025030", "93000010"),
            (5, "20250303", "93000010123"), (6, "20250303", "246000000"), (7, None, "93000010"), (8, "20250303", "")]
    df = spark.createDataFrame(rows, "n int, d string, t string").orderBy("n")
    got = values(df.select(times.tick_time(F.col("d"), F.col("t")).alias("x")), "x")
    assert got[:3] == [ts("09:30:00.010000"), ts("09:30:00.010000"), None]
    assert got[5:7] == [None, None] and got[7] == datetime(2025, 3, 3)


def test_side_split(spark):
    rows = [("007", "0", "F"), ("1", "2", "C"), (None, "0", "F")]
    df = spark.createDataFrame(rows, "buy_no string, sell_no string, trade_code string").withColumns(
        {"trade_date": F.lit("20250303"), "ticker": F.lit("A"), "trade_price": F.lit("1"), "trade_qty": F.lit("x"),
         "date": F.lit("20250303"), "time": F.lit("93000000")}
    )
    got = sorted(values(ev.side_events(df), "event_side", "order_id", "event_type", "trade_qty"))
    assert got == [("B", "1", "cancel", None), ("B", "7", "trade", None), ("S", "2", "cancel", None)]


def test_survival_is_never_negative(spark):
    df = spark.createDataFrame([(ts("10:00:00"), ts("10:00:00.040")), (ts("10:00:00.040"), ts("10:00:00"))], "o timestamp_ntz, e timestamp_ntz")
    assert values(df.select(ev.survival_ms(F.col("o"), F.col("e")).alias("x")), "x") == [40.0, 0.0]


def test_session_boundaries(spark):
    at = ["09:14:59.999", "09:15:00", "09:30:00", "11:30:00", "11:30:00.001", "13:00:00", "14:57:00", "15:00:00", "15:00:00.001"]
    df = spark.createDataFrame([(ts(t),) for t in at], "order_ts timestamp_ntz")
    out = ev.with_session_features(df)
    assert values(out.orderBy("order_ts"), "in_auction") == [0, 1, 0, 0, 0, 0, 1, 1, 0]
    assert values(ev.in_hours(df).orderBy("order_ts"), "order_ts") == [ts(at[i]) for i in (2, 3, 5, 6)]
    first = out.where(F.col("order_ts") == F.lit(ts("09:30:00"))).first()
    assert (first.seconds_since_market_open, first.time_sin, first.time_cos) == (0.0, 0.0, 1.0)


def test_asof_grid(spark, group_rows):
    quotes = spark.createDataFrame(
        [("d", "A", ts("09:30:00.050"), 1.0), ("d", "A", ts("09:30:00.260"), None), ("d", "A", ts("09:30:00.420"), 3.0)],
        "trade_date string, ticker string, quote_ts timestamp_ntz, bid1 double",
    )
    at = ["09:29:59.990", "09:30:00.010", "09:30:00.110", "09:30:00.299", "09:30:00.450", "09:30:00.500", "09:30:00.501"]
    orders = spark.createDataFrame([("d", "A", str(i), ts(t)) for i, t in enumerate(at)] + [("d", "B", "9", ts(at[3]))],
                                   "trade_date string, ticker string, order_id string, order_ts timestamp_ntz")
    out = asof.with_quotes(orders, asof.first_quotes(quotes), values=["bid1"]).orderBy("ticker", "order_id")
    assert values(out, "bid1") == [None, None, 1.0, 1.0, None, None, None, None]
    grid = ["09:30:00", "09:30:00.100", "09:30:00.200", "09:30:00.400", "09:30:00.400"]
    assert values(out, "quote_ts") == [None, *[ts(g) for g in grid], None, None]


def orders_at(spark, ms, **more):
    rows = [("d", "A", f"{i:03d}", times_ms) for i, times_ms in enumerate(ms)]
    df = spark.createDataFrame(rows, "trade_date string, ticker string, order_id string, ms long")
    base = times.micros(F.lit(ts("10:00:00")))
    return df.withColumn("order_ts", times.from_micros(base + F.col("ms") * 1000)).withColumns({k: F.lit(v) for k, v in more.items()})


def test_rolling_counts_exclude_the_same_instant(spark):
    for limit in ("2000000", "2"):
        spark.conf.set("tapewatch.groupRows", limit)
        out = rolling.order_counts(orders_at(spark, [0, 50, 50, 100, 150, 300]), {"100ms": 100_000})
        assert values(out.orderBy("order_id"), "orders_100ms") == [0, 1, 1, 3, 3, 0]
    spark.conf.unset("tapewatch.groupRows")


def test_cancels_count_once_they_happened(spark):
    df = orders_at(spark, [0, 10, 40]).withColumns(
        {"event_type": F.when(F.col("ms") < 40, "cancel").otherwise("trade"),
         "event_ts": times.from_micros(times.micros(F.col("order_ts")) + 20_000)}
    )
    by_event = rolling.history_counts(df, {"1s": 1_000_000}).orderBy("order_id")
    assert values(by_event, "orders_1s", "cancels_1s") == [(0, 0), (1, 0), (2, 2)]
    by_order = rolling.history_counts(df, {"1s": 1_000_000}, event_time="order").orderBy("order_id")
    assert values(by_order, "orders_1s", "cancels_1s") == [(0, 0), (1, 1), (2, 2)]


def test_gap_score(spark):
    got = values(history.arrival_gap_score(orders_at(spark, [0, 10, 30])).orderBy("order_id"), "z_survival")
    assert got == pytest.approx([0.0, 10 / (1 + 1e-8), (20 - 5) / (math.sqrt(50) + 1e-8)])


def test_basic_rules(spark):
    rows = [(49.0, "cancel", 4.0, 1.0), (49.0, "trade", 4.0, 1.0), (50.0, "cancel", 4.0, 1.0), (51.0, "cancel", 4.0, 1.0),
            (49.0, "cancel", 3.99, 1.0), (49.0, "cancel", -4.01, 1.0), (49.0, "cancel", 4.0, 0.0), (49.0, "cancel", 4.0, None),
            (999.0, "trade", 4.0, 1.0), (1000.0, "trade", 4.0, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, survival_ms double, event_type string, delta_mid double, spread double")
    out = lb.with_base_labels(df).orderBy("n")
    assert values(out, "flag_R1") == [True, False, False, False, True, True, True, True, False, False]
    assert values(out, "flag_R2") == [True, True, True, True, False, True, False, False, True, False]
    assert values(out, "y_label") == [1, 0, 0, 0, 0, 1, 0, 0, 0, 0]
    assert values(lb.with_base_labels(df.drop("delta_mid")).orderBy("n"), "y_label") == [1, 0, 0, 0, 1, 1, 1, 1, 0, 0]


def test_aggressive_pricing_in_the_opening(spark):
    rows = [(ts("10:00:00"), 0.4), (ts("10:00:00"), 0.6), (ts("10:00:00.001"), 0.4), (ts("10:00:00.001"), 0.6)]
    df = spark.createDataFrame([(i, t, 11 + x, "B", 10.0, 11.0, 1.0) for i, (t, x) in enumerate(rows)],
                               "n int, order_ts timestamp_ntz, order_price double, side string, bid1 double, ask1 double, spread double")
    assert values(df.orderBy("n").select(lb.aggressive().alias("x")), "x") == [0, 1, 1, 1]


def test_composite_labels(spark):
    rows = [(k, y) for k in range(4) for y in (0, 1)]
    df = spark.createDataFrame([(k, y, *[int(i < k) for i in range(4)]) for k, y in rows],
                               "k int, y_label int, extreme_price_deviation int, aggressive_pricing int, abnormal_large_order int, volatile_period_anomaly int")
    out = df.withColumns(lb.composite_labels()).orderBy("k", "y_label")
    conservative = [int(k >= 2) for k, _ in rows]
    either = [int(k >= 2 or y == 1) for k, y in rows]
    assert values(out, "enhanced_spoofing_conservative") == values(out, "enhanced_spoofing_moderate") == conservative
    assert values(out, "enhanced_spoofing_strict") == [int(k >= 3) for k, _ in rows]
    assert values(out, "enhanced_spoofing_liberal") == values(out, "enhanced_combined") == either


def test_quantiles(spark):
    df = spark.range(1, 11).select(F.lit("A").alias("t"), F.col("id").cast("double").alias("v"))
    for keys in (["t"], []):
        got = exact_quantiles(df, keys, "v", lb.SIZE_QUANTILES).first()
        assert (got.p90, got.p95, got.p98) == pytest.approx((9.1, 9.55, 9.82))


def test_percent_rank_averages_ties(spark, group_rows):
    df = spark.createDataFrame([(0, 5.0), (1, 5.0), (2, 7.0), (3, None)], "n int, v double").withColumn("ticker", F.lit("A"))
    df = df.unionByName(spark.range(20).select((F.col("id") + 10).cast("int").alias("n"), F.lit(None).cast("double").alias("v"), F.lit("A").alias("ticker")))
    out = history.ranks(df, ["ticker"], ["v"]).where("n < 4").orderBy("n")
    assert values(out, "v_rank") == [0.5, 0.5, 1.0, None]


def scores(spark, pairs):
    return spark.createDataFrame([(i, float(s), y) for i, (s, y) in enumerate(pairs)], "id int, predicted_proba double, y_label int")


def test_average_precision_and_auc(spark):
    got = m.ranking_quality(scores(spark, [(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)])).first()
    assert (got.pr_auc, got.roc_auc) == pytest.approx((5 / 6, 0.875))


def test_precision_at_top_share(spark):
    pairs = [(1 - i / 1500, int(i in (0, 5, 14))) for i in range(1500)]
    out = m.top_share_precision(scores(spark, pairs), ["id"]).orderBy("share")
    assert values(out, "k") == [1, 7, 15, 75]
    assert values(out, "ceiling") == pytest.approx([1.0, 3 / 7, 0.2, 0.04])
    assert values(out, "precision") == pytest.approx([1.0, 2 / 7, 0.2, 0.04])
    tied = m.top_share_precision(scores(spark, [(0.5, int(i == 1)) for i in range(40)]), ["id"], [0.05]).first()
    assert (tied.k, tied.precision) == (2, 0.5)


@pytest.mark.parametrize("positives, negatives, kept", [(3, 100, 30), (3, 20, 20), (0, 5, 0)])
def test_under_sampling_is_exact(spark, positives, negatives, kept):
    n = positives + negatives
    df = spark.range(n).select(F.col("id").cast("string").alias("order_id"), F.lit("d").alias("trade_date"), F.lit("A").alias("ticker"),
                               F.when(F.col("id") < positives, 1).otherwise(0).alias("y_label"))
    out = sel.under_sample(df)
    got = {r["y_label"]: r["count"] for r in out.groupBy("y_label").count().collect()}
    assert (got.get(1, 0), got.get(0, 0)) == (positives, kept)
    assert sorted(r.order_id for r in out.collect()) == sorted(r.order_id for r in sel.under_sample(df.repartition(3)).collect())


def test_strata_without_a_class_are_dropped(spark):
    rows = [("A", 1), ("A", 0), ("B", 0), ("C", 1)]
    df = spark.createDataFrame([("d", t, str(i), y) for i, (t, y) in enumerate(rows)], "trade_date string, ticker string, order_id string, y_label int")
    assert sorted(values(sel.under_sample(df, by=["ticker"]), "ticker")) == ["A", "A"]
    assert sorted(values(sel.under_sample(df, ratio=1), "ticker")) == sorted(["A", "C"] + values(sel.under_sample(df, ratio=1).where("y_label = 0"), "ticker"))


def test_projections(spark):
    df = spark.createDataFrame([("d", "A", "1", 1.0, 5.0, "x", "3.5", 1, 7)], "trade_date string, ticker string, order_id string, spread double, survival_ms double, note string, order_price string, y_label int, unknown int")
    assert set(lk.clean_for_training(df).columns) == {"spread", "order_price", "y_label", "unknown"}
    assert lk.clean_for_training(df).first().order_price == 3.5
    assert "survival_ms" not in lk.feature_table(df).columns
    with pytest.raises(ValueError):
        lk.label_table(df.drop("ticker"))
    two = df.unionByName(df.withColumn("spread", F.lit(2.0)).withColumn("y_label", F.lit(0)))
    assert lk.white_listed(two).columns == ["spread", "y_label"]


def test_undefined_is_null_not_infinite(spark):
    df = spark.createDataFrame([(1.0, float("inf"), None), (float("nan"), 0.0, 2)], "a double, b double, c int")
    assert values(fx.sanitised(df), "a", "b", "c") == [(1.0, 0.0, 0), (0.0, 0.0, 2)]
