"""Operators against independent definitions on random data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewatch.operators import asof, history, metrics as m, ordered, rolling
from tapewatch.plans import stages

BASE = pd.Timestamp("2025-03-03 09:30:00")


def flow(seed, n=160):
    """Orders of three tickers, one of them with two thirds of all rows, with ties and gaps."""
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(
        {
            "trade_date": "20250303",
            "ticker": rng.choice(["A", "A", "A", "A", "B", "C"], n),
            "order_id": [f"{i:05d}" for i in range(n)],
            "order_ts": BASE + pd.to_timedelta(rng.integers(0, 40, n) * 25, unit="ms"),
            "order_price": rng.normal(10, 1, n).round(2),
            "order_qty": rng.integers(1, 9, n) * 100.0,
            "mid_price": np.where(rng.random(n) < 0.2, np.nan, rng.normal(10, 1, n)),
            "spread": np.where(rng.random(n) < 0.2, np.nan, rng.integers(1, 5, n) / 100),
            "log_qty": rng.normal(5, 1, n).round(1),
        }
    )
    frame["event_ts"] = frame.order_ts + pd.to_timedelta(rng.integers(0, 300, n), unit="ms")
    frame["event_type"] = rng.choice(["cancel", "trade"], n)
    frame["side"] = rng.choice(["B", "S"], n)
    return frame


def to_spark(spark, frame):
    df = spark.createDataFrame(frame)
    stamps = {c: F.col(c).cast("timestamp_ntz") for c, k in df.dtypes if k == "timestamp"}
    doubles = {c: F.when(~F.isnan(c), F.col(c)) for c, k in df.dtypes if k == "double"}
    return df.withColumns(stamps | doubles)


def column(df, name):
    return df.select("order_id", name).toPandas().set_index("order_id")[name].sort_index()


def close(ours, theirs):
    theirs = theirs.sort_index()
    np.testing.assert_allclose(ours.astype(float).to_numpy(), theirs.astype(float).to_numpy(), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("seed", [1, 2])
def test_asof_equals_resampled_grid(spark, group_rows, seed):
    rng = np.random.default_rng(seed)
    orders = flow(seed)
    n = 50
    quotes = pd.DataFrame(
        {
            "trade_date": "20250303",
            "ticker": rng.choice(["A", "B"], n),
            "quote_ts": BASE + pd.to_timedelta(rng.choice(np.arange(0, 800), n, replace=False), unit="ms"),
            "bid1": np.where(rng.random(n) < 0.2, np.nan, rng.normal(10, 1, n)),
        }
    )
    ours = asof.with_quotes(
        to_spark(spark, orders[["trade_date", "ticker", "order_id", "order_ts"]]), asof.first_quotes(to_spark(spark, quotes)), values=["bid1"]
    )
    parts = []
    for ticker, mine in orders.sort_values("order_ts").groupby("ticker"):
        q = quotes[quotes.ticker == ticker].sort_values("quote_ts").set_index("quote_ts")[["bid1"]]
        if q.empty:
            parts.append(mine.assign(bid1=np.nan))
            continue
        # the last row at or before each grid point, nulls included
        grid = pd.date_range(q.index.min().floor("100ms"), q.index.max().floor("100ms"), freq="100ms", name="quote_dt")
        spot = q.index.searchsorted(grid, side="right") - 1
        at = pd.DataFrame({"quote_dt": grid, "bid1": [q.bid1.iloc[i] if i >= 0 else np.nan for i in spot]})
        parts.append(pd.merge_asof(mine, at, left_on="order_ts", right_on="quote_dt", tolerance=pd.Timedelta("100ms")))
    close(column(ours, "bid1"), pd.concat(parts).set_index("order_id").bid1)


@pytest.mark.parametrize("seed", [3, 4])
def test_rolling_counts_equal_pandas(spark, group_rows, seed):
    frame = flow(seed)
    ours = rolling.order_counts(to_spark(spark, frame), {"100ms": 100_000, "1s": 1_000_000})
    for name, window in (("orders_100ms", "100ms"), ("orders_1s", "1s")):
        parts = []
        for _, mine in frame.sort_values("order_ts").groupby("ticker"):
            counts = mine.assign(one=1.0).rolling(window, on="order_ts", closed="left").one.count().fillna(0)
            # rows of the same instant must not see each other
            mine = mine.assign(n=counts.to_numpy())
            mine["n"] = mine.groupby("order_ts").n.transform("min")
            parts.append(mine.set_index("order_id").n)
        close(column(ours, name), pd.concat(parts))


def test_rolling_counts_with_repeated_ids_ties_and_nulls(spark, group_rows):
    frame = flow(3)
    frame["place"] = range(len(frame))
    frame["order_id"] = (frame.place % 7).astype(str)
    times = frame.order_ts.to_numpy()
    expected = {}
    for row in frame.itertuples():
        ahead = (frame.ticker == row.ticker) & (times < np.datetime64(row.order_ts)) & (times >= np.datetime64(row.order_ts - pd.Timedelta("100ms")))
        expected[row.place] = int(ahead.sum())
    df = to_spark(spark, frame)
    ours = rolling.order_counts(df, {"100ms": 100_000})
    assert {r.place: r.orders_100ms for r in ours.collect()} == expected
    blank = F.lit(None).cast("string")
    nulls = df.withColumn("ticker", F.when(F.col("ticker") == "A", blank).otherwise(F.col("ticker")))
    assert {r.place: r.orders_100ms for r in rolling.order_counts(nulls, {"100ms": 100_000}).collect()} == expected


def test_history_counts_by_event_time(spark, group_rows):
    frame = flow(5)
    ours = rolling.history_counts(to_spark(spark, frame), {"100ms": 100_000})
    wanted = {}
    for row in frame.itertuples():
        same = frame[(frame.ticker == row.ticker) & (frame.event_type == "cancel")]
        past = (same.event_ts < row.order_ts) & (same.event_ts >= row.order_ts - pd.Timedelta("100ms"))
        wanted[row.order_id] = past.sum()
    close(column(ours, "cancels_100ms"), pd.Series(wanted))


def test_history_features_equal_pandas(spark, group_rows):
    frame = flow(6).sort_values(["trade_date", "order_ts", "order_id"])
    df = to_spark(spark, frame)
    by = frame.groupby("ticker")
    indexed = frame.set_index("order_id").groupby("ticker")
    mid = by.mid_price.ffill()
    close(column(history.trailing_deviation(df, ["ticker"], {"x": ("mid_price", 7)}), "x"), indexed.mid_price.transform(lambda x: x.rolling(7, min_periods=1).std()))
    moved = mid / mid.groupby(frame.ticker).shift(5) - 1
    close(column(history.momentum(df, ["ticker"]), "price_momentum"), moved.set_axis(frame.order_id))
    means = history.earlier_means(df, ["ticker"])
    close(column(means, "hist_spread_mean"), indexed.spread.transform(lambda x: x.expanding().mean().shift(1)))
    close(column(means, "hist_order_size_mean"), indexed.log_qty.transform(lambda x: x.expanding().mean().shift(1)))
    close(column(history.ranks(df, ["ticker"], ["spread"]), "spread_rank"), indexed.spread.transform(lambda x: x.rank(pct=True)))

    def score(stamps):
        gap = stamps.diff().dt.total_seconds().mul(1000).fillna(0)
        return (gap - gap.expanding().mean().shift(1).fillna(0)) / (gap.expanding().std().shift(1).fillna(1) + 1e-8)

    ours = column(history.arrival_gap_score(df), "z_survival")
    theirs = indexed.order_ts.transform(lambda x: score(x).to_numpy()).astype(float)
    np.testing.assert_allclose(ours.to_numpy(), theirs.sort_index().to_numpy(), rtol=1e-6, atol=1e-6)
    changes = history.row_changes(df)
    before = indexed.spread.shift(1)
    close(column(changes, "spread_change"), (frame.set_index("order_id").spread - before) / (before + 1e-8))


def test_ordered_blocks_with_ties_and_nulls(spark, group_rows):
    df = to_spark(spark, flow(7))
    order = ["order_ts", "order_id"]
    up_to_now = Window.partitionBy("ticker").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wanted = df.withColumns({"seen": F.last("spread", True).over(up_to_now), "n": F.count(F.lit(1)).over(up_to_now)})
    close(column(ordered.last_known(df, ["ticker"], order, {"seen": F.col("spread")}), "seen"), column(wanted, "seen"))
    totals = ordered.running_totals(df, ["ticker"], [F.col(c) for c in order], {"n": F.lit(1)}, {"all": "n"})
    close(column(totals, "n"), column(wanted, "n"))
    sizes = df.groupBy("ticker").count().collect()
    assert {(r["ticker"], r["all"]) for r in totals.select("ticker", "all").distinct().collect()} == {tuple(r) for r in sizes}


@pytest.mark.parametrize("seed", [8, 9])
def test_ranking_quality_equals_pairwise_definition(spark, seed):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"g": rng.choice(["x", "y"], 120), "predicted_proba": rng.integers(0, 25, 120) / 25, "y_label": rng.integers(0, 2, 120)})
    got = m.ranking_quality(spark.createDataFrame(frame), ["g"]).toPandas().set_index("g")
    for g, mine in frame.groupby("g"):
        pos, neg = mine[mine.y_label == 1].predicted_proba, mine[mine.y_label == 0].predicted_proba
        wins = sum((p > neg).sum() + 0.5 * (p == neg).sum() for p in pos)
        assert got.roc_auc[g] == pytest.approx(wins / (len(pos) * len(neg)))
        precision = [(mine[mine.predicted_proba >= p].y_label.mean()) for p in pos]
        assert got.pr_auc[g] == pytest.approx(np.mean(precision))


def test_ranking_quality_of_very_many_rows(spark):
    """Counts near 1e10 in each class, made of few score steps."""
    steps = [(0.9, 9_000_000_000, 8_000_000_000), (0.5, 5_000_000_000, 2_000_000_000), (0.1, 9_000_000_000, 500_000_000)]
    table = spark.createDataFrame(steps, "score double, rows long, positives long").withColumn("ticker", F.lit("A"))
    found = m.quality_of_steps(m.with_running_totals(table, ["ticker"]), ["ticker"]).first()
    positives = sum(p for _, _, p in steps)
    negatives = sum(n - p for _, n, p in steps)
    ahead, wins = 0, 0.0
    for _, n, p in steps:
        wins += (n - p) * (ahead + p / 2)
        ahead += p
    assert found.roc_auc == pytest.approx(wins / (positives * negatives))


def test_totals_are_told_from_null_groups(spark):
    rows = [(None, 1, 0.9), ("A", 0, 0.2), ("A", 1, None)]
    df = spark.createDataFrame(rows, "ticker string, y_label int, predicted_proba double")
    found = {(r.scope, r.ticker): r.tp + r.fp + r.tn + r.fn for r in m.confusion(df, group="ticker").collect()}
    assert found == {("total", None): 2, ("ticker", None): 1, ("ticker", "A"): 1}
    sweep = m.threshold_sweep(df, [0.5]).first()
    assert sweep.tp + sweep.fp + sweep.tn + sweep.fn == 2


def test_threshold_sweep_marks_the_first_best(spark):
    frame = pd.DataFrame({"predicted_proba": [1e-6, 1e-5, 0.003, 0.2, 0.0], "y_label": [0, 0, 1, 1, 1]})
    out = m.threshold_sweep(spark.createDataFrame(frame)).orderBy("step").toPandas()
    cuts = np.logspace(-6, -1, 100)
    np.testing.assert_allclose(out.threshold, cuts)
    f1 = []
    for cut in out.threshold:
        hit = frame.predicted_proba >= cut
        tp, fp, fn = (hit & (frame.y_label == 1)).sum(), (hit & (frame.y_label == 0)).sum(), (~hit & (frame.y_label == 1)).sum()
        f1.append(2 * tp / (2 * tp + fp + fn))
    np.testing.assert_allclose(out.f1, f1)
    assert list(out.index[out.is_best == 1]) == [int(np.argmax(f1))]


def test_features_ignore_the_future(spark, group_rows):
    """No feature of an order changes when everything after it is removed."""
    frame = flow(10).rename(columns={"mid_price": "bid1"}).drop(columns=["spread", "log_qty"])
    frame["ask1"] = frame.bid1 + 0.02
    frame = frame.sort_values(["order_ts", "order_id"]).reset_index(drop=True)
    cut = frame[frame.order_ts <= frame.order_ts.iloc[len(frame) // 2]]
    full = stages.features(to_spark(spark, frame)).toPandas().set_index("order_id")
    part = stages.features(to_spark(spark, cut)).toPandas().set_index("order_id").sort_index()
    pd.testing.assert_frame_equal(full.loc[part.index], part)


@pytest.mark.parametrize("partitions", ["1", "4", "16"])
def test_result_does_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = to_spark(spark, flow(11)).repartition(int(partitions))
        stats = ordered.exact_quantiles(df, ["ticker"], "order_qty", {"p50": 0.5}).orderBy("ticker").collect()
        wanted = flow(11).groupby("ticker").order_qty.quantile(0.5)
        assert [r.p50 for r in stats] == list(wanted)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
