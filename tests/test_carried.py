"""Histories with a carry: cut over tasks, cut over days, and scored from a stored state."""

import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewatch.operators import carried, history
from tapewatch.plans import models, scoring, stages, training
from tapewatch.schemas import TICKER_DAY
from tapewatch.session import staged
from tapewatch.sources import tables
from tests.test_properties import flow, to_spark

DAYS = ("20250303", "20250304", "20250305", "20250306")


def days_of(n=130):
    """Four days: a ticker without any known price on the second, one absent on the third, a new one on the last."""
    frames = []
    for k, day in enumerate(DAYS):
        frame = flow(20 + k, n)
        frame["trade_date"], frame["order_id"] = day, [f"{k}-{i:05d}" for i in range(n)]
        frame["order_ts"] += pd.Timedelta(days=k)
        frame["event_ts"] += pd.Timedelta(days=k)
        if k == 1:
            frame.loc[frame.ticker == "A", "mid_price"] = np.nan
        if k == 2:
            frame = frame[frame.ticker != "B"]
        if k == 3:
            frame.loc[frame.index % 10 == 0, "ticker"] = "D"
        frames.append(frame)
    return frames


def plainly(df):
    return history.earlier_means(history.momentum(history.trailing_deviation(df, ["ticker"]), ["ticker"]), ["ticker"])


def table_of(df, columns=carried.FEATURES):
    return df.select("order_id", *columns).toPandas().set_index("order_id").sort_index().astype(float)


def same(ours, theirs):
    assert list(ours.index) == list(theirs.index)
    np.testing.assert_allclose(ours.to_numpy(), theirs.to_numpy(), rtol=1e-9, atol=1e-9)


def test_one_pass_equals_the_single_windows(spark, group_rows):
    df = to_spark(spark, pd.concat(days_of(), ignore_index=True))
    found = carried.History(df, ["ticker"]).features()
    assert found.columns == [*df.columns, *carried.FEATURES]
    same(table_of(found), table_of(plainly(df)))


def test_day_by_day_equals_the_whole_history(spark, group_rows):
    frames = days_of()
    state, parts = None, []
    for k, frame in enumerate(frames):
        run = carried.History(to_spark(spark, frame), ["ticker"], state)
        parts.append(table_of(run.features()))
        state = staged(run.state())
    whole = to_spark(spark, pd.concat(frames, ignore_index=True))
    same(pd.concat(parts).sort_index(), table_of(plainly(whole)))
    left = {r.ticker: r for r in state.collect()}
    assert set(left) == {"A", "B", "C", "D"} and all(len(r.tail) <= carried.TAIL_ROWS for r in left.values())
    all_rows = pd.concat(frames)
    for ticker, mine in all_rows.groupby("ticker"):
        spread = mine.spread.dropna()
        assert left[ticker].n_spread == len(spread) and left[ticker].sum_spread == pytest.approx(spread.sum())
        assert left[ticker].sq_spread == pytest.approx(((spread - spread.mean()) ** 2).sum())


def test_a_state_of_nothing_and_a_run_of_nothing(spark):
    df = to_spark(spark, days_of()[0])
    nothing = carried.History(df.where("false"), ["ticker"])
    assert nothing.features().count() == 0 and nothing.state().count() == 0
    state = staged(carried.History(df, ["ticker"]).state())
    kept = carried.History(df.where("false"), ["ticker"], state).state()
    assert {tuple(r) for r in kept.select("ticker", "n_spread").collect()} == {tuple(r) for r in state.select("ticker", "n_spread").collect()}


def test_one_staged_write_for_large_groups(spark, monkeypatch):
    """A large group is written once in full width; the carry beside it has one row a stretch."""
    from tapewatch.operators import ordered

    written = []
    kept = ordered.staged

    def noted(df):
        out = kept(df)
        written.append((len(df.columns), out.count()))
        return out

    monkeypatch.setattr(ordered, "staged", noted)
    monkeypatch.setattr(carried, "staged", noted)
    spark.conf.set("tapewatch.groupRows", "8")
    try:
        df = to_spark(spark, pd.concat(days_of(), ignore_index=True))
        rows = df.count()
        carried.History(df, ["ticker"]).features().collect()
    finally:
        spark.conf.unset("tapewatch.groupRows")
    assert [n for _, n in written if n >= rows] == [rows]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Features, labels, stream and a model below one root."""
    root = str(tmp_path_factory.mktemp("daily"))
    frames = days_of(90)
    for frame in frames:
        for c in ("bid1", "ask1", "prev_close"):
            frame[c] = frame.order_price + {"bid1": -0.1, "ask1": 0.1, "prev_close": 0.5}[c]
        frame["bid_vol1"], frame["ask_vol1"], frame["survival_ms"] = 100.0, 200.0, 20.0
    all_days = pd.concat(frames, ignore_index=True).drop(columns=["mid_price", "spread", "log_qty"])
    stream = to_spark(spark, all_days).withColumn("order_type", F.lit("0"))
    tables.write_daily(stream, f"{root}/stream")
    tables.write_daily(stages.features(stream), f"{root}/features")
    tables.write_daily(stages.labels(stream).withColumn("y_label", F.when(F.col("order_qty") > 400, 1).otherwise(0)), f"{root}/labels")
    members = {"forest": models.random_forest(5, leaf_rows=1), "linear": models.linear_member()}
    training.run_training(spark, root, f"{root}/out", members, f"{root}/stream", train="2025030[34]", valid="2025030[56]", sampling="none", within=TICKER_DAY)
    return root


def scores_of(spark, path):
    return tables.read_predictions(spark, path).select("order_id", "predicted_proba").toPandas().set_index("order_id").sort_index()


def test_scoring_by_runs_equals_scoring_at_once(spark, stored, tmp_path):
    root = str(tmp_path / "copy")
    shutil.copytree(stored, root)

    def run(name, dates, **more):
        return scoring.run_daily_scoring(spark, f"{root}/out/model", root, str(tmp_path / name), str(tmp_path / f"{name}-state"), dates, stream_path=f"{root}/stream", **more)

    assert run("whole", DAYS)["summary"].count() == 1
    whole = scores_of(spark, str(tmp_path / "whole"))
    # days that nobody asked for are carried, not scored
    run("daily", [DAYS[0]])
    run("daily", [DAYS[3]])
    found = scores_of(spark, str(tmp_path / "daily"))
    same(found, whole.loc[found.index])
    assert len(found) == sum(len(f) for k, f in enumerate(days_of(90)) if k in (0, 3))
    # a day before stored states must take these away
    states = str(tmp_path / "daily-state")
    assert tables.state_days(spark, states) == [DAYS[0], DAYS[3]]
    with pytest.raises(ValueError, match="replace_later"):
        run("daily", [DAYS[1]])
    run("daily", [DAYS[1]], replace_later=True)
    assert tables.state_days(spark, states) == list(DAYS[:2])
    # a new day reads no earlier one: their files are gone
    for table in ("features", "labels", "stream"):
        for day in DAYS[:2]:
            shutil.rmtree(f"{root}/{table}/trade_date={day}")
    run("daily", [DAYS[2]])
    same(scores_of(spark, str(tmp_path / "daily")), whole)
