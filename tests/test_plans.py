"""Shapes of plans: shuffles, sorts and scans that must not come back."""

import re

import pytest
from pyspark.sql import functions as F

from tapewatch.operators import asof, events as ev, ordered
from tests.test_properties import flow, to_spark


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def nodes(df, *names):
    """How often each operator stands in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    return tuple(len(re.findall(rf"^[\s:+\-*()0-9]*{name}\b", plan, re.M)) for name in names)


def sides(spark):
    frame = to_spark(spark, flow(31, 400)).repartition(4)
    orders = frame.select("trade_date", "ticker", F.pmod(F.hash("order_id"), F.lit(90)).cast("string").alias("order_id"), "order_ts", "side")
    events = frame.select("trade_date", "ticker", F.pmod(F.hash("order_id", F.lit(1)), F.lit(90)).cast("string").alias("order_id"), "event_ts", "event_type", F.col("side").alias("event_side"))
    return orders, events


def test_first_rows_and_their_join_take_one_shuffle_and_one_sort_a_side(spark, no_broadcast):
    orders, events = sides(spark)
    joined = ev.orders_with_events(orders, events)
    assert nodes(joined, "Exchange hashpartitioning", "Sort", "SortAggregate", "SortMergeJoin") == (2, 2, 0, 1)
    plain = ev.orders_with_events(orders, events, few=False)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))


def test_first_quotes_take_one_sort(spark):
    frame = to_spark(spark, flow(32, 300)).repartition(4)
    quotes = frame.select("trade_date", "ticker", F.col("order_ts").alias("quote_ts"), F.col("mid_price").alias("bid1"), F.col("spread").alias("ask1"))
    once = asof.first_quotes(quotes)
    assert nodes(once, "Exchange hashpartitioning", "Sort", "SortAggregate") == (1, 1, 0)
    assert sorted(map(str, once.collect())) == sorted(map(str, asof.first_quotes(quotes, few=False).collect()))


def test_rows_without_a_key_match_nothing(spark):
    orders, events = sides(spark)
    blank = lambda df: df.withColumn("order_id", F.when(F.col("order_id") != "7", F.col("order_id")))
    assert ev.orders_with_events(blank(orders), blank(events)).where("order_id IS NULL").count() == 0


def test_bucketed_tables_join_without_a_shuffle(spark, no_broadcast, tmp_path):
    from tapewatch.operators.selection import features_with_labels
    from tapewatch.plans import stages
    from tapewatch.sources import tables

    day = to_spark(spark, flow(33, 200))
    other = to_spark(spark, flow(34, 150)).withColumn("trade_date", F.lit("20250304"))
    flat = day.unionByName(other)
    parts = {"features": flat.drop("event_ts", "event_type"), "labels": flat.select("trade_date", "ticker", "order_id", F.lit(1).alias("y_label")), "stream": flat}
    paths = {name: str(tmp_path / name) for name in parts}
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    try:
        for name, rows in parts.items():
            tables.write_bucketed(rows, paths[name], 3)
        # another session knows the files by their path alone
        for path in paths.values():
            spark.sql(f"DROP TABLE {tables._declared(spark, path)}")
        features, labels, stream = (tables.read_bucketed(spark, path) for path in paths.values())
        joined = features_with_labels(features, labels)
        assert nodes(joined, "Exchange", "SortMergeJoin") == (0, 1) and joined.count() == 350
        counted = stages.with_recent_cancels(features, stream)
        assert nodes(counted, "Exchange", "SortMergeJoin") == (0, 1)
        plain = stages.with_recent_cancels(parts["features"], flat)
        key = ["trade_date", "order_id", "cancels_5s"]
        assert sorted(map(tuple, counted.select(*key).collect())) == sorted(map(tuple, plain.select(*key).collect()))
        # a day is replaced as a whole, the others stay
        tables.write_bucketed(parts["labels"].where("trade_date = '20250304'").limit(10), paths["labels"], 3)
        left = {r["trade_date"]: r["count"] for r in tables.read_bucketed(spark, paths["labels"]).groupBy("trade_date").count().collect()}
        assert left == {"20250303": 200, "20250304": 10}
        with pytest.raises(ValueError, match="buckets"):
            tables.write_bucketed(parts["labels"], paths["labels"], 4)
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", before)


PROBABILITIES = {"low": 0.0, "p25": 0.25, "mid": 0.5, "p98": 0.98, "high": 1.0}


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_by_selection_equal_sorting(spark, group_rows, seed):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"g": rng.choice(["x", "x", "x", "y"], 30000), "v": rng.normal(0, 1, 30000), "steps": rng.integers(0, 5, 30000) * 1.0})
    frame.loc[rng.random(30000) < 0.1, "v"] = np.nan
    df = to_spark(spark, frame).repartition(6)
    for column in ("v", "steps"):
        found = ordered.exact_quantiles(df, ["g"], column, PROBABILITIES).toPandas().set_index("g")
        for g, mine in frame.groupby("g"):
            np.testing.assert_allclose(found.loc[g].to_numpy(float), np.quantile(mine[column].dropna(), list(PROBABILITIES.values())), rtol=1e-12)
    whole = ordered.quantiles_of_columns(df, ["v", "steps"], PROBABILITIES).toPandas().set_index("feature")
    for column in ("v", "steps"):
        np.testing.assert_allclose(whole.loc[column].to_numpy(float), np.quantile(frame[column].dropna(), list(PROBABILITIES.values())), rtol=1e-12)


def test_only_the_neighbourhood_of_a_quantile_is_told_apart(spark, monkeypatch):
    """Of 200,000 distinct values a few hundred are counted by value, and no sort is in the plan that counts them."""
    seen = []
    kept = ordered.staged

    def noted(df):
        seen.append((nodes(df, "Sort"), kept(df).count()))
        return kept(df)

    monkeypatch.setattr(ordered, "staged", noted)
    df = spark.range(200_000).select(F.pmod(F.col("id") * 7919, F.lit(200_003)).cast("double").alias("v"))
    found = ordered.exact_quantiles(df, [], "v", {"mid": 0.5, "p90": 0.9}).first()
    values = sorted(k * 7919 % 200_003 for k in range(200_000))
    assert found["mid"] == (values[99_999] + values[100_000]) / 2 and found["p90"] == pytest.approx(values[179_999] + 0.1 * (values[180_000] - values[179_999]))
    assert seen[0][0] == (0,) and seen[0][1] < 1000


def test_a_missed_bracket_is_widened(spark, monkeypatch):
    tried = []
    kept = ordered._edges

    def off(value, probabilities, slack):
        tried.append(slack)
        return kept(value, [0.1] * len(probabilities), slack) if len(tried) < 3 else kept(value, probabilities, slack)

    monkeypatch.setattr(ordered, "_edges", off)
    df = spark.range(5001).select(F.col("id").cast("double").alias("v"))
    assert ordered.exact_quantiles(df, [], "v", {"mid": 0.5}).first()["mid"] == 2500.0
    assert tried == [2 * ordered.SKETCH_ERROR * 16**k for k in range(3)]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, "a")], "v double, g string")
    assert ordered.exact_quantiles(df, [], "v", {"mid": 0.5}).count() == 0
    assert ordered.exact_quantiles(df, ["g"], "v", {"mid": 0.5}).count() == 0
    assert ordered.exact_quantiles(df.where("false"), [], "v", {"mid": 0.5}).count() == 0
