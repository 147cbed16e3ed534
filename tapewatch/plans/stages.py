"""Ticks to event stream, event stream to labels and features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.functions.times import micros
from tapewatch.operators import features as fx
from tapewatch.operators.asof import GRID_US, with_quotes
from tapewatch.operators.events import (
    in_hours,
    orders_with_events,
    restrict,
    survival_ms,
    with_order_features,
    with_session_features,
)
from tapewatch.operators.carried import History
from tapewatch.operators.history import arrival_gap_score, ranks, row_changes, standard_scores
from tapewatch.operators.labels import label_orders
from tapewatch.operators.leakage import feature_table, label_table
from tapewatch.operators.ordered import Groups, measure_groups
from tapewatch.operators.rolling import WINDOWS, history_counts, order_counts
from tapewatch.plans.reports import event_stream_summary, label_summary
from tapewatch.schemas import EVENT_STREAM, TICKER_DAY
from tapewatch.session import configure
from tapewatch.sources import raw_csv, tables


def event_stream(
    orders: DataFrame,
    events: DataFrame,
    quotes: DataFrame,
    trading_hours_only: bool = True,
    grid_us: int = GRID_US,
    tolerance_us: int = GRID_US,
    groups: Groups | None = None,
) -> DataFrame:
    """One row per order: its first event, the quote it met, survival time and basic features."""
    if groups is None:
        # every order yields at most one row, so the inputs bound the size of a ticker-day
        groups = measure_groups(orders.select(*TICKER_DAY).unionByName(quotes.select(*TICKER_DAY)), TICKER_DAY)
    if trading_hours_only:
        orders = in_hours(orders)
    joined = orders_with_events(orders, events)
    quoted = with_quotes(joined, quotes, grid_us=grid_us, tolerance_us=tolerance_us, groups=groups)
    survived = quoted.withColumn("survival_ms", survival_ms(F.col("order_ts"), F.col("event_ts")))
    full = with_session_features(with_order_features(survived))
    return full.select(*[F.col(f.name) for f in EVENT_STREAM.fields if f.name in full.columns])


def labels(stream: DataFrame, extended: bool = True, tickers: list[str] | None = None, **thresholds) -> DataFrame:
    """Label table of an event stream. Book columns are derived first, so the price rules can fire."""
    booked = fx.with_mid(fx.with_book(stream))
    return label_table(label_orders(booked, extended=extended, tickers=tickers, **thresholds), extended)


def features(stream: DataFrame, extended: bool = True, tickers: list[str] | None = None) -> DataFrame:
    """Feature table of an event stream: only what was known when the order arrived."""
    stream = restrict(stream, tickers=tickers)
    groups = measure_groups(stream, TICKER_DAY)
    based = fx.with_base_features(fx.with_book(stream)).withColumn("_us", micros(F.col("order_ts")))
    if extended:
        # row windows first: their order by (time, id) also serves the time windows, one sort for all
        order = ("_us", "order_id")
        based = row_changes(arrival_gap_score(based, order=order, groups=groups), order=order, groups=groups)
    counted = order_counts(based, groups=groups, clock="_us")
    return feature_table(fx.with_order_density(counted) if extended else counted, extended)


def safe_features(stream: DataFrame) -> DataFrame:
    """Market features and past activity (orders and cancel ratios) only."""
    market = fx.with_safe_market_features(fx.with_book(stream))
    return history_counts(market)


def enriched(df: DataFrame, by: Sequence[str] = ("split", "ticker"), within: Sequence[str] | None = None) -> DataFrame:
    """Model-input features over a ticker's history; with ``split`` in ``by`` none crosses the split.

    Ranks and standard scores compare the rows of ``within``, which is ``by`` unless given. Existing columns win
    over new ones of the same name.
    """
    return enriched_from(df, None, by, within)[0]


def enriched_from(
    df: DataFrame, state: DataFrame | None, by: Sequence[str] = ("ticker",), within: Sequence[str] | None = TICKER_DAY
) -> tuple[DataFrame, History]:
    """``enriched`` with the histories continued from ``state``; the ``History`` gives the state after ``df``."""
    keys, compared = list(by), list(within or by)
    present = set(df.columns)
    fixed = fx.add_missing(df, {"relative_spread": fx.relative_spread()})
    fixed = fx.add_missing(
        fixed, {"order_imbalance": fx.order_imbalance(df.columns), **fx.quote_level_flags()}
    )
    groups = measure_groups(df, keys)
    # group statistics first: they are read from the table itself, not from the windows below
    history = History(standard_scores(fixed, compared), keys, state, groups=groups)
    wide = ranks(history.features(), compared, groups=groups if compared == keys else None)
    known = fx.interaction_columns()
    if "cancels_5s" not in present:
        known.pop("orders_cancels_ratio")
    return fx.sanitised(fx.add_missing(wide, known)), history


def with_recent_cancels(df: DataFrame, stream: DataFrame) -> DataFrame:
    """Attach ``cancels_5s`` of the event stream to a feature table."""
    needed = stream.select(*TICKER_DAY, "order_id", "order_ts", "event_ts", "event_type")
    counts = history_counts(needed, {"5s": WINDOWS["5s"]}).select(*TICKER_DAY, "order_id", "cancels_5s")
    return df.join(counts, [*TICKER_DAY, "order_id"], "left")


def run_event_stream(spark: SparkSession, base: str, out: str, trading_hours_only: bool = True, **source) -> DataFrame:
    """Raw files to the event-stream table, all days at once; returns the per-day statistics."""
    configure(spark)
    orders, events, quotes = raw_csv.read_ticks(spark, base, **source)
    where = {k: source[k] for k in ("dates", "tickers") if k in source}
    groups = measure_groups(raw_csv.row_bounds(spark, base, **where), TICKER_DAY, rows="rows_at_most")
    tables.write_daily(event_stream(orders, events, quotes, trading_hours_only, groups=groups), out)
    return event_stream_summary(tables.read_table(spark, out))


def run_labels(
    spark: SparkSession, stream_path: str, out: str, dates: Sequence[str] = (), extended: bool = True, **options
) -> DataFrame:
    configure(spark)
    stream = tables.read_table(spark, stream_path, dates=dates)
    tables.write_daily(labels(stream, extended, **options), out)
    return label_summary(tables.read_table(spark, out, dates=dates))


def run_features(
    spark: SparkSession, stream_path: str, out: str, dates: Sequence[str] = (), extended: bool = True, **options
) -> DataFrame:
    configure(spark)
    stream = tables.read_table(spark, stream_path, dates=dates)
    tables.write_daily(features(stream, extended, **options), out)
    return tables.read_table(spark, out, dates=dates).groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"))
