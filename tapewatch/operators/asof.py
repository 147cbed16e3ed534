"""Attach the prevailing quote to each order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.times import from_micros, micros
from tapewatch.operators.ordered import Groups, first_per_key, join_on, last_known, measure_groups, small_side
from tapewatch.schemas import QUOTE_VALUES, TICKER_DAY

GRID_US = 100_000


def first_quotes(quotes: DataFrame, keys: Sequence[str] = TICKER_DAY, order: Sequence[str] = (), few: bool = True) -> DataFrame:
    """One quote per instant: the first by ``order`` (a file position, if known), else by value.

    An instant of a ticker holds a few quotes; ``few=False`` is for tables where it may hold millions.
    """
    chosen = first_per_key(quotes.where(F.col("quote_ts").isNotNull()), [*keys, "quote_ts"], [F.col(c) for c in order], few)
    return chosen.drop(*order)


def _spread(rows: DataFrame) -> Column:
    """Tells orders of one instant apart, so that even those can be cut into several tasks' shares."""
    return F.hash(*rows.columns).alias("_tie")


def with_quotes(
    orders: DataFrame,
    quotes: DataFrame,
    keys: Sequence[str] = TICKER_DAY,
    values: Sequence[str] = QUOTE_VALUES,
    grid_us: int = GRID_US,
    tolerance_us: int = GRID_US,
    groups: Groups | None = None,
) -> DataFrame:
    """As-of match on a regular grid that is never built.

    The grid covers the span of a ticker-day's quotes in steps of ``grid_us``; a grid point shows the
    last quote row at or before it. An order sees the last grid point at or before it, if at most
    ``tolerance_us`` old. Both steps together are: the last quote at or before
    ``min(floor(order time), last grid point)``, read off one ordered pass over quotes and orders.
    ``quotes`` holds one row per instant (see ``first_quotes``).
    """
    keys = list(keys)

    def on_grid(us):
        return us - F.pmod(us, F.lit(grid_us))

    quote_us = micros(F.col("quote_ts"))
    span = quotes.groupBy(*keys).agg(
        on_grid(F.min(quote_us)).alias("_grid_from"), on_grid(F.max(quote_us)).alias("_grid_to")
    )
    order_us = micros(F.col("order_ts"))
    placed = join_on(orders, small_side(span), keys, "left").withColumn(
        "_probe", F.least(on_grid(order_us), F.col("_grid_to"))
    )
    matched = (F.col("_probe") >= F.col("_grid_from")) & (order_us - F.col("_probe") <= tolerance_us)
    order_rows = placed.select(
        *keys,
        F.col("_probe").alias("_us"),
        F.lit(1).alias("_kind"),
        _spread(orders),
        F.struct(*orders.columns, F.coalesce(matched, F.lit(False)).alias("_matched")).alias("_order"),
    )
    quote_rows = quotes.select(
        *keys, quote_us.alias("_us"), F.lit(0).alias("_kind"), F.lit(0).alias("_tie"), F.struct(*values).alias("_quote")
    )
    timeline = quote_rows.unionByName(order_rows, allowMissingColumns=True)
    if groups is None:
        groups = measure_groups(orders.select(*keys).unionByName(quotes.select(*keys)), keys)
    seen = last_known(timeline, keys, ["_us", "_kind", "_tie"], {"_seen": F.col("_quote")}, groups)
    found = seen.where(F.col("_order").isNotNull())
    is_match = F.col("_order._matched")
    return found.select(
        *[F.col(f"_order.{c}").alias(c) for c in orders.columns],
        F.when(is_match, from_micros(F.col("_us"))).alias("quote_ts"),
        *[F.when(is_match, F.col(f"_seen.{v}")).alias(v) for v in values],
    )


def with_latest(
    rows: DataFrame,
    line: DataFrame,
    values: Sequence[str],
    tolerance_us: int,
    keys: Sequence[str] = TICKER_DAY,
    groups: Groups | None = None,
) -> DataFrame:
    """The last row of ``line`` at or before each order, unless older than ``tolerance_us``."""
    keys = list(keys)
    here = rows.select(
        *keys,
        micros(F.col("order_ts")).alias("_us"),
        F.lit(1).alias("_kind"),
        _spread(rows),
        F.struct(*rows.columns).alias("_row"),
    )
    there = line.select(
        *keys,
        micros(F.col("quote_ts")).alias("_us"),
        F.lit(0).alias("_kind"),
        F.lit(0).alias("_tie"),
        F.struct("quote_ts", *values).alias("_point"),
    )
    groups = groups or measure_groups(rows.select(*keys).unionByName(line.select(*keys)), keys)
    timeline = there.unionByName(here, allowMissingColumns=True)
    seen = last_known(timeline, keys, ["_us", "_kind", "_tie"], {"_seen": F.col("_point")}, groups)
    found = seen.where(F.col("_row").isNotNull())
    recent = F.col("_us") - micros(F.col("_seen.quote_ts")) <= tolerance_us
    return found.select(
        *[F.col(f"_row.{c}").alias(c) for c in rows.columns],
        *[F.when(recent, F.col(f"_seen.{v}")).alias(v) for v in ("quote_ts", *values)],
    )
