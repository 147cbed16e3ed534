"""Counts over the time just before each order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions.numbers import ratio, zero_if_null
from tapewatch.functions.times import SECOND, flag, micros
from tapewatch.operators.ordered import Groups, measure_groups, running_totals
from tapewatch.schemas import TICKER_DAY
from tapewatch.session import staged

# The look-back windows, in microseconds.
WINDOWS = {"100ms": SECOND // 10, "1s": SECOND, "5s": 5 * SECOND}


def rolling_sums(
    df: DataFrame,
    keys: Sequence[str],
    clock: str,
    amounts: dict[str, Column],
    windows: dict[str, int],
    groups: Groups | None = None,
) -> DataFrame:
    """Sums of whole-number ``amounts`` over rows with clock in [t - w, t).

    A window sum is the total before t minus the total before t - w. Both are growing frames over
    one sort, so the cost does not depend on how many rows a window holds. Rows need no identity of
    their own: repeated ones are counted and answered one by one. Columns are named ``<amount>_<window>``.
    """
    keys = list(keys)
    groups = groups or measure_groups(df, keys)
    names = [f"{a}_{w}" for a in amounts for w in windows]

    def plain(frame: DataFrame) -> DataFrame:
        by_clock = Window.partitionBy(*keys).orderBy(clock)

        def total_before(amount: Column, back: int) -> Column:
            return F.coalesce(F.sum(amount).over(by_clock.rangeBetween(Window.unboundedPreceding, -back - 1)), F.lit(0))

        totals = frame.withColumns(
            {
                f"_{a}_{w}": total_before(value, back)
                for a, value in amounts.items()
                for w, back in {"now": 0, **windows}.items()
            }
        )
        sums = {f"{a}_{w}": F.col(f"_{a}_now") - F.col(f"_{a}_{w}") for a in amounts for w in windows}
        return totals.withColumns(sums).select(*df.columns, *names)

    def large(frame: DataFrame) -> DataFrame:
        # marks of a row: itself, and a probe at t and at each t - w; a probe precedes rows of its instant
        marks = F.array(
            F.struct(F.lit("self").alias("mark"), F.col(clock).alias("at"), F.lit(1).alias("turn")),
            *[
                F.struct(F.lit(w).alias("mark"), (F.col(clock) - back).alias("at"), F.lit(0).alias("turn"))
                for w, back in {"now": 0, **windows}.items()
            ],
        )
        parts = {f"_amount_{a}": value for a, value in amounts.items()}
        # numbered once and written, so that marks find their way back to the row they came from
        frame = staged(frame.withColumn("_mark_row", F.monotonically_increasing_id()))
        line = (
            frame.withColumns(parts)
            .select(*keys, "_mark_row", *parts, F.explode(marks).alias("_m"))
            .select(*keys, "_mark_row", *parts, "_m.*")
        )
        adds = {f"_sum_{a}": F.when(F.col("mark") == "self", F.col(f"_amount_{a}")).otherwise(0) for a in amounts}
        order = [F.col("at"), F.col("turn"), F.col("_mark_row"), F.col("mark")]
        totals = running_totals(line, keys, order, adds).where(F.col("mark") != "self")

        def total(a: str, w: str) -> Column:
            return F.max(F.when(F.col("mark") == w, F.coalesce(f"_sum_{a}", F.lit(0))))

        read = totals.groupBy("_mark_row").agg(
            *[(total(a, "now") - total(a, w)).alias(f"{a}_{w}") for a in amounts for w in windows]
        )
        return frame.join(read, "_mark_row").select(*df.columns, *names)

    return groups.each(df, plain, large)


def order_counts(
    df: DataFrame,
    windows: dict[str, int] | None = None,
    keys: Sequence[str] = TICKER_DAY,
    groups: Groups | None = None,
    clock: str | None = None,
) -> DataFrame:
    """Orders placed shortly before each order: ``orders_<window>``.

    ``keys`` is the ticker-day by default; ``["trade_date"]`` counts across all tickers of a day.
    ``clock`` names a column with the order time in microseconds, if there is one.
    """
    windows = windows or {w: WINDOWS[w] for w in ("100ms", "1s")}
    timed = df if clock else df.withColumn("_us", micros(F.col("order_ts")))
    counted = rolling_sums(timed, keys, clock or "_us", {"orders": F.lit(1)}, windows, groups)
    return counted if clock else counted.drop("_us")


def history_counts(
    df: DataFrame,
    windows: dict[str, int] | None = None,
    keys: Sequence[str] = TICKER_DAY,
    event_time: str = "event",
    groups: Groups | None = None,
) -> DataFrame:
    """Orders, cancels and trades before each order, and the cancel ratio, per window.

    With ``event_time="event"`` a cancel or trade counts from the moment it happened, so nothing
    later than the order is used; ``"order"`` dates it by its order's arrival.
    """
    windows = windows or WINDOWS
    keys = list(keys)
    is_cancel, is_trade = flag(F.col("event_type") == "cancel"), flag(F.col("event_type") == "trade")
    arrival_us, event_us = micros(F.col("order_ts")), micros(F.col("event_ts"))
    flagged = df.withColumns({"past_cancel_flag": is_cancel, "past_trade_flag": is_trade})

    if event_time == "order":
        line = flagged.withColumn("_us", arrival_us)
        amounts = {
            "orders": F.lit(1),
            "cancels": F.col("past_cancel_flag"),
            "trades": F.col("past_trade_flag"),
        }
        counted = rolling_sums(line, keys, "_us", amounts, windows, groups)
    else:
        # an order stands on the line twice, when it arrives and when its event happens; both come from one scan, where the
        # table lies, and only the first carries the row
        whole = F.struct(*[F.col(c) for c in flagged.columns if c not in keys])
        blank = F.lit(None).cast(flagged.select(whole.alias("w")).schema["w"].dataType)
        arrived = F.struct(arrival_us.alias("_us"), F.lit(1).alias("_arrival"), F.lit(0).alias("_cancel"), F.lit(0).alias("_trade"), whole.alias("_row"))
        happened = F.struct(event_us.alias("_us"), F.lit(0).alias("_arrival"), F.col("past_cancel_flag").alias("_cancel"), F.col("past_trade_flag").alias("_trade"), blank.alias("_row"))
        marks = F.when(F.col("event_ts").isNotNull(), F.array(arrived, happened)).otherwise(F.array(arrived))
        line = flagged.select(*keys, F.explode(marks).alias("_mark")).select(*keys, "_mark.*")
        amounts = {
            "orders": F.col("_arrival"),
            "cancels": F.col("_cancel"),
            "trades": F.col("_trade"),
        }
        counted = rolling_sums(line, keys, "_us", amounts, windows, groups).where("_arrival = 1")
        sums = [f"{a}_{w}" for a in amounts for w in windows]
        counted = counted.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in flagged.columns], *sums, "_us", "_arrival")
    ratios = {
        f"cancel_ratio_{w}": zero_if_null(ratio(F.col(f"cancels_{w}"), F.col(f"orders_{w}") + 1e-8)) for w in windows
    }
    return counted.withColumns(ratios).drop("_us", "_arrival")
