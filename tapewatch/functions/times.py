"""Timestamps, time of day and trading sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def clock(hour: int, minute: int = 0, second: int = 0) -> int:
    """Microseconds of day."""
    return hour * HOUR + minute * MINUTE + second * SECOND


# Session boundaries of the exchange and the length of one trading day's cycle.
AUCTION_OPEN = clock(9, 15)
AUCTION_LATE = clock(9, 25)
MORNING_OPEN = clock(9, 30)
MORNING_OPENING_END = clock(10, 0)
MORNING_CLOSE = clock(11, 30)
AFTERNOON_OPEN = clock(13, 0)
AFTERNOON_OPENING_END = clock(13, 15)
LATE_SESSION = clock(14, 45)
AFTERNOON_CLOSE = clock(14, 57)
MARKET_CLOSE = clock(15, 0)
TRADING_CYCLE_SECONDS = 16200.0

# Names of the periods of a trading day.
PERIODS = (
    "early_auction",
    "late_auction",
    "morning_opening",
    "morning_trading",
    "lunch_break",
    "afternoon_opening",
    "afternoon_trading",
    "closing",
    "outside_hours",
)
OPENING_PERIODS = ("morning_opening", "afternoon_opening")
ABNORMAL_PERIODS = ("late_auction", "lunch_break", "outside_hours")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def micros_of_day(ts: Column) -> Column:
    return F.pmod(micros(ts), F.lit(DAY))


def _left_padded(text: Column, width: int) -> Column:
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def tick_time(date: Column, time: Column) -> Column:
    """Exchange date and HHMMSS+fraction text as a timestamp; null when either is malformed.

    Both texts may have lost leading zeros. Written as one parse of one text: a filter on the result
    is evaluated on the text again, so the expression has to stay small.
    """
    padded = _left_padded(time, 9)
    spelled = F.concat(_left_padded(date, 8), F.lit(" "), F.rpad(padded, F.greatest(F.lit(12), F.length(time)), F.lit("0")))
    return F.try_to_timestamp(spelled, F.lit("yyyyMMdd HHmmssSSSSSS")).cast("timestamp_ntz")


def text_time(text: Column) -> Column:
    """ISO-like timestamp text (as found in exported event streams); null when malformed."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def in_trading_hours(ts: Column) -> Column:
    """In a continuous session. The time of day is bound once, as a lambda's argument: in a filter over a
    parsed time, four comparisons would mean four parses."""
    return F.exists(
        F.array(micros_of_day(ts)),
        lambda tod: tod.between(MORNING_OPEN, MORNING_CLOSE) | tod.between(AFTERNOON_OPEN, AFTERNOON_CLOSE),
    )


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def session_columns(ts: Column) -> dict[str, Column]:
    """Auction and session flags, seconds from the open, and its place on the daily cycle."""
    tod = micros_of_day(ts)
    seconds = (tod - F.lit(MORNING_OPEN)) / F.lit(float(SECOND))
    angle = F.lit(2.0) * F.pi() * seconds / F.lit(TRADING_CYCLE_SECONDS)
    auction = ((tod >= AUCTION_OPEN) & (tod < MORNING_OPEN)) | tod.between(AFTERNOON_CLOSE, MARKET_CLOSE)
    return {
        "in_auction": flag(auction),
        "in_morning": flag(tod.between(MORNING_OPEN, MORNING_CLOSE)),
        "in_afternoon": flag(tod.between(AFTERNOON_OPEN, AFTERNOON_CLOSE)),
        "seconds_since_market_open": seconds,
        "time_sin": F.sin(angle),
        "time_cos": F.cos(angle),
    }


def in_opening(ts: Column) -> Column:
    tod = micros_of_day(ts)
    return tod.between(MORNING_OPEN, MORNING_OPENING_END) | tod.between(AFTERNOON_OPEN, AFTERNOON_OPENING_END)


def in_volatile_period(ts: Column) -> Column:
    tod = micros_of_day(ts)
    return ((tod >= AUCTION_LATE) & (tod < MORNING_OPEN)) | ((tod >= MORNING_CLOSE) & (tod < AFTERNOON_OPEN))


def trading_period(ts: Column) -> Column:
    """Name of the part of the trading day; null for a missing time."""
    tod = micros_of_day(ts)
    return (
        F.when(tod.isNull(), F.lit(None).cast("string"))
        .when((tod >= AUCTION_OPEN) & (tod < AUCTION_LATE), PERIODS[0])
        .when((tod >= AUCTION_LATE) & (tod < MORNING_OPEN), PERIODS[1])
        .when(tod.between(MORNING_OPEN, MORNING_OPENING_END), PERIODS[2])
        .when((tod > MORNING_OPENING_END) & (tod < MORNING_CLOSE), PERIODS[3])
        .when((tod >= MORNING_CLOSE) & (tod < AFTERNOON_OPEN), PERIODS[4])
        .when(tod.between(AFTERNOON_OPEN, AFTERNOON_OPENING_END), PERIODS[5])
        .when((tod > AFTERNOON_OPENING_END) & (tod < LATE_SESSION), PERIODS[6])
        .when(tod.between(LATE_SESSION, MARKET_CLOSE), PERIODS[7])
        .otherwise(PERIODS[8])
    )
