"""Keep label and feature tables up to date with an event-stream table that grows by days.

The stages are batch operators over whole days. A stream over the table's new files only decides
which days to run them on; the days themselves are read as a table, so windows see complete days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapewatch.plans import stages
from tapewatch.schemas import EVENT_STREAM
from tapewatch.session import configure
from tapewatch.sources import tables


def follow_days(
    spark: SparkSession, stream_path: str, state_path: str, refresh: Callable[[list[str]], None]
) -> StreamingQuery:
    """Call ``refresh(dates)`` with the days that received new files since the last run, then stop.

    A day is rewritten as a whole, so a batch repeated after a failure changes nothing.
    """
    configure(spark)
    arriving = spark.readStream.schema(EVENT_STREAM).parquet(stream_path).select(F.col("trade_date").cast("string"))

    def each(batch: DataFrame, _: int) -> None:
        # at most one row per calendar day
        dates = [r["trade_date"] for r in batch.distinct().collect()]
        if dates:
            refresh(sorted(dates))

    writer = arriving.writeStream.foreachBatch(each).option("checkpointLocation", state_path)
    return writer.trigger(availableNow=True).start()


def follow_labels(spark: SparkSession, stream_path: str, out: str, state_path: str, **options) -> StreamingQuery:
    def refresh(dates: list[str]) -> None:
        stream = tables.read_table(spark, stream_path, dates=dates)
        tables.write_daily(stages.labels(stream, **options), out)

    return follow_days(spark, stream_path, state_path, refresh)


def follow_features(spark: SparkSession, stream_path: str, out: str, state_path: str, **options) -> StreamingQuery:
    def refresh(dates: list[str]) -> None:
        stream = tables.read_table(spark, stream_path, dates=dates)
        tables.write_daily(stages.features(stream, **options), out)

    return follow_days(spark, stream_path, state_path, refresh)
