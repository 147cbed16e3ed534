"""Parquet tables partitioned by trade date, text lists, and writers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.operators.selection import text_list
from tapewatch.schemas import EVENT_STREAM_NAMES, METRICS, PREDICTIONS

# Where feature and label tables may be found below a root, first match wins.
FEATURE_FOLDERS = ("features", "features_select")
LABEL_FOLDERS = ("labels", "labels_select", "labels_enhanced")


def _has_files(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.exists(target) and system.listStatus(target))


def first_folder(spark: SparkSession, root: str, names: Sequence[str]) -> str:
    for name in names:
        path = f"{root.rstrip('/')}/{name}"
        if _has_files(spark, path):
            return path
    raise FileNotFoundError(f"none of {', '.join(names)} below {root}")


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    dates: Sequence[str] = (),
    tickers: Sequence[str] = (),
    columns: Sequence[str] = (),
    schema: T.StructType | None = None,
) -> DataFrame:
    """A table of daily partitions. Dates prune partitions, tickers prune row groups, columns prune the scan.

    Several paths are united by name; columns one of them lacks are null.
    """

    def one(place: str) -> DataFrame:
        reader = spark.read.schema(schema) if schema else spark.read
        frame = reader.parquet(place)
        # a date folder like trade_date=20250303 is read back as a number
        return frame.withColumn("trade_date", F.col("trade_date").cast("string"))

    places = [path] if isinstance(path, str) else list(path)
    frame = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(p) for p in places])
    if dates:
        frame = frame.where(F.col("trade_date").isin(list(dates)))
    if tickers:
        frame = frame.where(F.col("ticker").isin(list(tickers)))
    return frame.select(*columns) if columns else frame


def read_features(spark: SparkSession, root: str, **where) -> DataFrame:
    return read_table(spark, first_folder(spark, root, FEATURE_FOLDERS), **where)


def read_labels(spark: SparkSession, root: str, **where) -> DataFrame:
    return read_table(spark, first_folder(spark, root, LABEL_FOLDERS), **where)


def read_ticker_list(spark: SparkSession, path: str) -> DataFrame:
    return text_list(spark.read.text(path))


def read_predictions(spark: SparkSession, path: str, **where) -> DataFrame:
    return read_table(spark, path, schema=PREDICTIONS, **where)


def _state_folder(path: str, day: str) -> str:
    return f"{path.rstrip('/')}/as_of={day}"


def state_days(spark: SparkSession, path: str) -> list[str]:
    """Days as of which a state is stored, from the folder names; an unfinished one does not count."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/as_of=*/_SUCCESS")
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(status.getPath().getParent().getName().partition("=")[2] for status in found or [])


def read_state(spark: SparkSession, path: str, day: str) -> DataFrame:
    return spark.read.parquet(_state_folder(path, day))


def write_state(df: DataFrame, path: str, day: str, stale: Sequence[str] = ()) -> None:
    """The state as of ``day``; the ``stale`` ones go first, so that none rests on replaced days."""
    spark = df.sparkSession
    for old in stale:
        target = spark._jvm.org.apache.hadoop.fs.Path(_state_folder(path, old))
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    df.write.mode("overwrite").parquet(_state_folder(path, day))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).parquet(path)


def latest_run(metrics: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """The newest evaluation of each method."""
    newest = metrics.groupBy(*by).agg(F.max("run_ts").alias("run_ts"))
    return metrics.join(newest, [*by, "run_ts"], "left_semi")


def latest_values(metrics: DataFrame) -> DataFrame:
    """The newest value of every single metric."""
    return metrics.groupBy("method", "scope", "ticker", "metric").agg(
        F.max_by("value", "run_ts").alias("value"), F.max("run_ts").alias("run_ts")
    )


# ---------------------------------------------------------------- writers

def write_daily(df: DataFrame, path: str, order: Sequence[str] = ("ticker", "order_ts")) -> None:
    """Replace the days present in ``df``; other days stay.

    Rows are brought together by day and ticker, and rebalanced: a dominating ticker-day is split over
    several tasks and small ones share one. Sorted files give tight row-group statistics.
    """
    together = [c for c in ("trade_date", "ticker") if c in df.columns]
    sort = [c for c in order if c in df.columns]
    spread = df.hint("rebalance", *together).sortWithinPartitions("trade_date", *sort)
    (
        spread.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("trade_date")
        .parquet(path)
    )


def write_bucketed(df: DataFrame, path: str, buckets: int, order: Sequence[str] = ("ticker", "order_ts")) -> None:
    """Replace the days present in ``df`` in a table whose days are dealt by ticker into ``buckets`` files each.

    Tables written with the same number of buckets are joined, and their ticker-days ordered, without a shuffle. A ticker
    stands in one file a day, so the number of buckets is chosen for the largest ticker-day, not for the table. The layout
    lies beside the days, so another session finds the table by its path.
    """
    spark = df.sparkSession
    rows = df.select(*[c for c in df.columns if c != "trade_date"], "trade_date")
    sort = [c for c in order if c in df.columns]
    layout = f"{path.rstrip('/')}/_layout"
    if _has_files(spark, layout):
        stored = spark.read.json(layout).first()["buckets"]
        if stored != buckets:
            raise ValueError(f"{path} has {stored} buckets, not {buckets}")
    else:
        described = [(buckets, json.dumps(sort), rows.schema.json())]
        spark.createDataFrame(described, "buckets int, sort string, schema string").coalesce(1).write.json(layout)
    # the rows of a bucket come from one task, as the same hash deals them
    dealt = rows.repartition(buckets, "ticker").sortWithinPartitions("trade_date", *sort)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(_declared(spark, path))


def read_bucketed(spark: SparkSession, path: str, dates: Sequence[str] = ()) -> DataFrame:
    """A table of ``write_bucketed``. From then on the session joins sides that are dealt by some of their join keys as they are."""
    # a ticker's bucket holds all rows of its longer keys
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    frame = spark.table(_declared(spark, path))
    return frame.where(F.col("trade_date").isin(list(dates))) if dates else frame


def _declared(spark: SparkSession, path: str) -> str:
    """The name by which the session's catalogue knows the files below ``path``, declared from their layout if need be."""
    root = path.rstrip("/")
    name = "tapewatch_" + hashlib.md5(root.encode()).hexdigest()
    if not spark.catalog.tableExists(name):
        layout = spark.read.json(f"{root}/_layout").first()
        fields = T.StructType.fromJson(json.loads(layout["schema"])).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        sort = json.loads(layout["sort"])
        ordered = f"SORTED BY ({', '.join(sort)})" if sort else ""
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (trade_date) CLUSTERED BY (ticker) {ordered} INTO {layout['buckets']} BUCKETS LOCATION '{root}'"
        )
    # days that another session wrote
    spark.catalog.recoverPartitions(name)
    return name


def append_metrics(df: DataFrame, path: str) -> None:
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in METRICS.fields]
    df.select(*columns).write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    value: Column = F.col(column).cast("string")
    df.select(value.alias("value")).write.mode("overwrite").text(path)


def export_event_stream_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """The event stream as CSV per day under the exchange's column names."""
    back = {name: source for source, name in EVENT_STREAM_NAMES.items()}
    named = df.withColumn("_day", F.col("trade_date"))
    named = named.select(*[F.col(c).alias(back.get(c, c)) for c in named.columns])
    (
        named.write.mode("overwrite")
        .option("header", True)
        .option("encoding", encoding)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .partitionBy("_day")
        .csv(path)
    )
