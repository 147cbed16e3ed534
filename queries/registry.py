"""Collects query functions and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.bindings import CTES
from tapewatch.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the binding CTEs by name."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        run.family = build.__module__.rpartition(".")[2]
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = f"WITH {CTES} {sql.strip()}"
        return build

    return register


def r(col: Column | str, digits: int = 6) -> Column:
    """A double rounded half away from zero in binary, as DuckDB rounds, without a negative zero."""
    value = (F.col(col) if isinstance(col, str) else col).cast("double")
    steps = F.floor(F.abs(value) * F.lit(10.0**digits) + 0.5).cast("double") / F.lit(10.0**digits)
    return F.when(value < 0, -steps).otherwise(steps) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded for comparison."""
    return df.select(*[r(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
