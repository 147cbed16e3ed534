"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.session import staged

#: Edges that a task puts together at a time.
HELD_EDGES = 1_000_000


def groups_of(rows: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each row's group, for links between rows."""
    low = np.arange(n)
    while True:
        before = low.copy()
        both = np.minimum(low[rows], low[other])
        np.minimum.at(low, rows, both)
        np.minimum.at(low, other, both)
        low = low[low]
        if np.array_equal(low, before):
            return low


def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For the edges of a task stars that connect the same nodes, ``a`` to the smaller ``b``."""

    def stars_of(held: list[pd.DataFrame]) -> pd.DataFrame:
        edges = pd.concat(held, ignore_index=True)
        nodes, at = np.unique(edges[["a", "b"]].to_numpy(np.int64).T.ravel(), return_inverse=True)
        low = groups_of(at[: len(edges)], at[len(edges) :], len(nodes))
        member = low != np.arange(len(low))
        return pd.DataFrame({"a": nodes[member], "b": nodes[low[member]]})

    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= HELD_EDGES:
            held = [stars_of(held)]
            if 2 * len(held[0]) >= HELD_EDGES:
                yield held.pop()
    if held:
        yield stars_of(held)


def all_stars(edges: DataFrame) -> bool:
    """Whether every node that hangs on another one, ``a`` on ``b``, has no further edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("end"))
    edges_of = ends.groupBy("end.node").agg(F.count(F.lit(1)).alias("edges"), F.max("end.up").alias("up"))
    return edges_of.where("up = 1 AND edges > 1").isEmpty()


def roots_of(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def connected(edges: DataFrame) -> DataFrame:
    """For the edges ``a``, ``b`` (longs) every node that is not the smallest of its component, with the smallest.

    Each task first makes stars of its own edges; where all are in one task that is the result. Fewer than ``HELD_EDGES`` that are left in
    several tasks are put together in one, as a task holds that many anyway. More take large-star and small-star steps in turn: nodes hang
    themselves on the smallest neighbour until every component is a star; the number of rounds grows with the logarithm of the size. The smallest neighbour is an aggregate with partial sums joined back, so a node with very many neighbours needs no task
    of its own.
    Self-loops and repeated edges do no harm; no edges give no rows. Gives ``node`` and ``root``.
    """
    lower, upper = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    current = staged(edges.where("a <> b").select(upper, lower).distinct().mapInPandas(forests, "a long, b long"))
    if current.rdd.getNumPartitions() > 1 and current.count() < HELD_EDGES:
        return roots_of(staged(current.coalesce(1).mapInPandas(forests, "a long, b long")))
    while not all_stars(current):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        # large star: every larger neighbour goes to the smallest one
        large = current.select(F.col("b").alias("n"), F.col("a").alias("v")).join(smallest.withColumnRenamed("a", "n"), "n")
        large = large.select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()
        # small star: smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(least, "a")
        small = joined.select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        current = staged(small.where("a <> b").distinct())
    return roots_of(current)
