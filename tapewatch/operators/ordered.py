"""Ordered and grouped building blocks that hold up when one group owns a large share of all rows.

A Spark window keeps a whole group in one task. Groups are therefore counted first (one aggregate
with map-side combining). While every group is small, the plain window is the best plan. Groups above
the limit take a second way: rows are range-partitioned on (group, order), so a large group covers
many tasks, each task works on its own stretch, and what earlier stretches contribute is carried in a
table with at most one row per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.session import staged

# Rows of one group that a single task may order by itself.
GROUP_ROWS = 2_000_000
# Rows a side may have to be broadcast.
BROADCAST_ROWS = 500_000


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, mark: str = "_on") -> DataFrame:
    """Join on keys where null equals null, keeping the left side's key columns."""
    renamed = right.withColumnsRenamed({k: f"{mark}_{k}" for k in keys})
    condition = null_safe(left, renamed, [(k, f"{mark}_{k}") for k in keys])
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"{mark}_{k}" for k in keys])


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Stage a lookup table and mark it for broadcast when its counted size allows."""
    table = staged(df)
    return F.broadcast(table) if table.count() <= limit else table


@dataclass
class Groups:
    """Which groups of a table are too large for one task."""

    keys: list[str]
    limit: int = GROUP_ROWS
    large: DataFrame | None = field(default=None)

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows of ordinary groups, and rows of large groups (None when there are none)."""
        if self.large is None:
            return df, None
        return join_on(df, self.large, self.keys, "left_anti"), join_on(df, self.large, self.keys, "left_semi")

    def each(
        self, df: DataFrame, plain: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]
    ) -> DataFrame:
        usual, big = self.split(df)
        done = plain(usual)
        return done if big is None else done.unionByName(large(big))


def measure_groups(
    df: DataFrame, keys: Sequence[str], limit: int | None = None, rows: str | None = None
) -> Groups:
    """Count rows per group and note the large ones; one small action.

    ``rows`` names a column with (an upper bound of) row numbers to add up instead of counting, for
    when they are known without reading the table. The limit is the session's ``tapewatch.groupRows``
    unless given and the same for tables of any size; many large groups are marked by a shuffled join.
    """
    keys = list(keys)
    limit = limit or int(df.sparkSession.conf.get("tapewatch.groupRows", str(GROUP_ROWS)))
    counts = df.groupBy(*keys).agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("_rows"))
    biggest = counts.agg(F.max("_rows")).first()[0]
    if (biggest or 0) <= limit:
        return Groups(keys, limit)
    return Groups(keys, limit, small_side(counts.where(F.col("_rows") > limit).select(*keys)))


def _stretches(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, bool]:
    """Range-partition on (keys, order) and fix each row's stretch number.

    Partition bounds come from a sample, so the numbered rows are written once; every later branch
    then sees the same stretches, also after an executor is lost.
    """
    cut = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    table = staged(cut.withColumn("_stretch", F.spark_partition_id()))
    return table, table.rdd.getNumPartitions() > 1


def _earlier(keys: Sequence[str]):
    return (
        Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        if keys
        else Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    )


def _with_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str], marker: str) -> DataFrame:
    """Attach what earlier stretches contribute. Only a stretch that continues a group needs a row,
    and a task holds at most one such stretch: the table has fewer rows than there are tasks."""
    return join_on(rows, F.broadcast(carry.where(F.col(marker).isNotNull())), [*keys, "_stretch"], "left")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums within each group; ``order`` must be unique within a group.

    ``totals`` maps further columns to the name of the sum whose group total they hold.
    """
    totals = totals or {}
    parts = {f"_part_{name}": value for name, value in sums.items()}
    rows, split = _stretches(df.withColumns(parts), keys, order)
    ordered = Window.partitionBy("_stretch", *keys).orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({name: F.sum(f"_part_{name}").over(so_far) for name in sums})
    if not split:
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.withColumns({t: F.sum(f"_part_{name}").over(whole) for t, name in totals.items()})
    else:
        per_stretch = rows.groupBy(*keys, "_stretch").agg(
            F.count(F.lit(1)).alias("_seen"), *[F.sum(p).alias(p) for p in parts]
        )
        before = _earlier(keys)
        carry = per_stretch.select(
            *keys,
            "_stretch",
            F.sum("_seen").over(before).alias("_carried"),
            *[F.sum(f"_part_{name}").over(before).alias(f"_from_{name}") for name in sums],
        )
        out = _with_carry(out, carry, keys, "_carried")
        out = out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_from_{n}"), F.lit(0)) for n in sums})
        if totals:
            whole = per_stretch.groupBy(*keys).agg(*[F.sum(f"_part_{n}").alias(t) for t, n in totals.items()])
            out = join_on(out, small_side(whole), keys, "inner")
    return out.select(*df.columns, *sums, *totals)


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], groups: Groups | None = None
) -> DataFrame:
    """Latest non-null value up to and including each row, within its group (ascending order)."""
    groups = groups or measure_groups(df, keys)
    ordering = [F.col(c) for c in order]

    def filled(frame: DataFrame, partition: Sequence[str]) -> DataFrame:
        up_to_now = (
            Window.partitionBy(*partition)
            .orderBy(*ordering)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return frame.withColumns({n: F.last(v, ignorenulls=True).over(up_to_now) for n, v in values.items()})

    def large(frame: DataFrame) -> DataFrame:
        rows, split = _stretches(frame, keys, ordering)
        out = filled(rows, ["_stretch", *keys])
        if split:
            place = [F.col(c) for c in order]
            newest = rows.groupBy(*keys, "_stretch").agg(
                *[
                    F.max(F.when(v.isNotNull(), F.struct(*place, v.alias("_value")))).alias(f"_from_{n}")
                    for n, v in values.items()
                ]
            )
            before = _earlier(keys)
            carry = newest.select(
                *keys,
                "_stretch",
                F.count(F.lit(1)).over(before).alias("_continues"),
                *[F.last(F.col(f"_from_{n}._value"), ignorenulls=True).over(before).alias(f"_from_{n}") for n in values],
            ).withColumn("_carried", F.expr("nullif(_continues, 0)"))
            out = _with_carry(out, carry, keys, "_carried")
            out = out.withColumns({n: F.coalesce(n, F.col(f"_from_{n}")) for n in values})
        return out.select(*df.columns, *values)

    return groups.each(df, lambda frame: filled(frame, keys).select(*df.columns, *values), large)


def with_lookback(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_back: int,
    apply: Callable[[DataFrame, list[str]], DataFrame],
    groups: Groups | None = None,
) -> DataFrame:
    """Run windows that reach back at most ``rows_back`` rows.

    ``apply(frame, partition)`` adds columns by windows over ``partition``. A large group is cut
    into blocks of equally many rows by exact position; the last rows of a block are repeated at the
    head of the next one and dropped afterwards.
    """
    groups = groups or measure_groups(df, keys)
    block_rows = max(groups.limit, rows_back + 1)

    def large(frame: DataFrame) -> DataFrame:
        placed = running_totals(frame, keys, [F.col(c) for c in order], {"_place": F.lit(1)})
        block = F.floor((F.col("_place") - 1) / block_rows)
        near_end = F.pmod(F.col("_place") - 1, F.lit(block_rows)) >= block_rows - rows_back
        copies = placed.withColumn("_home", block).withColumn(
            "_block",
            F.explode(F.when(near_end, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home"))),
        )
        done = apply(copies, [*keys, "_block"]).where(F.col("_block") == F.col("_home"))
        return done.drop("_place", "_home", "_block")

    return groups.each(df, lambda frame: apply(frame, list(keys)), large)


def earlier_moments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, Column], groups: Groups | None = None
) -> DataFrame:
    """Mean and sample deviation of the non-null values in all earlier rows of the group.

    Adds ``<name>_mean`` and ``<name>_std`` per entry (null without enough earlier values).
    """
    groups = groups or measure_groups(df, keys)
    ordering = [F.col(c) for c in order]
    added = [f"{n}_{s}" for n in columns for s in ("mean", "std")]

    def earlier_rows(partition: Sequence[str]):
        return Window.partitionBy(*partition).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1)

    def plain(frame: DataFrame) -> DataFrame:
        window = earlier_rows(keys)
        stats = {}
        for name, value in columns.items():
            stats[f"{name}_mean"] = F.avg(value).over(window)
            stats[f"{name}_std"] = F.stddev_samp(value).over(window)
        return frame.withColumns(stats).select(*df.columns, *added)

    def large(frame: DataFrame) -> DataFrame:
        values = {f"_value_{n}": v for n, v in columns.items()}
        rows, split = _stretches(frame.withColumns(values), keys, ordering)
        window = earlier_rows(["_stretch", *keys])
        local = {}
        for name in columns:
            value = F.col(f"_value_{name}")
            local[f"_n_{name}"] = F.count(value).over(window)
            local[f"_avg_{name}"] = F.coalesce(F.avg(value).over(window), F.lit(0.0))
            local[f"_sq_{name}"] = F.coalesce(F.var_pop(value).over(window) * F.count(value).over(window), F.lit(0.0))
        out = rows.withColumns(local)
        if split:
            out = _with_carry(out, _moment_carry(rows, keys, columns), keys, "_carried")
        else:
            zero = {f"_{p}0_{n}": F.lit(0.0) for n in columns for p in ("n", "avg", "sq")}
            out = out.withColumns(zero)
        merged = {}
        for name in columns:
            n0, a0, s0 = (F.coalesce(F.col(f"_{p}0_{name}"), F.lit(0.0)) for p in ("n", "avg", "sq"))
            n1, a1, s1 = (F.col(f"_{p}_{name}") for p in ("n", "avg", "sq"))
            n, shift = n0 + n1, a1 - a0
            merged[f"{name}_mean"] = F.when(n > 0, a0 + F.try_divide(shift * n1, n))
            spread = s0 + s1 + F.try_divide(shift * shift * n0 * n1, n)
            merged[f"{name}_std"] = F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1)))
        return out.withColumns(merged).select(*df.columns, *added)

    return groups.each(df, plain, large)


def _moment_carry(rows: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """Count, mean and squared deviation of all earlier stretches, centred on the group mean."""
    per_stretch = rows.groupBy(*keys, "_stretch").agg(
        *[
            f.alias(f"_{p}_{n}")
            for n in columns
            for p, f in (
                ("n", F.count(f"_value_{n}").cast("double")),
                ("avg", F.avg(f"_value_{n}")),
                ("sq", F.var_pop(f"_value_{n}") * F.count(f"_value_{n}")),
            )
        ]
    )
    whole = Window.partitionBy(*keys)
    before = _earlier(keys)
    centred = per_stretch
    for n in columns:
        count, avg = F.col(f"_n_{n}"), F.col(f"_avg_{n}")
        centred = centred.withColumn(
            f"_centre_{n}", F.try_divide(F.sum(count * avg).over(whole), F.sum(count).over(whole))
        )
    out = [*keys, "_stretch", F.expr("nullif(_continues, 0)").alias("_carried")]
    sums = {"_continues": F.count(F.lit(1)).over(before)}
    for n in columns:
        count, off = F.col(f"_n_{n}"), F.col(f"_avg_{n}") - F.col(f"_centre_{n}")
        sums[f"_n0_{n}"] = F.sum(count).over(before)
        sums[f"_off_{n}"] = F.sum(count * off).over(before)
        sums[f"_raw_{n}"] = F.sum(F.col(f"_sq_{n}") + count * off * off).over(before)
        mean_off = F.try_divide(F.col(f"_off_{n}"), F.col(f"_n0_{n}"))
        out += [
            F.col(f"_n0_{n}"),
            (F.col(f"_centre_{n}") + mean_off).alias(f"_avg0_{n}"),
            F.greatest(F.lit(0.0), F.col(f"_raw_{n}") - F.col(f"_off_{n}") * mean_off).alias(f"_sq0_{n}"),
        ]
    return centred.withColumns(sums).select(*out)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], few: bool = False) -> DataFrame:
    """One row per key, the first by ``order`` and then by the remaining columns; the result does not depend on row order.

    Without ``few`` it is a minimum over structs: combined on the map side, so a key with any number of rows is
    reduced before the shuffle. Where a key cannot have more than a task's share of rows, ``few`` is cheaper: rows are dealt and
    sorted by key once, the first is the one without a row of its key before it, and a join by the
    same keys goes on from that order without another shuffle or sort.
    """
    rest = [c for c in df.columns if c not in keys]
    if few:
        ordered = Window.partitionBy(*keys).orderBy(*order, *rest)
        marked = df.withColumn("_before", F.lag(F.lit(True)).over(ordered))
        return marked.where(F.col("_before").isNull()).select(*df.columns)
    first = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("_first")
    chosen = df.groupBy(*keys).agg(first)
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


# Rank error of the first look at a distribution, as a share of its rows.
SKETCH_ERROR = 1e-4


def _edges(value: Column, probabilities: Sequence[float], slack: float) -> Column:
    """For each probability two values that enclose its quantile, told from a mergeable sketch; (low, high) pairs."""
    asked = sorted({max(0.0, p - slack) for p in probabilities} | {min(1.0, p + slack) for p in probabilities})
    sketch = F.percentile_approx(value, asked, int(1 / SKETCH_ERROR))

    def at(p: float) -> Column:
        return F.min(value) if p <= 0 else F.max(value) if p >= 1 else F.get(sketch, F.lit(asked.index(p)))

    return F.array(*[F.struct(at(max(0.0, p - slack)).alias("low"), at(min(1.0, p + slack)).alias("high")) for p in probabilities])


def _bracketed(value: Column, edges: Sequence[tuple[Column, Column]]) -> tuple[Column, Column]:
    """A value if it lies between a pair of edges, and how many pairs lie below it."""
    inside = reduce(lambda a, b: a | b, [(value >= low) & (value <= high) for low, high in edges])
    return F.when(inside, value), reduce(lambda a, b: a + b, [(value > high).cast("int") for _, high in edges])


def _picked(counted: DataFrame, keys: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """Quantiles read off bracketed values and the sizes of the stretches between them; null where a bracket missed."""
    table = staged(counted)
    if table.count() <= GROUP_ROWS:
        in_order = Window.partitionBy(*keys).orderBy("_at")
        upto = F.sum("_times").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sized = table.withColumns({"_upto": upto, "_size": F.sum("_times").over(Window.partitionBy(*keys))})
    else:
        sized = running_totals(table, keys, [F.col("_at")], {"_upto": F.col("_times")}, {"_size": "_upto"})
    picks = []
    for name, p in probabilities.items():
        spot = (F.col("_size") - 1) * F.lit(p)

        def at(index: Column) -> Column:
            return F.max(F.when((F.col("_upto") - F.col("_times") <= index) & (index < F.col("_upto")), F.col("_inside")))

        picks += [at(F.floor(spot)).alias(f"_low_{name}"), at(F.ceil(spot)).alias(f"_high_{name}"), F.max(spot - F.floor(spot)).alias(f"_between_{name}")]
    found = sized.groupBy(*keys).agg(*picks)
    between = {n: F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_between_{n}") for n in probabilities}
    return found.select(*keys, *[value.alias(n) for n, value in between.items()])


def _until_found(attempt: Callable[[float], DataFrame], probabilities: dict[str, float]) -> DataFrame:
    """Widen the brackets in the unlikely case that a sketch was further off than it promises; the widest hold everything."""
    slack = 2 * SKETCH_ERROR
    while True:
        found = staged(attempt(slack))
        if slack >= 1 or found.where(" OR ".join(f"`{n}` IS NULL" for n in probabilities)).isEmpty():
            return found
        slack *= 16


def quantiles_of_columns(df: DataFrame, columns: Sequence[str], probabilities: dict[str, float], name: str = "feature") -> DataFrame:
    """Exact quantiles with linear interpolation of several columns: one row for each column that holds a value.

    One pass brackets the quantiles of all columns by sketches, a second one counts what lies between the brackets and sorts only what
    lies inside them: a few values in ten thousand, equal ones counted as one.
    """
    values = {c: F.col(c).cast("double") for c in columns}

    def attempt(slack: float) -> DataFrame:
        # as many rows on the driver as there are columns and probabilities
        looked = df.agg(*[_edges(v, list(probabilities.values()), slack).alias(f"_{k}") for k, v in enumerate(values.values())]).first()
        cells = []
        for k, (c, v) in enumerate(values.items()):
            edges = [(F.lit(e["low"]), F.lit(e["high"])) for e in looked[f"_{k}"] if e["low"] is not None]
            if edges:
                inside, region = _bracketed(v, edges)
                cells.append(F.struct(F.lit(c).alias(name), v.alias("_value"), inside.alias("_inside"), region.alias("_region")))
        if not cells:
            schema = ", ".join([f"{name} string", *[f"`{n}` double" for n in probabilities]])
            return df.sparkSession.createDataFrame([], schema)
        tall = df.select(F.explode(F.array(*cells)).alias("_cell")).select("_cell.*").where("_value IS NOT NULL")
        counted = tall.groupBy(name, "_inside", "_region").agg(F.count(F.lit(1)).alias("_times"), F.min("_value").alias("_at"))
        return _picked(counted, [name], probabilities)

    return _until_found(attempt, probabilities)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], groups: Groups | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation per group; columns named by ``probabilities``.

    No table is sorted by value. An ordinary group's values are counted in one task; of a large group only those inside
    narrow brackets around the quantiles are told apart (``quantiles_of_columns``).
    """
    if not keys:
        return quantiles_of_columns(df, [value], probabilities, "_of").drop("_of")
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"))
    names = list(probabilities)

    def plain(frame: DataFrame) -> DataFrame:
        counted = frame.groupBy(*keys).agg(F.percentile("_value", list(probabilities.values())).alias("_q"))
        return counted.select(*keys, *[F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(names)])

    def large(frame: DataFrame) -> DataFrame:
        def attempt(slack: float) -> DataFrame:
            edges = frame.groupBy(*keys).agg(_edges(F.col("_value"), list(probabilities.values()), slack).alias("_edges"))
            rows = join_on(frame, small_side(edges), keys, "inner")
            pairs = [(F.col("_edges")[k]["low"], F.col("_edges")[k]["high"]) for k in range(len(names))]
            inside, region = _bracketed(F.col("_value"), pairs)
            counted = rows.groupBy(*keys, inside.alias("_inside"), region.alias("_region")).agg(
                F.count(F.lit(1)).alias("_times"), F.min("_value").alias("_at")
            )
            return _picked(counted, keys, probabilities)

        return _until_found(attempt, probabilities)

    groups = groups or measure_groups(known, keys)
    return groups.each(known, plain, large)
