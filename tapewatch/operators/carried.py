"""History features of a ticker from one ordered pass, with a carry in place of the rows before.

What the rows before a stretch contribute is small: moments of the values that are averaged, the last rows as
far as a window reaches, and the last known price. The same carry serves two cuts. A large group is dealt to
several tasks, and each stretch gets the carry of the stretches before it. And a day's run gets the carry of
all days before it from a stored table, so a new day costs as much as its own rows, however long the history.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions.numbers import ratio
from tapewatch.operators.history import HISTORY_ORDER
from tapewatch.operators.ordered import Groups, _stretches, measure_groups
from tapewatch.session import staged

#: Output, source column and rows of each trailing deviation, the current row included.
DEVIATIONS = {"price_volatility": ("mid_price", 100), "spread_volatility": ("spread", 50)}
#: Output and source column of each mean over all earlier rows.
MEANS = {"hist_order_size_mean": "log_qty", "hist_spread_mean": "spread"}
#: Rows over which the price change is taken, gaps filled forward.
MOMENTUM_ROWS = 5
FEATURES = (*DEVIATIONS, "price_momentum", *MEANS)
TAIL_ROWS = max(rows for _, rows in DEVIATIONS.values())
_TAIL = ("mid_price", "spread")
_BEFORE_ALL = -1


def state_columns(keys: Sequence[str]) -> list[str]:
    return [*keys, *[f"{part}_{name}" for name in MEANS.values() for part in ("n", "sum", "sq")], "tail"]


def _summaries(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Moments and last rows of every group, one row each."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = dict.fromkeys([*_TAIL, *MEANS.values()])
    placed = rows.select(
        *keys, *sources,
        F.row_number().over(ordered).alias("_place"),
        F.count(F.lit(1)).over(whole).alias("_size"),
        F.last("mid_price", ignorenulls=True).over(upto).alias("known"),
    )
    last = F.when(F.col("_size") - F.col("_place") < TAIL_ROWS, F.struct("_place", *_TAIL, "known"))
    moments = [
        part.alias(f"{name}_{source}")
        for source in MEANS.values()
        for name, part in (
            ("n", F.count(source).cast("double")),
            ("sum", F.coalesce(F.sum(source), F.lit(0.0))),
            ("sq", F.coalesce(F.var_pop(source) * F.count(source), F.lit(0.0))),
        )
    ]
    found = placed.groupBy(*keys).agg(*moments, F.array_sort(F.collect_list(last)).alias("tail"))
    bare = F.transform("tail", lambda row: F.struct(*[row[c].alias(c) for c in (*_TAIL, "known")]))
    return found.withColumn("tail", bare)


def _folded(parts: DataFrame, keys: Sequence[str], inclusive: bool) -> DataFrame:
    """For every part of a group what all parts before it hold together, or what they hold with it."""
    in_order = Window.partitionBy(*keys).orderBy("_stretch")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    end = 0 if inclusive else -1
    until = in_order.rowsBetween(Window.unboundedPreceding, end)
    whole = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a part without a known price goes on with the one before it
    before = F.last(F.element_at("tail", -1)["known"], ignorenulls=True).over(earlier)
    parts = parts.withColumn("_before", before)
    filled = F.transform("tail", lambda row: F.struct(*[row[c].alias(c) for c in _TAIL], F.coalesce(row["known"], F.col("_before")).alias("known")))
    parts = parts.withColumn("tail", filled)
    centres = {f"_centre_{s}": F.coalesce(F.try_divide(F.sum(f"sum_{s}").over(whole), F.sum(f"n_{s}").over(whole)), F.lit(0.0)) for s in MEANS.values()}
    parts = parts.withColumns(centres)
    # every part has a row at least, so as many parts as rows are enough
    tails = F.flatten(F.collect_list("tail").over(in_order.rowsBetween(end + 1 - TAIL_ROWS, end)))
    out: dict[str, Column] = {"tail": F.slice(tails, F.greatest(F.lit(1), F.size(tails) - (TAIL_ROWS - 1)), TAIL_ROWS)}
    for s in MEANS.values():
        # squares around one centre add up; they are moved to the mean of what is folded
        n, total = F.col(f"n_{s}"), F.col(f"sum_{s}")
        off = total - n * F.col(f"_centre_{s}")
        count, shift = F.coalesce(F.sum(n).over(until), F.lit(0.0)), F.coalesce(F.sum(off).over(until), F.lit(0.0))
        around = F.coalesce(F.sum(F.col(f"sq_{s}") + F.coalesce(F.try_divide(off * off, n), F.lit(0.0))).over(until), F.lit(0.0))
        out[f"n_{s}"] = count
        out[f"sum_{s}"] = F.coalesce(F.sum(total).over(until), F.lit(0.0))
        out[f"sq_{s}"] = F.greatest(F.lit(0.0), around - F.coalesce(F.try_divide(shift * shift, count), F.lit(0.0)))
    return parts.select(*keys, "_stretch", *[value.alias(name) for name, value in out.items()], F.max("_stretch").over(whole).alias("_last"))


class History:
    """History features of ``df`` by ``keys``, continuing from ``state`` where there is one.

    ``state`` is what ``state()`` of the run before gave; it holds one row per group. All rows of ``df`` come
    after those that the state stands for.
    """

    def __init__(
        self, df: DataFrame, keys: Sequence[str], state: DataFrame | None = None, order: Sequence[str] = HISTORY_ORDER, groups: Groups | None = None
    ):
        self.keys, self.order, self.before, self.columns = list(keys), list(order), state, df.columns
        groups = groups or measure_groups(df, self.keys)
        usual, large = groups.split(df)
        self.rows = usual.withColumn("_stretch", F.lit(0))
        self.split = False
        if large is not None:
            cut, self.split = _stretches(large, self.keys, [F.col(c) for c in self.order])
            self.rows = self.rows.unionByName(cut)

    @cached_property
    def parts(self) -> DataFrame:
        """One row for each stretch of each group, and the state ahead of them; written once."""
        found = _summaries(self.rows, [*self.keys, "_stretch"], self.order)
        if self.before is not None:
            found = found.unionByName(self.before.select(*state_columns(self.keys)).withColumn("_stretch", F.lit(_BEFORE_ALL)))
        return staged(found)

    def state(self) -> DataFrame:
        """What this run's rows and all before them leave for the next run."""
        return _folded(self.parts, self.keys, inclusive=True).where("_stretch = _last").select(*state_columns(self.keys))

    def features(self) -> DataFrame:
        """``df`` with ``FEATURES``."""
        group = [*self.keys, "_stretch"]
        rows = self.rows.withColumn("_lead", F.lit(0))
        if self.split or self.before is not None:
            carry = _folded(self.parts, self.keys, inclusive=False).where(F.col("_stretch") != _BEFORE_ALL)
            moments = F.struct(*[F.col(f"{p}_{s}").alias(f"{p}_{s}") for s in MEANS.values() for p in ("n", "sum")])
            ahead = carry.select(*group, moments.alias("_carry"), F.posexplode("tail").alias("_at", "_row"))
            ahead = ahead.select(*group, "_carry", (F.col("_at") - TAIL_ROWS).alias("_lead"), *[F.col(f"_row.{c}").alias(c) for c in _TAIL], F.col("_row.known").alias("_known"))
            rows = rows.unionByName(ahead, allowMissingColumns=True)
        else:
            empty = ", ".join(f"{p}_{s}: double" for s in MEANS.values() for p in ("n", "sum"))
            rows = rows.withColumns({"_carry": F.lit(None).cast(f"struct<{empty}>"), "_known": F.lit(None).cast("double")})
        ordered = Window.partitionBy(*group).orderBy("_lead", *self.order)
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
        own = F.col("_lead") == 0
        added = {out: F.stddev_samp(source).over(ordered.rowsBetween(1 - size, 0)) for out, (source, size) in DEVIATIONS.items()}
        added["_carry"] = F.first("_carry", ignorenulls=True).over(upto)
        added["_mid"] = F.last(F.coalesce(F.when(own, F.col("mid_price")), F.col("_known")), ignorenulls=True).over(upto)
        for source in MEANS.values():
            value = F.when(own, F.col(source))
            added[f"_n_{source}"] = F.count(value).over(earlier)
            added[f"_sum_{source}"] = F.sum(value).over(earlier)
        seen = rows.withColumns(added)
        done = {"price_momentum": ratio(F.col("_mid"), F.lag("_mid", MOMENTUM_ROWS).over(ordered)) - 1}
        for out, source in MEANS.items():
            n, total = (F.coalesce(F.col(f"_carry.{p}_{source}"), F.lit(0.0)) + F.coalesce(F.col(f"_{p}_{source}"), F.lit(0.0)) for p in ("n", "sum"))
            done[out] = F.try_divide(total, n)
        return seen.withColumns(done).where(own).select(*self.columns, *FEATURES)
