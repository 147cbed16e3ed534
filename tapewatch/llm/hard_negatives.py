"""Hard negatives by segment summary filtering.

Each vector is stored with the mean and the deviation of its segments. For two vectors the inner product of a segment lies within
length * (product of means +- product of deviations), so sums over segments bound the score. Pairs whose bounds already
miss what is wanted go; the others are bounded again with shorter segments, and only what is left is scored exactly.

Anchors are a stated set of rows. They are taken in bundles of at most ``BUNDLE_BYTES``, which are broadcast; every task scores its rows
against a bundle block by block, keeps the best per anchor so far, and uses their last score as the next bound. What tasks keep is merged in two steps.
A first pass finds the positives, a second one the negatives between the least and the largest share of each positive's score.

Scores are inner products of the integers floor(scale * x). They are exact while they fit in 64 bits; where a product of doubles might not
be exact, integers are multiplied instead.

Defined cases: rows with a null id, label or vector or with a null or non-finite component take no part; an empty vector, or one shorter than another,
goes on in zeros; rows that share an id are rows of their own as positives or negatives, rows with the anchor's own id
are none of its positives or negatives, and equal anchor rows count once; equal scores go by the smaller id; an anchor without positives, or
with none of a positive score, has no rows; an empty table gives none; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.runtime import best_of_tasks
from tapewatch.session import scratch_path

#: Components of a segment at the last level, and segments of one level that make one of the level before.
LENGTH, FAN = 4, 4
#: Bytes of anchors that are broadcast at a time, and anchors that are scored at a time.
BUNDLE_BYTES, BLOCK = 8 << 20, 512
#: Share of a tile's pairs from which all of its products are computed at once.
DENSE = 0.1
#: Room for rounding in bounds of doubles.
ROOM = 1e-9
POSITIVES, NEGATIVES = 5, 10
#: The shares of the positive's score, in hundredths, between which a negative's score lies.
SHARES = (30, 90)


def usable(vectors: DataFrame, key: str, label: Column, vector: str, scale: int) -> DataFrame:
    """``id``, ``label`` (as text) and the integer ``vector`` of the rows that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector).alias("raw"), sound.alias("sound")
    ).where("id IS NOT NULL AND label IS NOT NULL AND raw IS NOT NULL AND sound")
    return rows.select("id", "label", F.transform("raw", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"))


def matrix(values: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of ``width`` columns, cut or filled with zeros."""
    lengths = pa.compute.list_value_length(values).to_numpy(zero_copy_only=False)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    found = np.zeros((len(lengths), width), flat.dtype)
    if len(lengths) and (lengths == lengths[0]).all():
        own = min(width, int(lengths[0]))
        found[:, :own] = flat.reshape(len(lengths), -1)[:, :own]
        return found
    ends = np.cumsum(lengths)
    for row, (end, size) in enumerate(zip(ends, lengths)):
        own = min(width, size)
        found[row, :own] = flat[end - size : end - size + own]
    return found


def list_array(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.ravel()))


def summarised(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``means`` and ``deviations`` of their shortest segments, written once.

    Vectors are filled with zeros up to whole segments of the first level, which changes no inner product.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                whole = -(-max(int(size), 1) // (LENGTH * FAN)) * LENGTH * FAN
                values = matrix(part.column("vector"), whole).astype(np.int64)
                segments = values.reshape(len(values), -1, LENGTH).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), list_array(values), list_array(segments.mean(axis=2)), list_array(segments.std(axis=2))],
                    ["id", "label", "vector", "means", "deviations"],
                )

    written = scratch_path(rows.sparkSession, "summaries")
    rows.mapInArrow(summaries, "id long, label string, vector array<long>, means array<double>, deviations array<double>").write.parquet(written)
    return rows.sparkSession.read.parquet(written)


class Side:
    """Vectors with their summaries level by level, the longest segments first."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, width: int):
        column = lambda name: batch.column(name).combine_chunks() if isinstance(batch, pa.Table) else batch.column(name)
        self.ids = column("id").to_numpy(zero_copy_only=False)
        self.labels = column("label")
        self.values = matrix(column("vector"), width)
        self.exact = self.values.astype(np.float64)
        self.largest = float(np.abs(self.exact).max(initial=0.0))
        means, spread = (matrix(column(c), width // LENGTH) for c in ("means", "deviations"))
        grouped = means.reshape(len(means), -1, FAN)
        wide = grouped.mean(axis=2)
        wide_spread = np.sqrt(np.maximum(0.0, (spread.reshape(grouped.shape) ** 2 + (grouped - wide[:, :, None]) ** 2).mean(axis=2)))
        self.levels = [(wide, wide_spread, LENGTH * FAN), (means, spread, LENGTH)]

    def part(self, chosen: np.ndarray) -> "Side":
        found = object.__new__(Side)
        found.ids, found.values, found.exact, found.largest = self.ids[chosen], self.values[chosen], self.exact[chosen], self.largest
        found.labels = None
        found.levels = [(m[chosen], s[chosen], n) for m, s, n in self.levels]
        return found


def products(left: np.ndarray, right: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of the chosen pairs."""
    if len(rows) > DENSE * len(left) * len(right):
        return (left @ right.T)[rows, columns]
    found = np.empty(len(rows), np.result_type(left, right))
    step = max(1, (1 << 20) // max(1, left.shape[1]))
    for k in range(0, len(rows), step):
        found[k : k + step] = np.einsum("ij,ij->i", left[rows[k : k + step]], right[columns[k : k + step]])
    return found


def refined(left: Side, right: Side, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and exact scores of the ``wanted`` pairs whose bounds reach into their row's range at every level."""
    rows, columns = np.nonzero(wanted)
    for (means, spread, length), (other_means, other_spread, _) in zip(left.levels, right.levels):
        middle = length * products(means, other_means, rows, columns)
        reach = length * products(spread, other_spread, rows, columns)
        reach += 1 + ROOM * (np.abs(middle) + reach)
        near = (middle + reach >= low[rows]) & (middle - reach <= high[rows])
        rows, columns = rows[near], columns[near]
    if left.largest * right.largest * max(1, left.values.shape[1]) < 2.0**53:
        scores = products(left.exact, right.exact, rows, columns).astype(np.int64)
    else:
        scores = products(left.values, right.values, rows, columns)
    return rows, columns, scores


class Best:
    """The best ``top`` rows of each slot so far: the highest scores, equal ones by the smaller id."""

    def __init__(self, slots: int, top: int):
        self.top = top
        self.slot = self.score = self.id = np.empty(0, np.int64)
        #: What a score must reach to matter.
        self.least = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        fit = score >= self.least[slot]
        slot, score, ids = (np.concatenate([old, new[fit]]) for old, new in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        full = rank == self.top - 1
        self.least[slot[full]] = score[full]
        self.slot, self.score, self.id = (x[rank < self.top] for x in (slot, score, ids))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (self.slot, self.score, self.id)], ["slot", "score", "id"])


def label_places(anchors: Side, tile: Side) -> tuple[np.ndarray, np.ndarray]:
    """The labels of both as places among the anchors' labels, -1 for a label that no anchor has."""
    known = anchors.labels.unique()
    place = lambda labels: pa.compute.fill_null(pa.compute.index_in(labels, value_set=known), -1).to_numpy(zero_copy_only=False)
    return place(anchors.labels), place(tile.labels)


def blocks(size: int) -> Iterator[np.ndarray]:
    for start in range(0, size, BLOCK):
        yield np.arange(start, min(size, start + BLOCK))


SLOTS = "slot long, score long, id long"


def best_positives(rows: DataFrame, anchors: Side, width: int, top: int) -> DataFrame:
    """The best other rows of each anchor's label, task by task; a slot is an anchor's place."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        best = Best(len(anchors.ids), top)
        anywhere = np.full(len(anchors.ids), np.inf)
        for batch in batches:
            tile = Side(batch, width)
            own, others = label_places(anchors, tile)
            for chosen in blocks(len(anchors.ids)):
                wanted = (own[chosen][:, None] == others) & (anchors.ids[chosen][:, None] != tile.ids[None, :])
                r, c, found = refined(anchors.part(chosen), tile, wanted, best.least[chosen].astype(np.float64), anywhere)
                best.add(chosen[r], found, tile.ids[c])
        yield best.batch()

    return best_of_tasks(rows.mapInArrow(score, SLOTS), ["slot"], [F.desc("score"), F.col("id")], top)


def best_negatives(rows: DataFrame, anchors: Side, width: int, low: np.ndarray, high: np.ndarray, top: int) -> DataFrame:
    """For each anchor and positive the best rows of other labels within the range, task by task.

    ``low`` and ``high`` have a row for each anchor and a column for each of its positives; a slot is a place in them.
    """
    shared = rows.sparkSession.sparkContext.broadcast((anchors, low, high))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high = shared.value
        several = low.shape[1]
        best = Best(low.size, top)
        for batch in batches:
            tile = Side(batch, width)
            own, others = label_places(anchors, tile)
            for chosen in blocks(len(anchors.ids)):
                least = np.maximum(low[chosen], best.least.reshape(low.shape)[chosen])
                open_ = high[chosen] >= least
                from_ = np.where(open_, least, np.iinfo(np.int64).max).min(axis=1).astype(np.float64)
                to = np.where(open_, high[chosen], np.iinfo(np.int64).min).max(axis=1).astype(np.float64)
                wanted = (own[chosen][:, None] != others) & (anchors.ids[chosen][:, None] != tile.ids[None, :]) & open_.any(axis=1)[:, None]
                r, c, found = refined(anchors.part(chosen), tile, wanted, from_, to)
                for k in range(several):
                    fits = (found >= least[r, k]) & (found <= high[chosen][r, k])
                    best.add(chosen[r[fits]] * several + k, found[fits], tile.ids[c[fits]])
        yield best.batch()

    return best_of_tasks(rows.mapInArrow(score, SLOTS), ["slot"], [F.desc("score"), F.col("id")], top)


def bundles(anchors: DataFrame) -> Iterator[pa.Table]:
    """Anchors in bundles of bounded size, one at a time; before that only the sizes of hash ranges come to the driver."""
    room = F.size("vector") * 24 + F.octet_length("label") + 64
    total = anchors.agg(F.sum(room).alias("size")).first()["size"] or 0
    parts = int(2 * total // BUNDLE_BYTES) + 1
    dealt = anchors.withColumn("part", F.pmod(F.xxhash64("vector", "id"), F.lit(parts)).cast("int"))
    ends, number, held = {}, 0, 0
    for part, size in dealt.groupBy("part").agg(F.sum(room).alias("size")).orderBy("part").collect():
        if held and held + size > BUNDLE_BYTES:
            number, held = number + 1, 0
        held += size
        ends[part] = number
    for _, chosen in groupby(sorted(ends.items(), key=lambda e: (e[1], e[0])), key=lambda e: e[1]):
        yield dealt.where(F.col("part").isin([part for part, _ in chosen])).drop("part").toArrow()


def range_of(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest score of a negative of a positive with ``score``; empty for scores below 0."""
    # hundreds and rest apart: the whole product might not fit in 64 bits
    hundreds, rest = score // 100, score % 100
    return SHARES[0] * hundreds - (-SHARES[0] * rest // 100), SHARES[1] * hundreds + SHARES[1] * rest // 100


def mine(vectors: DataFrame, chosen: Column, key: str = "vec_id", label: Column | str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """For each anchor (a row for which ``chosen`` holds) and each of its positives the hardest negatives within the range.

    ``chosen`` is an expression over ``id``. The rows are ``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score``, ``negative_score``.
    """
    spark = vectors.sparkSession
    rows = summarised(usable(vectors, key, F.col(label) if isinstance(label, str) else label, vector, scale))
    result = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for table in bundles(rows.where(chosen).distinct()):
        width = LENGTH * FAN * max(1, max(-(-len(v) // (LENGTH * FAN)) for v in table.column("vector")))
        anchors = Side(table, width)
        found = best_positives(rows, anchors, width, POSITIVES).select("slot", "rank", "id", "score").toArrow()
        slot, rank, ids, score = (found.column(c).to_numpy() for c in ("slot", "rank", "id", "score"))
        low, high = np.ones((len(anchors.ids), POSITIVES), np.int64), np.zeros((len(anchors.ids), POSITIVES), np.int64)
        low[slot, rank - 1], high[slot, rank - 1] = range_of(score)
        best = best_negatives(rows, anchors, width, low, high, NEGATIVES)
        # as many names as the bundle has places
        places = pa.table({"slot": slot * POSITIVES + rank - 1, "anchor_id": anchors.ids[slot], "positive_id": ids, "positive_score": score})
        named = best.join(F.broadcast(spark.createDataFrame(places)), "slot")
        result = result.unionByName(
            named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        )
    return result
