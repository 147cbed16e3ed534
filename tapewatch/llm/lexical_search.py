"""Ranked lexical search: the best documents for each item, without an index of the documents.

All distinct terms of the items go into one Aho-Corasick automaton, each between two guards. A document's text is
folded so that every run of delimiters ends in a guard; one pass of the automaton over it then counts the item terms, and
only these, so no document term is ever sorted, shuffled or stored. The counts, a few integers a document, are
written once; statistics of the corpus are sums over them, and a second pass maps terms to items, adds the integer scores
and keeps the best rows of each task. Those are merged in two steps, so no task meets the rows of all others.

Items are dealt into blocks of at most ``BLOCK_BYTES`` of text; what is broadcast at a time is the automaton of one block.
One item larger than that is a block of its own.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are folded. With N documents that
hold a term, L terms in all, n terms in the document, and tf and df of a term: w = floor(1000 ln((2N+2)/(2df+1))),
m = 75 + (25 n N) div L, score = sum of w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms with repeats.

Defined cases: a null or empty text has no term, is no document of N and has no score, and an item without a term has no
rows; repeated document rows are documents of their own; items equal in id and text count once, items that share an id and
differ in text are ranked one by one, each with ranks of its own; null ids are ids like any other, the last
among equal scores; an empty table on either side gives no rows; further columns are left out; texts of any length are
scanned whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.runtime import best_of_tasks, text_of
from tapewatch.session import staged

#: Rows returned for each item.
TOP = 20
#: Bytes of item text whose automaton is broadcast at a time.
BLOCK_BYTES = 4 << 20
#: Scores, and terms found times their items, that are held at a time.
TILE = 1 << 20
GUARD = " "


def _folding() -> bytes:
    """Byte table: A-Z become a-z, every other ASCII byte that is no letter or digit becomes the guard."""
    table = bytearray(range(256))
    for byte in range(128):
        char = chr(byte)
        table[byte] = ord(char.lower() if char.isalnum() else GUARD)
    return bytes(table)


_FOLDED = _folding()


def folded(text: str) -> bytes:
    """The text with one guard at least before and after each term; bytes beyond ASCII stay."""
    return b" %b " % text.encode().translate(_FOLDED)


def terms_of(text: str) -> list[str]:
    """The terms, each byte as one character."""
    return folded(text).decode("latin-1").split(GUARD)


class Items:
    """The terms of a block of items, and how often each item has each of them."""

    def __init__(self, texts: list[str]):
        # workers outlive a search: what they keep goes by a name of its own
        self.name = uuid.uuid4().hex
        self.terms: dict[str, int] = {}
        counts: list[dict[int, int]] = []
        for text in texts:
            own: dict[int, int] = {}
            for term in filter(None, terms_of(text)):
                known = self.terms.setdefault(term, len(self.terms))
                own[known] = own.get(known, 0) + 1
            counts.append(own)
        # by term: the items that have it and how often
        triples = sorted((term, item, n) for item, own in enumerate(counts) for term, n in own.items())
        self.size = len(texts)
        self.item = np.array([t[1] for t in triples], np.int64)
        self.times = np.array([t[2] for t in triples], np.int64)
        self.bounds = np.searchsorted(np.array([t[0] for t in triples], np.int64), np.arange(len(self.terms) + 1))

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, k in self.terms.items():
            found.add_word(f"{GUARD}{term}{GUARD}", k)
        found.make_automaton()
        return found


#: The automaton that this worker has built last, by the name of its items.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def automaton_of(items: Items) -> ahocorasick.Automaton:
    if items.name not in _BUILT:
        _BUILT.clear()
        _BUILT[items.name] = items.automaton()
    return _BUILT[items.name]


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.empty(0, np.int64)]), kind))


def scan(docs: DataFrame, items: Items, key: str, text: str) -> DataFrame:
    """Per document with a term: ``id``, ``n`` terms in all, and the item terms found with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("body"))
    kind = rows.schema["id"].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton_of(shared.value) if shared.value.terms else None
        for batch in batches:
            kept, sizes, terms, times = [], [], [], []
            for row, body in enumerate(batch.column("body")):
                bare = folded(body.as_py())
                n = len(bare.split())
                if not n:
                    continue
                hits = np.fromiter((k for _, k in find.iter(bare.decode("latin-1"))), np.int64) if find else np.empty(0, np.int64)
                found, often = np.unique(hits, return_counts=True)
                kept.append(row)
                sizes.append(n)
                terms.append(found)
                times.append(often)
            ids = batch.column("id").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), lists(terms, pa.int32()), lists(times, pa.int64())], ["id", "n", "terms", "times"])

    return rows.mapInArrow(count, f"id {kind.simpleString()}, n long, terms array<int>, times array<long>")


def weights(found: DataFrame, n_docs: int, size: int) -> np.ndarray:
    """The weight of each term of a block; a block's terms are bounded, whatever the corpus holds."""
    df = np.zeros(size, np.int64)
    for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = n
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def best_of(scores: np.ndarray, places: np.ndarray, top: int) -> np.ndarray:
    """Of one item's scores the ``top`` highest above 0, equal ones by place."""
    found = np.flatnonzero(scores > 0)
    if len(found) > top:
        least = np.partition(scores[found], len(found) - top)[len(found) - top]
        found = found[scores[found] >= least]
    return found[np.lexsort((places[found], -scores[found]))][:top]


def score_batch(items: Items, weight: np.ndarray, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, times: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Scores by item and document of a batch; all of them are 64-bit integers."""
    m = 75 + (25 * n * n_docs) // n_terms
    row = np.repeat(np.arange(len(n)), lengths)
    value = weight[terms] * ((1_000_000_000 * times) // (1000 * times + 12 * m[row]))
    # each term found goes to all items that have it
    first, fan = items.bounds[terms], items.bounds[terms + 1] - items.bounds[terms]
    source = np.repeat(np.arange(len(terms)), fan)
    entry = np.arange(len(source)) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(first, fan)
    scores = np.zeros(items.size * len(n), np.int64)
    np.add.at(scores, items.item[entry] * len(n) + row[source], value[source] * items.times[entry])
    return scores.reshape(items.size, len(n))


def best_rows(found: DataFrame, items: Items, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """The ``top`` documents of each item in each task: ``item`` (place in the block), ``id``, ``score``."""
    shared = found.sparkSession.sparkContext.broadcast((items, weight))
    kind = found.schema["id"].dataType.simpleString()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        for whole in batches:
            for start, stop in tiles(whole, items):
                held.append(best_in(whole.slice(start, stop - start), items, weight))
                if len(held) == 16:
                    held = [merged(held)]
        if held:
            ids, item, score = merged(held)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(score, pa.int64())], ["item", "id", "score"])

    def tiles(batch: pa.RecordBatch, items: Items) -> Iterator[tuple[int, int]]:
        """Ranges of rows that are scored together; a single row takes no more than the block's items have terms."""
        lengths = pa.compute.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
        terms = batch.column("terms").flatten().to_numpy()
        fans = np.concatenate([[0], np.cumsum(items.bounds[terms + 1] - items.bounds[terms])])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        load = fans[ends] + items.size * np.arange(len(ends))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(load, load[start] + TILE, side="right")) - 1)
            yield start, stop
            start = stop

    def merged(held):
        """The best of what earlier batches left; items by items."""
        ids = pa.concat_arrays([h[0] for h in held])
        item, score = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        place = places_of(ids)
        order = np.lexsort((place, -score, item))
        sorted_items = item[order]
        rank_in = np.arange(len(order)) - np.searchsorted(sorted_items, sorted_items)
        keep = order[rank_in < top]
        return ids.take(pa.array(keep)), item[keep], score[keep]

    def places_of(ids: pa.Array) -> np.ndarray:
        """Where each id stands among all in ascending order, null last."""
        return np.argsort(pa.compute.array_sort_indices(ids).to_numpy(), kind="stable")

    def best_in(batch: pa.RecordBatch, items: Items, weight: np.ndarray):
        ids, n, terms, times = (batch.column(c) for c in ("id", "n", "terms", "times"))
        lengths = pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False)
        scores = score_batch(items, weight, n.to_numpy(), lengths, terms.flatten().to_numpy(), times.flatten().to_numpy(), n_docs, n_terms)
        place = places_of(ids)
        best = [best_of(own, place, top) for own in scores]
        item = np.repeat(np.arange(items.size), list(map(len, best)))
        row = np.concatenate([*best, np.empty(0, np.int64)])
        return ids.take(pa.array(row)), item, scores[item, row]

    return found.mapInArrow(rank, f"item int, id {kind}, score long")


def blocks_of(items: DataFrame) -> Iterator[list[tuple]]:
    """Items in blocks of bounded text, one block at a time, as ``(id, text)`` rows.

    Only the sizes of hash ranges come to the driver before: at most a few for each block.
    """
    total = items.agg(F.sum(F.octet_length("body")).alias("size")).first()["size"] or 0
    parts = int(2 * total // BLOCK_BYTES) + 1
    dealt = items.withColumn("part", F.pmod(F.xxhash64("body"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("part").agg(F.sum(F.octet_length("body")).alias("size")).orderBy("part").collect()
    ends, block, held = {}, 0, 0
    for part, size in sizes:
        if held and held + size > BLOCK_BYTES:
            block, held = block + 1, 0
        held += size
        ends[part] = block
    for _, chosen in groupby(sorted(ends.items(), key=lambda e: (e[1], e[0])), key=lambda e: e[1]):
        yield dealt.where(F.col("part").isin([part for part, _ in chosen])).select("id", "body").collect()


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """For each item its ``top`` documents: ``item``, ``rank`` from 1, ``key``, ``score``."""
    spark = docs.sparkSession
    wanted = items.select(F.col(item).alias("id"), text_of(item_text).alias("body")).distinct()
    kinds = f"item_name {items.schema[item].dataType.simpleString()}, rank int, id {docs.schema[key].dataType.simpleString()}, score long"
    results = []
    for rows in blocks_of(wanted):
        own = Items([row["body"] for row in rows])
        found = staged(scan(docs, own, key, text))
        # terms that no item has count too: n is of the whole text
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        best = best_rows(found, own, weights(found, n_docs, len(own.terms)), n_docs, n_terms, top)
        best = best_of_tasks(best, ["item"], [F.desc("score"), F.col("id").asc_nulls_last()], top)
        names = spark.createDataFrame([(k, row["id"]) for k, row in enumerate(rows)], f"item int, item_name {items.schema[item].dataType.simpleString()}")
        # names are of one block, so bounded like it
        results.append(best.join(F.broadcast(names), "item").select("item_name", "rank", "id", "score"))
    merged = spark.createDataFrame([], kinds)
    for part in results:
        merged = merged.unionByName(part)
    return merged.select(F.col("item_name").alias(item), "rank", F.col("id").alias(key), "score")
