"""Near copies by an exact similarity join of word shingles.

A text is the set of the hashes of its shingles of ``SIZE`` words; two texts are near copies if their sets have a
Jaccard similarity of at least ``PERCENT``. Equal sets are one node. Sets are put in one order, rare shingles first:
of two sets that are similar enough the smaller one's index prefix (a ninth of it) and the larger one's prefix
(a fifth) share a shingle, so every set is filed under the shingles of its prefix and no similar pair is missed.
Lengths, the places of the shared shingle and bit signatures of the whole sets leave out pairs that cannot be
similar; all others are compared by their whole sets.

Filings are packed into records of 24 bytes and dealt by shingle once; only shingles filed by several nodes go on.
In each group of sets with one shingle and like sizes all are offered the smallest set first, and every node is compared with the one it is
offered most often. In large groups those outside the largest component are then offered its most typical member and, a few times, others of it. So a
large group of near copies is joined by links that grow with the group, not with its square. At last all pairs of
one group are compared whose members are not in one component yet.

Rarity comes from counts over ``2 ** TABLE_BITS`` hash classes, of the shingles of all texts: a table of a fixed size,
read as one byte a class. Any order would give the same result.

Defined cases: words are those of the fingerprints, and a text with fewer than ``SIZE`` is one shingle; null, empty and
blank texts have the empty set and are equal; sets below ``LEAST_SIZE`` are similar to their equals only; rows that share key and
text are one; a null key is a key like any other, never the smallest; an empty table gives an empty result; a text
of any length is compared whole; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.components import connected
from tapewatch.llm.runtime import text_of
from tapewatch.llm.simhash import SEED, shingle_hashes
from tapewatch.operators.ordered import join_on, small_side
from tapewatch.session import scratch_path, staged

SIZE, PERCENT = 5, 80
TABLE_BITS = 22
#: Cells of the table that are summed together.
CHUNK_BITS = 16
#: Bits of a signature.
SIGNATURE = 1024
#: Smaller sets are similar to their equals only.
LEAST_SIZE = next(n for n in range(1, 200) if 100 * n >= PERCENT * (n + 1))
#: Filings that a task groups at a time, and bytes of them that a task holds back before it hands them on.
FILINGS, HELD_BYTES = 1_000_000, 16 << 20
#: Filings under one shingle from which a group is large, and times that its nodes are offered another partner.
LARGE, OFFERS = 64, 8
RECORD = np.dtype([("hash", "<i8"), ("id", "<i8"), ("size", "<i4"), ("at", "<i4")])


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` from compressed files in the shared folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of a text in order."""
    return np.unique(shingle_hashes(text, SIZE).view(np.int64))


def cells(hashes: np.ndarray) -> np.ndarray:
    return hashes & ((1 << TABLE_BITS) - 1)


def rarity_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """For each hash class of shingles a byte that grows with the number of texts that hold one."""
    chunk = 1 << min(CHUNK_BITS, TABLE_BITS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << TABLE_BITS, np.uint32)
        for batch in batches:
            for body in batch["body"]:
                np.add.at(table, cells(shingle_set(body)), 1)
        for k, part in enumerate(table.reshape(-1, chunk)):
            if part.any():
                # as few bytes a count as the largest needs
                yield pd.DataFrame({"chunk": [k], "counts": [part.astype(np.min_scalar_type(part.max())).tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch["chunk"], batch["counts"]):
                part = np.frombuffer(counts, f"u{len(counts) // chunk}")
                sums[k] = sums.get(k, 0) + part.astype(np.uint64)
        for k, part in sums.items():
            yield pd.DataFrame({"chunk": [k], "counts": [np.floor(4 * np.log2(1.0 + part)).clip(0, 255).astype(np.uint8).tobytes()]})

    counted = docs.select(text_of(text).alias("body")).mapInPandas(count, "chunk int, counts binary")
    table = np.zeros(1 << TABLE_BITS, np.uint8)
    # as many rows as the table has chunks
    for row in counted.repartition("chunk").mapInPandas(add, "chunk int, counts binary").collect():
        table[row["chunk"] * chunk : (row["chunk"] + 1) * chunk] = np.frombuffer(row["counts"], np.uint8)
    return table


def prefix_size(size):
    """Of a set, how many of its first shingles it is filed under."""
    return size + PERCENT * size // -100 + 1


def index_size(size):
    """How many of them a set needs against sets that are no smaller."""
    return size + 2 * PERCENT * size // -(100 + PERCENT) + 1


def signature_of(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(SIGNATURE, np.uint8)
    bits[(hashes >> TABLE_BITS) & (SIGNATURE - 1)] = 1
    return np.packbits(bits).view("<i8")


def described(docs: DataFrame, key: str, digest: str, text: str) -> DataFrame:
    """``key``, ``digest``, the node ``id``, ``size``, ``signature`` and ``prefix`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity_table(docs, text))

    @F.pandas_udf("struct<id: long, size: int, signature: array<long>, prefix: array<long>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        ids, sizes, signatures, prefixes = [], [], [], []
        for body in texts:
            own = shingle_set(body)
            ids.append(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))
            sizes.append(len(own))
            signatures.append(signature_of(own))
            # hashes are in order, which a stable sort by rarity keeps
            ordered = own[np.argsort(shared.value[cells(own)], kind="stable")]
            prefixes.append(ordered[: prefix_size(len(own)) if len(own) >= LEAST_SIZE else 0])
        return pd.DataFrame({"id": np.array(ids, np.int64), "size": np.array(sizes, np.int32), "signature": signatures, "prefix": prefixes})

    found = docs.select(F.col(key).alias("key"), F.col(digest).alias("digest"), of(text_of(text)).alias("d"))
    return written(found.select("key", "digest", "d.*"), "near-copies")


def filed(nodes: DataFrame) -> DataFrame:
    """All filings as packed records, dealt by shingle: ``part`` and ``data``."""
    total = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = int(total // FILINGS) + 1

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def handed() -> pd.DataFrame:
            records = np.concatenate(held)
            part = (records["hash"].view(np.uint64) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            records, part = records[order], part[order]
            own, starts = np.unique(part, return_index=True)
            return pd.DataFrame({"part": own, "data": [r.tobytes() for r in np.split(records, starts[1:])]})

        for batch in batches:
            lengths = batch["prefix"].map(len).to_numpy(np.int64)
            records = np.empty(lengths.sum(), RECORD)
            if len(records):
                records["hash"] = np.concatenate(batch["prefix"].to_list())
                records["id"], records["size"] = np.repeat(batch["id"].to_numpy(), lengths), np.repeat(batch["size"].to_numpy(), lengths)
                records["at"] = np.arange(len(records)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                held.append(records)
            if sum(r.nbytes for r in held) >= HELD_BYTES:
                yield handed()
                held = []
        if held:
            yield handed()

    packed = nodes.select("id", "size", "prefix").mapInPandas(pack, "part int, data binary")
    return packed.repartition(parts, "part").sortWithinPartitions("part")


def may_match(size_a, at_a, size_b, at_b):
    """Whether lengths and the places of a shared shingle leave room for the overlap."""
    overlap = np.minimum(size_a - at_a, size_b - at_b) + np.minimum(at_a, at_b)
    lengths = 100 * np.minimum(size_a, size_b) >= PERCENT * np.maximum(size_a, size_b)
    return lengths & ((100 + PERCENT) * overlap >= PERCENT * (size_a + size_b))


SHARED = "hash long, id long, size int, at int, many int, first long, open boolean"


def shared_filings(records: np.ndarray) -> pd.DataFrame:
    """The filings of shingles that several nodes share, each with the smallest set of like size that is indexed under
    it, and whether the two may be similar."""
    records = records[np.lexsort((records["id"], records["size"], records["hash"]))]
    hashes = records["hash"]
    group = np.cumsum(np.r_[False, hashes[1:] != hashes[:-1]])
    many = np.bincount(group, minlength=1)[group] if len(records) else group
    records, many = records[many > 1], many[many > 1]
    sizes, at = records["size"].astype(np.int64), records["at"].astype(np.int64)
    band = np.floor(np.log(np.maximum(sizes, 1)) / np.log(100 / PERCENT)).astype(np.int64)
    new = np.r_[True, (records["hash"][1:] != records["hash"][:-1]) | (band[1:] != band[:-1])][: len(records)]
    own = np.cumsum(new) - 1
    # the first indexed filing of each group, or none
    indexed = np.flatnonzero(at < index_size(sizes))
    hub = np.full(len(own) and own[-1] + 1, -1)
    hub[own[indexed[::-1]]] = indexed[::-1]
    first = hub[own]
    first = np.where(first < 0, np.arange(len(records)), first)
    return pd.DataFrame({
        "hash": records["hash"], "id": records["id"], "size": records["size"], "at": records["at"], "many": many, "first": records["id"][first],
        "open": (records["id"][first] != records["id"]) & may_match(sizes, at, sizes[first], at[first]),
    })


def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shared filings of one part after the other."""
    held, now = [], None
    for batch in batches:
        for part, data in zip(batch["part"], batch["data"]):
            if held and part != now:
                yield shared_filings(np.concatenate(held))
                held = []
            now = part
            held.append(np.frombuffer(data, RECORD))
    if held:
        yield shared_filings(np.concatenate(held))


def room_of(a: str, b: str) -> Column:
    """Whether the filings ``a``, of the smaller set, and ``b`` leave room for the overlap."""
    size_a, size_b, at_a, at_b = F.col(f"{a}.size"), F.col(f"{b}.size"), F.col(f"{a}.at"), F.col(f"{b}.at")
    overlap = F.least(size_a - at_a, size_b - at_b) + F.least(at_a, at_b)
    return (100 * size_a >= PERCENT * size_b) & ((100 + PERCENT) * overlap >= PERCENT * (size_a + size_b))


def signatures_meet(a: str, b: str) -> Column:
    """Whether two signatures leave room: a bit that only one set has stands for a shingle only it has."""
    apart = F.aggregate(F.zip_with(f"{a}.signature", f"{b}.signature", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, m: n + m)
    sizes = F.col(f"{a}.size") + F.col(f"{b}.size")
    return apart <= sizes - 2 * F.ceil(PERCENT * sizes / (100 + PERCENT))


def open_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose signatures leave room."""
    of = lambda name: nodes.select(F.col("id").alias(name), F.struct("size", "signature").alias(f"_{name}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(signatures_meet("_a", "_b")).select("a", "b")


def met_apart(rooted: DataFrame, signed: bool) -> DataFrame:
    """Pairs ``a``, ``b`` of different components that share a shingle and leave room; ``signed`` rows have signatures, which must meet too."""
    mine = rooted.where(F.col("at") < F.col("size") + F.floor(2 * PERCENT * F.col("size") / -(100 + PERCENT)) + 1)
    x, y = mine.alias("x"), rooted.alias("y")
    later = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.id") < F.col("y.id")))
    fit = (F.col("x.hash") == F.col("y.hash")) & (F.col("x.root") != F.col("y.root")) & later & room_of("x", "y")
    met = x.join(y, fit & signatures_meet("x", "y") if signed else fit)
    return met.select(F.col("y.id").alias("a"), F.col("x.id").alias("b"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets are similar enough."""
    mine = sets.select(F.col("id").alias("a"), F.col("hashes").alias("mine"))
    theirs = sets.select(F.col("id").alias("b"), F.col("hashes").alias("theirs"))
    both = pairs.join(mine, "a").join(theirs, "b")
    shared = F.size(F.array_intersect("mine", "theirs"))
    return both.where((100 + PERCENT) * shared >= PERCENT * (F.size("mine") + F.size("theirs"))).select("a", "b")


def sets_of(docs: DataFrame, places: DataFrame, text: str = "text") -> DataFrame:
    """``id`` and ``hashes`` of the rows of ``docs`` that ``places`` names by the remaining columns."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t) for t in texts])

    keys = [c for c in places.columns if c != "id"]
    return join_on(docs.select(*keys, text_of(text).alias("_body")), small_side(places), keys, "inner").select("id", of("_body").alias("hashes"))


def stars(links: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` of every node to the root of its component: as many as nodes at most, whatever the number of ``links``."""
    return connected(links).select(F.col("node").alias("a"), F.col("root").alias("b"))


def with_roots(rows: DataFrame, near: DataFrame) -> DataFrame:
    """``rows`` of nodes ``id`` with the ``root`` that ``near`` links them to."""
    found = near.select(F.col("a").alias("id"), F.col("b").alias("_root"))
    return rows.join(found, "id", "left").select(*rows.columns, F.coalesce("_root", "id").alias("root"))


def offered_again(shared: DataFrame, near: DataFrame, tried: DataFrame, links: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Further links within large groups: their nodes are offered members of the largest component of their group.

    ``near`` links the nodes of a component to its root. A node that shares many shingles with others is typical and offered first, later ones come in the
    order of a hash. Each round compares a node with one other at most; rounds end when few find a partner. Gives the links to the roots that
    follow and all pairs that were compared.
    """
    large = shared.where(F.col("many") >= LARGE).drop("first", "open")
    typical = shared.groupBy("id").agg(F.count(F.lit(1)).alias("typical"))
    band = F.floor(F.ln(F.greatest("size", F.lit(1))) / F.ln(F.lit(100 / PERCENT)))
    large = written(large.join(typical, "id").withColumn("band", band), "large-groups")
    for k in range(OFFERS):
        rooted = with_roots(large, near)
        members = rooted.groupBy("root").agg(F.count_distinct("id").alias("members"))
        rooted = rooted.join(members, "root")
        rank = F.struct("members", F.col("typical") if k == 0 else F.xxhash64("id", F.lit(k)), "id")
        hub = rooted.groupBy("hash", "band").agg(F.max_by(F.struct("id", "root", "size", "at"), rank).alias("hub"))
        met = rooted.withColumnRenamed("id", "own").join(hub, ["hash", "band"]).where(F.col("root") != F.col("hub.root"))
        overlap = F.least(F.col("size") - F.col("at"), F.col("hub.size") - F.col("hub.at")) + F.least(F.col("at"), F.col("hub.at"))
        met = met.where((100 + PERCENT) * overlap >= PERCENT * (F.col("size") + F.col("hub.size")))
        counted = met.select(F.col("own").alias("a"), F.col("hub.id").alias("b")).join(tried, ["a", "b"], "left_anti").groupBy("a", "b").count()
        best = staged(counted.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b")))
        n_best = best.count()
        if not n_best:
            break
        more = links(best)
        tried = tried.unionByName(best)
        n_more = more.count()
        if n_more:
            near = stars(near.unionByName(more))
        if 20 * n_more < n_best:
            break
    return near, tried


def near_copies(docs: DataFrame, key: str = "doc_id", digest: str = "_digest", text: str = "text", linked: DataFrame | None = None) -> DataFrame:
    """``key``, ``digest`` and ``root`` of every row; ``digest`` tells rows with one key apart.

    ``linked`` names pairs ``a``, ``b`` of digests that are known to be similar; they are not compared again.
    """
    rows = described(docs, key, digest, text)
    first = F.min(F.struct(F.col("key").isNull().alias("unknown"), "key", "digest")).alias("first")
    whole = [F.first(c).alias(c) for c in ("size", "signature", "prefix")]
    nodes = written(rows.groupBy("id").agg(first, *whole).select("id", F.col("first.key").alias(key), F.col("first.digest").alias(digest), "size", "signature", "prefix"), "nodes")
    shared = written(filed(nodes).mapInPandas(grouped, SHARED), "shared-filings")

    def links(pairs: DataFrame) -> DataFrame:
        chosen = staged(open_pairs(pairs, nodes))
        wanted = chosen.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        found = sets_of(docs, nodes.select("id", key, digest).join(wanted, "id"), text)
        return staged(similar(chosen, found.dropDuplicates(["id"])))

    near = docs.sparkSession.createDataFrame([], "a long, b long")
    if linked is not None:
        of = lambda name: rows.select(F.col("digest").alias(name), F.col("id").alias(f"_{name}")).distinct()
        near = stars(linked.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    # what is offered often is alike; whoever is in the component of all it is offered needs no comparison
    rooted = staged(with_roots(shared, near)) if linked is not None else shared.withColumn("root", F.col("id"))
    offered = rooted.where("open").groupBy("id", "root", "first").count()
    of_first = rooted.select(F.col("id").alias("first"), F.col("root").alias("_root")).distinct()
    apart = offered.join(of_first, "first").where("root <> _root")
    tried = staged(apart.groupBy("id").agg(F.max_by("first", F.struct("count", "first")).alias("b")).select(F.col("id").alias("a"), "b"))
    near = stars(near.unionByName(links(tried)))
    near, tried = offered_again(shared, near, tried, links)
    rooted = with_roots(shared, near).drop("first", "open")
    # in large groups signatures go with the filings, so that pairs that cannot be similar are never made
    large = rooted.where(F.col("many") >= LARGE).join(nodes.select("id", "signature"), "id")
    others = met_apart(rooted.where(F.col("many") < LARGE), False).unionByName(met_apart(large, True)).distinct()
    known = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = connected(near.unionByName(links(staged(others.join(known, ["a", "b"], "left_anti")))))
    named = rows.select("key", "digest", "id").join(found, F.col("id") == F.col("node"), "left")
    return named.select(F.col("key").alias(key), F.col("digest").alias(digest), F.coalesce("root", "id").alias("root"))
