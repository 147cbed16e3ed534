"""Token ids in raw binary shards, with a minimal perfect hash index from document keys to places in them.

Layout below a folder: ``ids/shard-*.bin`` (ids side by side, little-endian, two bytes where the vocabulary
allows, documents in ascending key order), ``rows`` (one row per document as written), ``shards`` (ids before
each shard) and ``index/*.npz`` (one perfect hash per bucket of keys).

A bucket's hash is a cascade of bit arrays: at each level a key that has a bit to itself is placed there and
the others go on. The rank of a key's bit is its slot, which stores a fingerprint, shard, offset and length,
so a lookup costs the same for any number of documents, and an absent key is told by its fingerprint.

Files are written under a name of the attempt and then moved, so a task that runs again after an executor was
lost puts the same file in place. Defined cases: a null text is the empty one (only the end id); rows with a
null key come first and are found by the null key; rows with equal keys are kept, in order of their texts,
and numbered as copies 0, 1, ...; an empty table gives a store without documents; other columns are not used.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewatch.llm.runtime import file_system, text_of
from tapewatch.llm.tokenizing import encoder, load

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Keys in a bucket of the index, on average; a bucket is built in one task.
BUCKET_KEYS = 100_000
#: Bits per key at each level of the cascade.
BITS_PER_KEY = 2
#: Bytes that a task reads from a shard at once.
READ_BYTES = 8 << 20


@dataclass(frozen=True)
class TokenStore:
    """Where a store is and how to read it."""

    folder: str
    key: str
    dtype: str
    buckets: int

    @staticmethod
    def open(spark: SparkSession, folder: str) -> TokenStore:
        row = spark.read.parquet(f"{folder}/store").first()
        return TokenStore(folder, row["key"], row["dtype"], row["buckets"])


def _move(folder: str, name: str, write) -> None:
    """Write a file under a passing name, then give it its own."""
    files, path = file_system(folder)
    passing = f"{path}/{name}.{uuid.uuid4().hex}"
    files.create_dir(path, recursive=True)
    with files.open_output_stream(passing) as out:
        write(out)
    files.move(passing, f"{path}/{name}")


def write_tokens(
    docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID
) -> TokenStore:
    """Encode every whole text, append ``end_id``, write the shards in key order, and index them."""
    spark = docs.sparkSession
    dtype = "<u2" if max(load(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    width = np.dtype(dtype).itemsize
    end = np.array([end_id], dtype).tobytes()
    # equal keys are dealt out by their texts, so that one key cannot fill a task
    hashed = F.xxhash64(text_of(text))
    ordered = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    ordered = ordered.repartitionByRange(F.col("key").asc_nulls_first(), hashed).sortWithinPartitions(F.col("key").asc_nulls_first(), hashed, "text")

    def shard_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, encode = TaskContext.get().partitionId(), encoder(tokenizer, dtype).encode
        found: list[pd.DataFrame] = []

        def write(out) -> None:
            offset, row = 0, 0
            for batch in batches:
                ids = [x + end for x in encode(batch["text"].tolist())]
                sizes = np.array([len(x) for x in ids], np.int64) // width
                places = offset + np.cumsum(sizes) - sizes
                out.write(b"".join(ids))
                found.append(pd.DataFrame({"key": batch["key"], "shard": shard, "row": row + np.arange(len(ids)), "offset": places, "n_tokens": sizes}))
                offset, row = offset + int(sizes.sum()), row + len(ids)

        _move(f"{folder}/ids", f"shard-{shard:06d}.bin", write)
        yield from found

    kind = dict(ordered.dtypes)["key"]
    schema = "key string, shard int, row long, offset long, n_tokens long"
    written = _texted(ordered).mapInPandas(shard_rows, schema)
    written.withColumn("key", F.col("key").cast(kind)).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    # one row per shard: their totals before each
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n_ids"))
    totals.select("shard", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("ids_before")).write.parquet(f"{folder}/shards")

    buckets = max(1, -(-rows.count() // BUCKET_KEYS))
    _index(numbered(rows), folder, buckets).write.parquet(f"{folder}/index_sizes")
    spark.createDataFrame([(key, dtype, buckets)], "key string, dtype string, buckets long").coalesce(1).write.parquet(f"{folder}/store")
    return TokenStore(folder, key, dtype, buckets)


def _texted(rows: DataFrame) -> DataFrame:
    """The key as text on its way through Python, where a null would turn whole numbers into rounded ones."""
    return rows.withColumn("key", F.col("key").cast("string"))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``copy``, the number of earlier rows of the same key.

    Keys are counted per shard first; only a key that goes on into later shards has anything to add there,
    and its rows in a shard follow each other.
    """
    per_shard = rows.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_shard.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    several = starts.where((F.col("n") > 1) | (F.col("earlier") > 0)).select("key", "shard", "earlier", "first")
    a, b = rows.alias("a"), several.alias("b")
    joined = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.shard") == F.col("b.shard")), "left")
    copy = F.coalesce(F.col("b.earlier") + F.col("a.row") - F.col("b.first"), F.lit(0)).cast("long")
    return joined.select("a.*", copy.alias("copy"))


def _hashes(key: Column, copy: Column, buckets: int) -> list[Column]:
    """Two independent hashes of a key and the bucket it belongs to."""
    parts = [key.isNull(), key, copy]
    one, two = (F.xxhash64(*parts, F.lit(k)) for k in (1, 2))
    return [one.alias("h1"), two.alias("h2"), F.pmod(F.xxhash64(*parts, F.lit(3)), F.lit(buckets)).alias("bucket")]


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bit of each key at a level: the two hashes combined differently for each level, then mixed."""
    x = h1.view(np.uint64) + h2.view(np.uint64) * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    return (x % np.uint64(bits)).astype(np.int64)


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return ((h1.view(np.uint64) ^ (h2.view(np.uint64) >> np.uint64(7))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class PerfectHash:
    """A cascade of bit arrays over distinct pairs of hashes."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.starts = np.cumsum([0, *[int(x.sum()) for x in levels]])
        self.ranks = [np.cumsum(x) - 1 for x in levels]

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels = []
        while len(h1):
            bits = BITS_PER_KEY * len(h1)
            at = _positions(h1, h2, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(alone)
            rest = ~alone[at]
            h1, h2 = h1[rest], h2[rest]
        return cls(levels)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for a key that no level holds."""
        slots, open_ = np.full(len(h1), -1), np.arange(len(h1))
        for level, (alone, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = _positions(h1[open_], h2[open_], level, len(alone))
            hit = alone[at]
            slots[open_[hit]] = self.starts[level] + ranks[at[hit]]
            open_ = open_[~hit]
        return slots


def _index(rows: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Write one index file per bucket; gives the number of keys of each."""

    def build(bucket: tuple, keys: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = keys["h1"].to_numpy(np.int64), keys["h2"].to_numpy(np.int64)
        found = PerfectHash.build(h1, h2)
        order = np.argsort(found.slots(h1, h2))
        parts = {f"level_{k:03d}": np.packbits(x) for k, x in enumerate(found.levels)}
        parts["level_bits"] = np.array([len(x) for x in found.levels], np.int64)
        parts["fingerprint"] = _fingerprint(h1, h2)[order]
        parts |= {n: keys[n].to_numpy(np.int64)[order] for n in ("shard", "offset", "n_tokens")}
        held = io.BytesIO()
        np.savez(held, **parts)
        _move(f"{folder}/index", f"bucket-{int(bucket[0]):08d}.npz", lambda out: out.write(held.getvalue()))
        return pd.DataFrame({"bucket": [int(bucket[0])], "n_keys": [len(keys)]})

    hashed = rows.select(*_hashes(F.col("key"), F.col("copy"), buckets), "shard", "offset", "n_tokens")
    return hashed.groupBy("bucket").applyInPandas(build, "bucket long, n_keys long")


def _read_index(folder: str, bucket: int):
    files, path = file_system(f"{folder}/index")
    with files.open_input_stream(f"{path}/bucket-{bucket:08d}.npz") as f:
        held = np.load(io.BytesIO(f.read()))
    sizes = held["level_bits"]
    levels = [np.unpackbits(held[f"level_{k:03d}"], count=int(n)).astype(bool) for k, n in enumerate(sizes)]
    return PerfectHash(levels), {n: held[n] for n in ("fingerprint", "shard", "offset", "n_tokens")}


def locate(store: TokenStore, keys: DataFrame) -> DataFrame:
    """Shard, offset and length of each distinct (``key``, ``copy``) of ``keys``; absent ones are left out.

    Keys meet their bucket's file in order, so a task holds one bucket at a time.
    """
    kind = dict(keys.dtypes)["key"]
    folder = store.folder

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, index = None, None
        for batch in batches:
            for bucket, part in batch.groupby("bucket", sort=False):
                if held != bucket:
                    held, index = bucket, _read_index(folder, int(bucket))
                h1, h2 = part["h1"].to_numpy(np.int64), part["h2"].to_numpy(np.int64)
                slots = index[0].slots(h1, h2)
                known = (slots >= 0) & (index[1]["fingerprint"][slots] == _fingerprint(h1, h2))
                place = {n: index[1][n][slots[known]] for n in ("shard", "offset", "n_tokens")}
                yield part.loc[known, ["key", "copy"]].assign(**place)

    hashed = keys.select("key", "copy").distinct().select("key", "copy", *_hashes(F.col("key"), F.col("copy"), store.buckets))
    dealt = hashed.repartition("bucket").sortWithinPartitions("bucket")
    found = _texted(dealt).mapInPandas(probe, "key string, copy long, shard int, offset long, n_tokens long")
    return found.withColumn("key", F.col("key").cast(kind))


def read_ids(spark: SparkSession, store: TokenStore, places: DataFrame, reduce, schema: str) -> DataFrame:
    """``reduce(ids)``, a tuple for the columns ``schema``, for each place, read from the shards.

    Places are dealt out by shard and offset: neighbours are read together and a shard of any size is shared.
    Also gives ``start``, the ids of all documents before.
    """
    dtype, folder, width = np.dtype(store.dtype), store.folder, np.dtype(store.dtype).itemsize
    kind = dict(places.dtypes)["key"]
    names = [part.split()[0] for part in schema.split(",")]

    def spans(batch: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
        """Neighbours in one shard, up to the bytes read at once."""
        block = (batch["offset"] * width) // READ_BYTES
        yield from ((shard, part) for (shard, _), part in batch.groupby([batch["shard"], block], sort=False))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = file_system(f"{folder}/ids")
        held, source = None, None
        for batch in batches:
            for shard, part in spans(batch):
                if held != shard:
                    held, source = shard, files.open_input_file(f"{path}/shard-{shard:06d}.bin")
                begin, stop = part["offset"].min(), (part["offset"] + part["n_tokens"]).max()
                raw = np.frombuffer(source.read_at(int(stop - begin) * width, int(begin) * width), dtype)
                rows = [reduce(raw[o - begin : o - begin + n]) for o, n in zip(part["offset"], part["n_tokens"])]
                yield part.assign(**dict(zip(names, zip(*rows))))

    near = places.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    found = _texted(near).mapInPandas(read, f"key string, copy long, shard int, offset long, n_tokens long, {schema}")
    found = found.withColumn("key", F.col("key").cast(kind))
    before = spark.read.parquet(f"{folder}/shards").select("shard", "ids_before")
    return found.join(before, "shard").withColumn("start", F.col("ids_before") + F.col("offset")).drop("ids_before")


def keys_of(spark: SparkSession, store: TokenStore) -> DataFrame:
    """Every (``key``, ``copy``) that the store holds."""
    return numbered(spark.read.parquet(f"{store.folder}/rows")).select("key", "copy")
