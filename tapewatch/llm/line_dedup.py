"""Removal of lines that repeat an earlier line, by an exact set-similarity join.

A line is the set of its lower-cased words. Lines are in the order of key, text hash and place. A line goes if
the set of an earlier line has a Jaccard similarity of at least ``PERCENT`` with its own, whether that line
stays or not.

Equal sets are one class, named by its first line. Between classes the join is by prefix filter: tokens are
ordered by rarity, and sets that are similar enough share one of their first tokens: one of the larger set's prefix (a
fifth of it) and the smaller one's index prefix (a ninth). Lengths, the places of the shared token and one-bit
signatures of all tokens must leave room for the overlap that is needed; then, for each pair, the shared tokens of the
prefixes are counted, and what can follow the last of them must leave room as well. What is left is compared by wider
signatures, so that few pairs carry whole sets through a shuffle, and then by those.

In the group of a frequent token all classes are first compared with the earliest one only. Groups of many near
copies are done with that, linearly; what it does not decide is joined with all earlier classes of the group.

Rarity comes from counts over ``2 ** TABLE_BITS`` hash classes, of the words of all texts: a table of a fixed size, one byte a
class. A token whose class counts one word is shared by no two lines and is not filed. Any order, and any choice of
frequent tokens, gives the same result.

Defined cases: null, empty and blank lines stay and are not counted; rows that share key and text are decided
alike; rows that share only the key are ordered by their text's hash; a null key comes first; an empty table
gives an empty result; other columns are not used; lines of any length are compared whole.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.runtime import SPACE, text_of
from tapewatch.operators.ordered import join_on, small_side
from tapewatch.session import scratch_path, staged

PERCENT = 80
TABLE_BITS = 20
#: Hash classes of the table that are put together in one row on the way.
CHUNK = 4096
#: Classes under one token from which they are first compared with the earliest one.
LARGE = 256
#: Bits of a token's hash beside its rarity in the tokens of a prefix.
HASH_BITS = 52
#: Longs of a wider signature.
WIDE = 4
#: Smaller sets are similar to their equals only.
LEAST_SIZE = next(n for n in range(1, 200) if 100 * n >= PERCENT * (n + 1))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` from compressed files in the shared folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def words(line: Column) -> Column:
    """The lower-cased words of a line, with empty ones; splitting at one character, and looking for others, needs no pattern."""
    other = reduce(Column.__or__, [F.contains(line, F.lit(space)) for space in "\t\n\x0b\x0c\r"])
    plain = F.when(other, F.regexp_replace(line, r"[\x09-\x0D]", " ")).otherwise(line)
    return F.split(F.lower(plain), " ")


def hashes(line: Column) -> Column:
    """Hashes of the words of a line."""
    return F.transform(F.array_remove(words(line), ""), lambda w: F.xxhash64(w))


def tokens(line: Column) -> Column:
    """Hashes of the distinct words of a line."""
    return F.array_distinct(hashes(line))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``digest``, ``line`` (its place) and ``body`` of every line with a word."""
    body = text_of(text)
    split = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("digest"), F.posexplode(F.split(body, "\n")).alias("line", "body"))
    return split.where(F.col("body").rlike(r"[^\x20\x09-\x0D]"))


def rarity_of(count: Column) -> Column:
    """A byte that grows with the number of words in a hash class."""
    return F.least(F.floor(4 * F.log2(1 + count)), F.lit(127)).cast("byte")


#: The byte of hash classes that count one word.
ONCE = int(4 * math.log2(2))


def rarity_table(docs: DataFrame, text: str) -> Column:
    """For each hash class of tokens a byte that grows with their number in all texts, as one array."""
    spark = docs.sparkSession
    lines = docs.select(F.explode(F.split(text_of(text), "\n")).alias("body"))
    found = lines.select(F.explode(words(F.col("body"))).alias("word")).where("word <> ''")
    counted = found.groupBy(cell(F.xxhash64("word")).alias("id")).count()
    every = spark.range(1 << TABLE_BITS).join(counted, "id", "left")
    rank = rarity_of(F.coalesce("count", F.lit(0))).alias("rank")
    chunks = every.groupBy(F.floor(F.col("id") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("id", rank))).alias("rows"))
    chunks = chunks.select("chunk", F.transform("rows", lambda r: r["rank"]).alias("ranks"))
    packed = staged(chunks.agg(F.sort_array(F.collect_list(F.struct("chunk", "ranks"))).alias("chunks")).select(F.flatten(F.transform("chunks", lambda c: c["ranks"])).alias("ranks")))
    return packed.scalar()


def cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << TABLE_BITS) - 1)).cast("int")


def needed(a: Column, b: Column) -> Column:
    """The least overlap of similar sets of sizes ``a`` and ``b``."""
    return F.ceil(PERCENT * (a + b) / (100 + PERCENT))


def prefix_size(size: Column) -> Column:
    return size - F.ceil(PERCENT * size / 100) + 1


def index_size(size: Column) -> Column:
    """How many first tokens a set is found by from sets that are no smaller."""
    return size - F.ceil(2 * PERCENT * size / (100 + PERCENT)) + 1


def described(lines: DataFrame, ranks: Column) -> DataFrame:
    """Each line with the two hashes that name its class, its size, its signature and its prefix."""

    def packed(h: Column) -> Column:
        return F.shiftleft(F.col("ranks")[cell(h)].cast("long"), HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))

    # rare tokens first; a set is in one order whatever that of its line; what stands in a lambda's array is not compiled
    ordered = F.sort_array(F.array_distinct(F.transform(hashes(F.col("body")), packed))).alias("tokens")
    ordered = lines.withColumn("ranks", ranks).select("key", "digest", "line", ordered)
    size = F.size("tokens")
    prefix = F.when(size >= LEAST_SIZE, F.slice("tokens", 1, prefix_size(size).cast("int"))).otherwise(F.array().cast("array<bigint>"))
    names = [F.xxhash64(F.lit(k), "tokens").alias(name) for k, name in ((1, "a"), (2, "b"))]
    return ordered.select("key", "digest", "line", *names, size.alias("size"), signature(F.col("tokens")).alias("signature"), prefix.alias("prefix"))


def bit_of(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def signature(tokens: Column) -> Column:
    """One bit of a long for each token."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseOR(bit_of(h)))


def room(mine: str, theirs: str) -> Column:
    """An upper bound of the overlap: a bit that only one of the sets has stands for a token that only it has."""
    alone = lambda a, b: F.col(f"{a}.size") - F.bit_count(F.col(f"{a}.signature").bitwiseAND(F.bitwise_not(F.col(f"{b}.signature"))))
    return F.least(alone(mine, theirs), alone(theirs, mine))


def may_match(a: str, b: str) -> Column:
    """Length, positional and signature filters for a shared prefix token of the rows ``a`` and ``b``."""
    size_a, size_b, at_a, at_b = F.col(f"{a}.size"), F.col(f"{b}.size"), F.col(f"{a}.at"), F.col(f"{b}.at")
    least = needed(size_a, size_b)
    rest = F.least(size_a - at_a, size_b - at_b)
    # tokens before the shared one may be shared as well
    before = F.least(at_a, at_b)
    lengths = (100 * F.least(size_a, size_b)) >= (PERCENT * F.greatest(size_a, size_b))
    # of equal sizes either may be the smaller one, so one of them is enough
    indexed = ((size_a <= size_b) & (at_a < index_size(size_a))) | ((size_b <= size_a) & (at_b < index_size(size_b)))
    return lengths & indexed & (rest + before >= least) & (room(a, b) >= least)


def candidates(met: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` of ``met``, rows ``x`` and ``y`` of one shared token each, that leave room for the overlap.

    Shared tokens are in one order in both sets, and all before the last one met are met too, so that the others follow it in both.
    """
    places = [F.max("x.at").alias("at_a"), F.max("y.at").alias("at_b"), F.first("x.size").alias("size_a"), F.first("y.size").alias("size_b")]
    counted = met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count(F.lit(1)).alias("n"), *places)
    follow = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) - 1
    return counted.where(F.col("n") + follow >= needed(F.col("size_a"), F.col("size_b"))).select("a", "b")


def wide_signatures(sets: DataFrame) -> DataFrame:
    """``id``, ``size`` and one bit of ``WIDE`` longs, ``wide0`` and on, for each token of a set; sets may repeat."""
    # an inner explode would look for empty sets below the join, in all lines
    rows = sets.select("id", F.size("tokens").alias("size"), F.explode_outer("tokens").alias("h"))
    part = F.pmod(F.shiftright("h", 6), F.lit(WIDE))
    bits = [F.bit_or(F.when(part == k, bit_of(F.col("h"))).otherwise(F.lit(0).cast("long"))).alias(f"wide{k}") for k in range(WIDE)]
    return rows.groupBy("id").agg(F.max("size").alias("size"), *bits)


def with_both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with the other columns of ``sets`` for ``a`` and for ``b``."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select([F.col(c).alias(side if c == "id" else f"{c}_{side}") for c in sets.columns]), side)
    return pairs


def sets_of(classes: DataFrame, docs: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """Token sets of the classes in ``pairs``, from the first line of each."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    places = wanted.join(classes.select("id", "first"), "id").select("id", "first", "first.*")
    # a few numbers each: sent to every executor while they are few enough, else lines are shuffled
    found = join_on(lines_of(docs, key, text), small_side(places), ["key", "digest", "line"], "inner")
    return found.select("id", "first", tokens(F.col("body")).alias("tokens"))


def verified(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``id`` of the later classes of pairs whose sets are similar; ``sets`` gives those of a table of pairs."""
    signed = wide_signatures(sets(pairs))
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"wide{k}_a").bitwiseXOR(F.col(f"wide{k}_b"))) for k in range(WIDE)])
    sizes = F.col("size_a") + F.col("size_b")
    # a bit that only one of the sets has stands for a token that only it has
    left = staged(with_both(pairs, signed).where(apart <= sizes - 2 * needed(F.col("size_a"), F.col("size_b"))).select("a", "b"))
    both = with_both(left, sets(left).dropDuplicates(["id"]))
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    both = both.where((100 + PERCENT) * shared >= PERCENT * (F.size("tokens_a") + F.size("tokens_b")))
    return both.select(F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()


def met(x: DataFrame, y: DataFrame, once: Column) -> DataFrame:
    """Rows ``x`` and ``y`` that share a token and may match."""
    return x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & once & may_match("x", "y"))


def similar_classes(rows: DataFrame, classes: DataFrame, similar: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``id`` of classes that are similar to an earlier one; ``rows`` has one row for each token of a prefix."""
    # a token of that many classes is counted as often at least, so that only rows of such tokens are counted again
    frequent = rows.where(F.shiftright("token", HASH_BITS) >= int(4 * math.log2(1 + LARGE)))
    of_token = staged(frequent.groupBy("token").count().where(F.col("count") >= LARGE).select("token"))
    later = F.col("y.id") < F.col("x.id")
    if of_token.isEmpty():
        return similar(written(candidates(met(rows, rows, later)), "line-pairs"))
    large = written(frequent.join(small_side(of_token), "token").join(classes.select("id", "first"), "id"), "line-groups")
    hubs = large.groupBy("token").agg(F.min(F.struct("first", "id", "size", "signature", "at")).alias("y"))
    near = large.select("token", F.struct("id", "size", "signature", "at").alias("x")).join(small_side(hubs), "token").where(F.col("x.id") != F.col("y.id"))
    decided = staged(similar(staged(near.where(may_match("x", "y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())))
    # in large groups pairs of decided classes never meet; all other groups join with themselves, in one shuffle
    mark = small_side(decided)
    large = large.select(*rows.columns)
    open_rows, gone = join_on(large, mark, ["id"], "left_anti"), join_on(large, mark, ["id"], "left_semi")
    usual = rows.join(small_side(of_token), "token", "left_anti")
    # a pair may share tokens of all kinds, so that they are counted together
    sides = [met(usual, usual, later), met(open_rows, large, later), met(gone, open_rows, later)]
    flat = [F.struct(F.col(f"{name}.id"), F.col(f"{name}.size"), F.col(f"{name}.at")).alias(name) for name in ("x", "y")]
    pairs = reduce(DataFrame.unionByName, [side.select(*flat) for side in sides])
    return decided.unionByName(similar(written(candidates(pairs), "line-pairs"))).distinct()


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``digest``, ``line`` of every line with a word, and whether it is ``removed``."""
    described_lines = written(described(lines_of(docs, key, text), rarity_table(docs, text)), "lines")
    place = F.struct("key", "digest", "line")
    whole = [F.first(c).alias(c) for c in ("size", "signature", "prefix")]
    classes = described_lines.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), *whole)
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "line-classes")

    def similar(pairs: DataFrame) -> DataFrame:
        return verified(pairs, lambda chosen: sets_of(classes, docs, chosen, key, text))

    rows = classes.select("id", "size", "signature", F.posexplode("prefix").alias("at", "token")).select("token", "id", "size", "signature", "at")
    rows = rows.where(F.shiftright("token", HASH_BITS) > ONCE)
    found = similar_classes(rows, classes, similar).withColumn("gone", F.lit(True))

    # all other lines are the only one of their class, and stay
    special = classes.select("id", "a", "b", "first", "n").join(found, "id", "left").where((F.col("n") > 1) | F.col("gone"))
    named = described_lines.select("key", "digest", "line", "a", "b").join(small_side(special.select("a", "b", "first", "gone")), ["a", "b"], "left")
    removed = F.coalesce("gone", F.lit(False)) | (F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")))
    return named.select("key", "digest", "line", removed.alias("removed"))


def summary(lines: DataFrame) -> DataFrame:
    """Per document (``key``, ``digest``): lines with a word, and the places of removed ones in order."""
    places = F.sort_array(F.collect_set(F.when(F.col("removed"), F.col("line"))))
    # the set of all places, not a distinct count, which would deal every line anew
    return lines.groupBy("key", "digest").agg(F.size(F.collect_set("line")).cast("long").alias("n_lines"), places.alias("removed"))


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``."""
    mark = f"_digest_{uuid.uuid4().hex[:8]}"
    removed = summary(repeated_lines(docs, key, text)).select(F.col("key").alias(key), F.col("digest").alias(mark), "removed").where(F.size("removed") > 0)
    marked = docs.withColumn(mark, F.xxhash64(text_of(text)))
    joined = join_on(marked, removed.withColumnRenamed("removed", f"{mark}_lines"), [key, mark], "left")
    kept = F.array_join(F.filter(F.split(text_of(text), "\n"), lambda _, i: ~F.array_contains(F.col(f"{mark}_lines"), i)), "\n")
    return joined.withColumn(text, F.when(F.col(f"{mark}_lines").isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)
