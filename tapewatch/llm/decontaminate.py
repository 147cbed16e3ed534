"""Benchmark passages in documents, also where numbers, names and units were exchanged.

A text becomes a sequence of words in which numbers, units after numbers and names (capitalised words inside a
sentence) are typed placeholders. Windows of this template are hashed and joined with those of the benchmark
items. Matches on one diagonal (place in the document less place in the item) are put together; the values
that stand in the placeholders must correspond one to one, which is what a re-parameterised
question does and a chance match does not. An unbroken stretch of ``run`` words, or all but one word of a shorter item, is a
leak. Where values do not correspond, the match is cut: its longest stretch without two placeholders at odds is a leak if that
many of its words, placeholders' values among them, stand in the item as they are.

The join is prepared in the row: a bit table over the hashes of the benchmark, of a size that follows the
benchmark and has a fixed bound, removes nearly all windows of a document before any row is made of them. A leak is that many
windows in sequence, so that one of every few is looked up, and all others around those found only.

Defined cases: a null text or item has no words and matches nothing; items of fewer than ``SHORTEST`` words are
too short to be told from chance and match nothing; repeated documents match one by one; items that share an identifier
are matched each for itself and reported once, with their longest match; windows with
fewer than half their words outside placeholders are not used; empty tables give an empty result; a text of any
length is searched whole; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewatch.llm.runtime import let, text_of
from tapewatch.session import staged

WINDOW, RUN, SHORTEST = 8, 13, 5
#: Bits of the table for each window of the benchmark, and the least and largest size as powers of two.
BITS_PER_WINDOW, SMALLEST, LARGEST = 256, 16, 26
#: Rows of the benchmark that may be sent to every executor.
BROADCAST_WINDOWS = 200_000
#: Letters, and the words and numbers of a text.
_L, _ANY = r"[\p{L}\p{M}]", r"\p{L}\p{M}\p{N}"
TOKEN = rf"\p{{N}}+(?:[.,]\p{{N}}+)*|{_L}+"
#: A word that is one of these digits stands for a placeholder.
NUMBER, NAME, UNIT = "0", "1", "2"
#: Units, which count as such after a number only, and number words.
UNITS = (
    "km m cm mm kg g mg lb lbs oz l ml mi ft hour hours minute minutes second seconds day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees mile miles meter meters metre metres gram grams liter liters litre litres feet inches"
).split()
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
#: The number words by their first letter, which most places of a text do not have.
_REST = {first: [word[1:] for word in NUMBER_WORDS if word[0] == first] for first in sorted({word[0] for word in NUMBER_WORDS})}
SPELLED = rf"(?i)(?=[{''.join(_REST)}])(?<!{_L})(?:{'|'.join(f'{first}(?:{"|".join(rest)})' for first, rest in _REST.items())})(?!{_L})"


def template(text: Column) -> Column:
    """The words of a text in lower case, placeholders as their digit; one for each of ``values``."""
    numbered = F.regexp_replace(text, r"\p{N}+(?:[.,]\p{N}+)*", NUMBER)
    spelled = F.regexp_replace(numbered, SPELLED, NUMBER)
    # a capital after a full stop, a colon or a new line says nothing
    named = F.regexp_replace(spelled, rf"(?![a-zA-Z0-9])(?<=[{_ANY}])([^{_ANY}.!?:\n]+)\p{{Lu}}\p{{Ll}}{_L}*", f"$1 {NAME}")
    measured = F.regexp_replace(F.lower(named), rf"{NUMBER}\s?(?:{'|'.join(UNITS)})(?!{_L})", f"{NUMBER} {UNIT}")
    return F.regexp_extract_all(measured, F.lit(rf"\p{{N}}|{_L}+"), F.lit(0))


def values(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def placeholder(form: Column) -> Column:
    return form.isin(NUMBER, NAME, UNIT)


def hash_at(words: Column, size: int, at: Column) -> Column:
    """The hash of the window of ``size`` words from a place."""
    return F.xxhash64(F.lit(size), *[words[at + k] for k in range(size)])


def hashes(words: Column, size: int) -> Column:
    """The hash of every window of ``size`` words."""
    last = F.size(words) - size
    every = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda at: hash_at(words, size, at))
    return F.when(last >= 0, every).otherwise(F.array().cast("array<bigint>"))


def least_words(n_words: Column, run: int) -> Column:
    """How many words of an item of ``n_words`` must match."""
    return F.least(F.lit(run), F.greatest(n_words - 1, F.lit(SHORTEST)))


def slots(words: Column, spoken: Column, at: Column, size: Column) -> Column:
    """What stands in the placeholders of a window, in order."""
    both = F.zip_with(F.slice(words, at + 1, size), F.slice(spoken, at + 1, size), lambda w, v: F.struct(w.alias("w"), v.alias("v")))
    return F.transform(F.filter(both, lambda t: placeholder(t["w"])), lambda t: t["v"])


def spots(words: Column, at: Column, size: Column) -> Column:
    """Where in a window its placeholders are, in order."""
    return F.filter(F.sequence(F.lit(0), size - 1), lambda k: placeholder(F.get(words, at + k)))


def benchmark_windows(items: DataFrame, item: str, text: str) -> DataFrame:
    """``item``, ``item_row``, ``n_words``, ``size``, ``place``, ``hash``, ``slots`` and their ``spots`` of every window of every item."""
    # identifiers may be shared by different items
    row = F.xxhash64(F.col(item).cast("string"), text_of(text)).alias("item_row")
    words = items.select(F.col(item).alias("item"), row, template(text_of(text)).alias("words"), values(text_of(text)).alias("spoken"))
    words = words.where(F.size("words") >= SHORTEST)
    found = None
    for size in range(SHORTEST, WINDOW + 1):
        own = words.where(F.size("words") >= size) if size == WINDOW else words.where(F.size("words") == size)
        placed = own.select("*", F.posexplode(hashes(F.col("words"), size)).alias("place", "hash"))
        values_ = slots(F.col("words"), F.col("spoken"), F.col("place"), F.lit(size)).alias("slots")
        spots_ = spots(F.col("words"), F.col("place"), F.lit(size)).alias("spots")
        rows = placed.select("item", "item_row", F.size("words").alias("n_words"), F.lit(size).alias("size"), "place", "hash", values_, spots_)
        rows = rows.where(2 * F.size("slots") <= size)
        found = rows if found is None else found.unionByName(rows)
    return found


def bit_table(windows: DataFrame, log_bits: int) -> Column:
    """The bits of all hashes as one array of longs, a scalar of the query."""
    spark = windows.sparkSession
    at = F.col("hash").bitwiseAND(F.lit((1 << log_bits) - 1))
    words = windows.groupBy(F.shiftright(at, 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits"))
    every = spark.range(1 << (log_bits - 6)).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    packed = every.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("rows"))
    return packed.select(F.transform("rows", lambda r: r["bits"]).alias("table")).scalar()


def sizes_of(windows: DataFrame, run: int) -> list[Row]:
    """For each ``size`` the number ``n`` of windows, and ``step``, how many in sequence every leak has; all of them are in the table."""
    sequence = F.greatest(least_words(F.col("n_words"), run) - F.col("size") + 1, F.lit(1))
    return windows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.min(sequence).alias("step")).collect()


def one_to_one(pairs: Column) -> Column:
    """No value stands for two others, on either side."""
    kinds = lambda *names: F.size(F.array_distinct(F.transform(pairs, lambda p: F.struct(*[p[n].alias(n) for n in names]))))
    return (kinds("mine", "theirs") == kinds("mine")) & (kinds("mine", "theirs") == kinds("theirs"))


def longest_stretch(pairs: Column, begin: Column, end: Column) -> Column:
    """``begin`` and ``end`` of the longest stretch of words without two placeholders at odds, the first of equal ones.

    Correspondence one to one is a property of each two placeholders, so a stretch that ends at a placeholder begins after
    the last earlier one at odds with it. ``pairs`` are by place; each is compared with those of its own island only.
    """

    def step(acc: Column, p: Column) -> Column:
        at_odds = F.filter(pairs, lambda q: (q["at"] < p["at"]) & (q["at"] >= acc["begin"]) & ((q["mine"] == p["mine"]) != (q["theirs"] == p["theirs"])))
        last = F.array_max(F.transform(at_odds, lambda q: q["at"]))
        # a stretch that this placeholder ends
        better = last.isNotNull() & (p["at"] - acc["begin"] > acc["best"]["end"] - acc["best"]["begin"])
        ended = F.struct(acc["begin"].alias("begin"), p["at"].alias("end"))
        return F.struct(F.coalesce(last + 1, acc["begin"]).alias("begin"), F.when(better, ended).otherwise(acc["best"]).alias("best"))

    def final(acc: Column) -> Column:
        return F.when(end - acc["begin"] > acc["best"]["end"] - acc["best"]["begin"], F.struct(acc["begin"].alias("begin"), end.alias("end"))).otherwise(acc["best"])

    return F.aggregate(pairs, F.struct(begin.alias("begin"), F.struct(begin.alias("begin"), begin.alias("end")).alias("best")), step, final)


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", run: int = RUN
) -> DataFrame:
    """One row per document and item that leaks into it: ``n_words`` matched, and ``exact`` if no slot differs."""
    windows = staged(benchmark_windows(items, item, item_text))
    sizes = sizes_of(windows, run)
    steps = {row["size"]: row["step"] for row in sizes} or {WINDOW: 1}
    total = sum(row["n"] for row in sizes)
    log_bits = min(LARGEST, max(SMALLEST, (BITS_PER_WINDOW * total).bit_length()))
    low_bits = (1 << log_bits) - 1

    def of_size(words: Column, bits: Column, size: int) -> Column:
        """The windows of one size whose bit is set, but for those in no sequence of ``step``."""
        last, step = F.size(words) - size, steps[size]

        def known(row: Column) -> Column:
            word = bits[F.shiftright(row["hash"].bitwiseAND(F.lit(low_bits)), 6).cast("int")]
            return F.getbit(word, row["hash"].bitwiseAND(F.lit(63)).cast("int")) == 1

        def found(places: Column) -> Column:
            row = lambda at: F.struct(F.lit(size).alias("size"), at.alias("at"), hash_at(words, size, at).alias("hash"))
            return F.filter(F.transform(places, row), known)

        rows = found(F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>")))
        if step == 1:
            return rows
        around = lambda row: F.sequence(F.greatest(row["at"] - (step - 1), F.lit(0)), F.least(row["at"] + (step - 1), last))
        return let(rows, lambda some: F.when(F.size(some) > 0, found(F.array_distinct(F.flatten(F.transform(some, around))))).otherwise(some))

    def candidates(given: Column) -> Column:
        words = given["words"]

        def with_slots(spoken: Column, rows: Column) -> Column:
            return F.transform(
                rows, lambda r: F.struct(*[r[n].alias(n) for n in ("size", "at", "hash")], slots(words, spoken, r["at"], r["size"]).alias("values"))
            )

        rows = F.concat(*[of_size(words, given["bits"], size) for size in sorted(steps)])
        # the words as written are looked at in documents with a candidate only
        return let(rows, lambda r: F.when(F.size(r) > 0, let(values(given["body"]), lambda spoken: with_slots(spoken, r))))

    bare = docs.select(F.col(key).alias("key"), text_of(text).alias("body"), bit_table(windows, log_bits).alias("bits"))
    given = F.struct(template(F.col("body")).alias("words"), F.col("body").alias("body"), F.col("bits").alias("bits"))
    # documents may share a key: each row is matched for itself
    found = bare.select("key", F.monotonically_increasing_id().alias("row"), let(given, candidates).alias("hits"))
    hits = found.select("key", "row", F.explode("hits").alias("h")).select("key", "row", "h.*")
    side = F.broadcast(windows) if total <= BROADCAST_WINDOWS else windows
    matched = hits.join(side.withColumnRenamed("size", "item_size"), "hash").where("size = item_size")

    places = F.transform("spots", lambda spot: F.col("at") + spot)
    pairs = F.arrays_zip(places.alias("at"), F.col("values").alias("mine"), F.col("slots").alias("theirs"))
    placed = matched.select("key", "row", "item", "item_row", "n_words", "size", "at", (F.col("at") - F.col("place")).alias("diagonal"), pairs.alias("pairs")).distinct()
    order = Window.partitionBy("row", "item_row", "diagonal", "size").orderBy("at")
    islands = placed.withColumn("island", F.col("at") - F.row_number().over(order))
    # an island is no longer than its item
    grown = islands.groupBy("row", "item_row", "diagonal", "size", "island").agg(
        F.first("key").alias("key"),
        F.first("item").alias("item"),
        F.first("n_words").alias("item_words"),
        F.min("at").alias("begin"),
        (F.max("at") + F.first("size")).alias("end"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("pairs")))).alias("pairs"),
    )
    cut = grown.withColumn("stretch", F.when(one_to_one(F.col("pairs")), F.struct("begin", "end")).otherwise(longest_stretch(F.col("pairs"), F.col("begin"), F.col("end"))))
    cut = cut.withColumn("n_words", F.col("stretch.end") - F.col("stretch.begin"))
    least = least_words(F.col("item_words"), run)
    differ = lambda p: (p["at"] >= F.col("stretch.begin")) & (p["at"] < F.col("stretch.end")) & (p["mine"] != p["theirs"])
    cut = cut.withColumn("n_differ", F.size(F.filter("pairs", differ)))
    whole = F.col("n_words") == F.col("end") - F.col("begin")
    long_enough = F.when(whole, F.col("n_words")).otherwise(F.col("n_words") - F.col("n_differ")) >= least
    leaks = cut.where(long_enough).groupBy("row", "item").agg(F.first("key").alias("key"), F.max("n_words").alias("n_words"), F.max(F.col("n_differ") == 0).alias("exact"))
    return leaks.select(F.col("key").alias(key), F.col("item").alias(item), "n_words", "exact")
