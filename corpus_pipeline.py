"""The documents pipeline: stages that each call one operator, written as Parquet and read again in between.

Every stage but the last returns the columns of documents. Null keys are keys like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm import decontaminate, mixing, near_copies, quality_rules, simhash
from tapewatch.llm.catalogue import benchmark, token_rows
from tapewatch.llm.runtime import documents, prepare, text_of
from tapewatch.operators.ordered import join_on, small_side
from tapewatch.session import scratch_path, staged

#: The token ids of the last stage cannot be had in SQL; tests hold the rows against brute force.
ORACLE_SQL = None
KEY = "doc_id"
#: Differing bits of five-word fingerprints up to which documents are looked at as copies at once.
COPY_BITS = 2


def own_name(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``docs`` has such a column."""
    while name in docs.columns:
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality rules keeps; null and empty texts have no words and go, repeated rows are judged alike."""
    out = own_name(docs, "_ledger")
    return quality_rules.apply_policy(quality_rules.rule_ledger(docs, out=out), out=out).drop(out)


def with_digest(docs: DataFrame, name: str = "_digest") -> DataFrame:
    return docs.withColumn(name, F.xxhash64(text_of("text")))


def first_of(named: DataFrame) -> DataFrame:
    """Of each ``root`` the row with the smallest key."""
    first = named.groupBy("root").agg(F.min(F.struct(F.col(KEY).isNull().alias("unknown"), KEY, "_digest")).alias("first"))
    return first.select("root", F.col(f"first.{KEY}").alias(KEY), "first._digest")


def similar_by_fingerprint(marked: DataFrame) -> DataFrame:
    """Digests ``a``, ``b`` of texts whose fingerprints are near the first one's of their group and whose similarity to it is 0.8 or more."""
    prints = staged(simhash.fingerprints(marked).select(KEY, "_digest", "fingerprint"))
    named = staged(simhash.near_duplicates(prints, KEY, max_bits=COPY_BITS).select(KEY, "_digest", "root").distinct())
    first = first_of(named).select("root", F.col("_digest").alias("b"))
    pairs = staged(named.join(first, "root").where("_digest <> b").select(F.col("_digest").alias("a"), "b").distinct())
    # one row for each text, whatever its keys
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("_digest"))
    sets = staged(near_copies.sets_of(marked, wanted).dropDuplicates(["id"]))
    return staged(near_copies.similar(pairs, sets))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest key.

    Near fingerprints of five-word shingles come first; those of equal or, compared exactly, similar texts are most of the links. A few edited words
    move a fingerprint further, so an exact join adds the links between the components found so far, and one document of each component of
    similarities of 0.8 or more stays. Of rows that share key and text one stays; null and empty texts are equal; a null key is the smallest of
    none but null keys. Only keys, fingerprints and shingle hashes are shuffled; texts stay where they are while the copies are few enough to be sent
    to every executor.
    """
    names = [KEY, own_name(docs, "_digest")]
    marked = with_digest(docs, names[1])
    plain = marked.select(KEY, F.col(names[1]).alias("_digest"), "text")
    rows = staged(near_copies.near_copies(plain, KEY, linked=similar_by_fingerprint(plain)))
    named = rows.distinct()
    gone = join_on(named, first_of(named), [KEY, "_digest"], "left_anti").select(KEY, F.col("_digest").alias(names[1]))
    kept = join_on(marked, small_side(gone), names, "left_anti")
    repeated = small_side(rows.groupBy(KEY, F.col("_digest").alias(names[1])).count().where("count > 1").drop("count"))
    if not repeated.isEmpty():
        once = join_on(kept, repeated, names, "left_semi").dropDuplicates(names)
        kept = join_on(kept, repeated, names, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks; null and empty texts hold none, rows that share a key go together."""
    leaking = decontaminate.find_leaks(docs, benchmark(spark, sf_dir)).select(KEY).distinct()
    return join_on(docs, leaking, [KEY], "left_anti")


def keep_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities that bring sources, languages and topics to their targets; null ones are a
    source or language of their own, and texts without tokens are drawn like others of their cell."""
    return mixing.mixed(mixing.described(docs), scarce=mixing.SCARCE).where("kept").select(*docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents in binary shards; what these files hold for each document. Null and empty texts are the end id alone."""
    return token_rows(spark, docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash", keep_one_of_copies),
    ("decontaminate", keep_uncontaminated),
    ("mixing", keep_mixture),
    ("token_shards", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepare(spark), sf_dir)
    for name, stage in STAGES:
        written = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
    return docs


run.family = "llm"
